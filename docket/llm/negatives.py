"""Hard negatives by a vantage-point tree over norm-augmented vectors.

With one more component, the square root of (largest squared norm - own squared norm), the distance from a query, whose own extra component is
zero, falls as the inner product grows: d^2 = |q|^2 + largest - 2 score. A window of scores is an annulus of distances, and
higher scores first is nearest first.

Index: a top tree of vantage points, fitted on a bounded sample of rows, deals all rows into cells; each cell is cut
into blocks of bounded size, rows of a table, and each block holds a vantage-point tree of its own rows. A leaf knows between which
distances its rows lie from each vantage point of its block. Blocks of a cell follow the ids, so a vector that a third of all rows
share fills many blocks and tasks.

Search: queries go to the tasks in blocks of a bounded number. In a block of the index a query visits leaves nearest first, leaves out those
wholly inside the annulus or beyond it, and stops at the first leaf that can't hold a better row than the k-th of every window. The first pass
visits each query's home cell alone; its k-th score then bounds the second pass over all others. Distances only choose what to
visit, with slack; scores are exact integers, so the result is that of a full comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docket.llm.common import removed, written_at
from docket.llm.vectors import finite, floors, packed, products, unpacked

LEAST, MOST = -(1 << 62), 1 << 62
BLOCK = pa.schema([("cell", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("x", pa.binary()), ("starts", pa.binary()), ("vps", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary())])
BLOCK_SQL = "cell int, ids binary, labels binary, x binary, starts binary, vps binary, lo binary, hi binary"
FOUND = pa.schema([("q", pa.int64()), ("p", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])
FOUND_SQL = "q long, p long, score long, id long"


def labelled_vectors(vectors: DataFrame, size: int, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, x, norm) of the rows that take part; norm is the squared norm of the integer vector x."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("x", pa.binary()), ("norm", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = finite(batch.column(2), size)
            x = floors(x, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), packed(x), pa.array((x * x).sum(1))], schema=schema)

    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return picked.where("vec_id is not null and label is not null").mapInArrow(of, "vec_id long, label long, x binary, norm long")


def augmented(x: np.ndarray, largest: int) -> np.ndarray:
    """x as doubles with the component that makes all norms equal."""
    return np.concatenate([x, np.sqrt(np.maximum(largest - (x * x).sum(1), 0))[:, None]], 1).astype(np.float64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None], 0))


def vantage(points: np.ndarray) -> int:
    """A point at the edge: the farthest from the mean, the first one on ties."""
    return int(distances(points, points.mean(0)[None])[:, 0].argmax())


class Top:
    """The tree that deals rows into cells: vantage points and median distances in heap order."""

    def __init__(self, sample: np.ndarray, depth: int, width: int):
        self.depth, inner = depth, (1 << depth) - 1
        self.points, self.cuts = np.zeros((inner, width)), np.full(inner, np.inf)
        parts = {0: np.arange(len(sample))}
        for node in range(inner):
            own = parts.pop(node)
            if len(own) < 2:
                parts[2 * node + 1], parts[2 * node + 2] = own, own[:0]  # the cut at infinity keeps all rows on the inner side
                continue
            own_points = sample[own]
            self.points[node] = own_points[vantage(own_points)]
            d = distances(own_points, self.points[node : node + 1])[:, 0]
            self.cuts[node] = np.median(d)
            parts[2 * node + 1], parts[2 * node + 2] = own[d <= self.cuts[node]], own[d > self.cuts[node]]

    def cells(self, a: np.ndarray) -> np.ndarray:
        node = np.zeros(len(a), np.int64)
        for _ in range(self.depth):
            d = np.sqrt(((a - self.points[node]) ** 2).sum(1))
            node = 2 * node + 1 + (d > self.cuts[node])
        return node - ((1 << self.depth) - 1)


def tree(a: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, vps, lo, hi): rows in leaf order, first row of each leaf, vantage rows, and between which distances a leaf's rows lie from each."""
    order, ends, vps = np.arange(len(a)), [0, len(a)], []
    while ends[1] - ends[0] > leaf:
        cuts = [0]
        for s, e in zip(ends, ends[1:]):
            own = a[order[s:e]]
            vp = order[s + vantage(own)]
            vps.append(vp)
            order[s:e] = order[s:e][np.argsort(distances(own, a[vp : vp + 1])[:, 0], kind="stable")]
            cuts += [(s + e + 1) // 2, e]
        ends = cuts
    starts, vps = np.array(ends[:-1]), np.array(vps, np.int64)
    if not len(vps):
        return order, starts, vps, np.zeros((1, 0)), np.zeros((1, 0))
    d = distances(a[order], a[vps])
    place = np.empty(len(a), np.int64)
    place[order] = np.arange(len(a))
    return order, starts, place[vps], np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)


def index_blocks(rows: DataFrame, top: Top, largest: int, size: int, block_rows: int, leaf: int) -> DataFrame:
    """The index: one row per block, which holds at most ``block_rows`` rows of one cell."""
    schema = pa.schema([("cell", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int64()), ("x", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(top.cells(augmented(unpacked(b.column(2), size), largest)), pa.int32()), *b.columns[:3]], schema=schema)

    def block(cell: int, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        order, starts, vps, lo, hi = tree(augmented(x, largest), leaf)
        parts = [ids[order].astype("<i8"), labels[order].astype("<i8"), x[order].astype("<i4"), starts.astype("<i4"), vps.astype("<i4"), lo.astype("<f8"), hi.astype("<f8")]
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in parts)], schema=BLOCK)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            new = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), unpacked(b.column(3), size)]
            held = new if held is None else [np.concatenate(v) for v in zip(held, new)]
            while len(held[0]):
                n = int(np.searchsorted(held[0], held[0][0], "right"))  # rows of the first cell
                if n == len(held[0]) and n < block_rows:
                    break  # more of them may follow
                n = min(n, block_rows)
                yield block(int(held[0][0]), *(v[:n] for v in held[1:]))
                held = [v[n:] for v in held]
        if held is not None and len(held[0]):
            yield block(int(held[0][0]), *held[1:])

    dealt = rows.mapInArrow(deal, "cell int, vec_id long, label long, x binary")
    return dealt.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id").mapInArrow(build, BLOCK_SQL)


def best(pool: tuple[np.ndarray, np.ndarray], his: np.ndarray, k: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """The pool in order of score and id, where each window begins in it, and the k-th score of each window or LEAST."""
    score, ids = pool
    order = np.lexsort((ids, -score))
    score, ids = score[order], ids[order]
    begins = np.searchsorted(-score, -his, "left")
    last = begins + k - 1
    kth = np.where(last < len(score), score[np.minimum(last, len(score) - 1)] if len(score) else LEAST, LEAST)
    return (score, ids), begins, kth


def nearest_first(x: np.ndarray, ids: np.ndarray, fits: np.ndarray, ends: np.ndarray, near: np.ndarray, far: np.ndarray, query: np.ndarray, his: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window, scores, ids) of the first k fitting rows of each window, best first, of one block.

    near and far hold the highest and lowest score that a leaf's rows can have; fits tells which rows count; a row of a window scores at
    most his and at least ``least``.
    """
    pool, bound, most = (np.zeros(0, np.int64), np.zeros(0, np.int64)), int(least.min()), int(his.max())
    for leaf in np.argsort(-near, kind="stable"):
        if near[leaf] < bound:
            break
        if far[leaf] > most:
            continue
        s, e = ends[leaf], ends[leaf + 1]
        score = products(x[s:e], query[None])[:, 0]
        good = fits[s:e] & (score >= bound) & (score <= most)
        if good.any():
            pool, begins, kth = best((np.concatenate([pool[0], score[good]]), np.concatenate([pool[1], ids[s:e][good]])), his, k)
            use = np.zeros(len(pool[0]), bool)
            for b in begins:
                use[b : b + k] = True
            pool = (pool[0][use], pool[1][use])
            bound = int(np.maximum(least, kth).min())
    if len(pool[0]):
        pool, begins, _ = best(pool, his, k)
        for w, b in enumerate(begins):
            keep = pool[0][b : b + k] >= least[w]
            if keep.any():
                yield w, pool[0][b : b + k][keep], pool[1][b : b + k][keep]


def scan(queries: Callable[[], dict[str, np.ndarray]], top: Top, largest: int, size: int, same: bool, k: int, home: bool) -> Callable:
    """Index blocks to the first k rows of each query and window: in the home cell of each query only, or everywhere else.

    A query has label, vector x and windows (p, hi, least) between places at[i] and at[i + 1].
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries()
        aq = np.concatenate([q["x"], np.zeros((len(q["x"]), 1))], 1).astype(np.float64)
        norm = (q["x"] * q["x"]).sum(1)
        cells, slack = top.cells(aq), 1e-6 + 1e-9 * (float(norm.max()) + largest)
        for batch in batches:
            for row in batch.to_pylist():
                own = np.flatnonzero((cells == row["cell"]) == home)
                if not len(own):
                    continue
                ids, labels, starts = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), np.frombuffer(row["starts"], "<i4")
                x, ends = np.frombuffer(row["x"], "<i4").reshape(-1, size).astype(np.int64), np.append(starts, len(ids))
                lo, hi = (np.frombuffer(row[c], "<f8").reshape(len(starts), -1) for c in ("lo", "hi"))
                points = augmented(x[np.frombuffer(row["vps"], "<i4")], largest)
                own_labels = set(np.unique(labels).tolist())
                outs = []
                for part in np.array_split(own, len(own) // 2000 + 1):
                    d = distances(aq[part], points)[:, None]
                    least_d, most_d = (np.maximum(d - hi, lo - d).max(2).clip(0), (d + hi).min(2)) if len(points) else (np.zeros((len(part), 1)), np.full((len(part), 1), np.inf))
                    scores = (norm[part] + largest)[:, None]
                    near, far = (scores - least_d**2) / 2 + slack, (scores - most_d**2) / 2 - slack
                    for j, i in enumerate(part):
                        a, b = q["at"][i], q["at"][i + 1]
                        label = int(q["label"][i])
                        if a == b or near[j].max() < q["least"][a:b].min() or (label not in own_labels if same else own_labels == {label}):
                            continue
                        for w, score, found in nearest_first(x, ids, (labels == label) == same, ends, near[j], far[j], q["x"][i], q["hi"][a:b], q["least"][a:b], k):
                            outs.append((np.full(len(score), q["q"][i]), np.full(len(score), q["p"][a + w]), score, found))
                if outs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*outs)], schema=FOUND)

    return of


def first_k(found: DataFrame, k: int) -> DataFrame:
    """The k rows of highest score, smaller id first, of each query and window, with their rank."""
    order = Window.partitionBy("q", "p").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, top: Top, largest: int, size: int, same: bool, k: int, query_block: int) -> tuple[DataFrame, list[str]]:
    """(q, p, score, id, rank): the first k rows of each window of each query (q, label, x, windows of p, hi, lo), and the folders written."""
    spark: SparkSession = index.sparkSession
    total, parts, paths = queries.count(), [], []
    blocks = max(1, -(-total // query_block))
    for b in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not some.num_rows:
            continue
        windows = some.column("windows").combine_chunks()
        flat = windows.flatten()
        q = {"q": some.column("q").to_numpy(), "label": some.column("label").to_numpy(), "x": unpacked(some.column("x").combine_chunks(), size), "at": np.concatenate([[0], np.cumsum(np.diff(windows.offsets.to_numpy()))])}
        q |= {n: flat.field(f).to_numpy(zero_copy_only=False) for n, f in (("p", "p"), ("hi", "hi"), ("least", "lo"))}
        sent = spark.sparkContext.broadcast(q)
        first, path = written_at(index.mapInArrow(scan(lambda s=sent: s.value, top, largest, size, same, k, True), FOUND_SQL), "home")
        paths.append(path)
        kth = first_k(first, k).where(F.col("rank") == k).select("q", "p", "score").toPandas()  # at most one row per window of the block
        known = dict(zip(zip(kth.q, kth.p), kth.score))
        owner = np.repeat(q["q"], np.diff(q["at"]))
        q2 = q | {"least": np.array([max(int(v), known.get((o, p), LEAST)) for o, p, v in zip(owner, q["p"], q["least"])], np.int64)}
        sent2 = spark.sparkContext.broadcast(q2)
        second, path = written_at(index.mapInArrow(scan(lambda s=sent2: s.value, top, largest, size, same, k, False), FOUND_SQL), "others")
        paths.append(path)
        parts.append(first.unionByName(second))
        sent.unpersist()
        sent2.unpersist()
    if not parts:
        return spark.createDataFrame([], FOUND_SQL + ", rank int"), paths
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return first_k(every, k), paths


def mine_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, every: int = 100, size: int = 64, scale: int = 256,
    block_rows: int = 4096, leaf: int = 128, most_sample: int = 20_000, most_depth: int = 10, query_block: int = 10_000,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank int, negative_id, positive_score, negative_score, for each anchor and positive.

    Rows take part if their id and label are not null and their vector has ``size`` components, none null or non-finite; components become
    floor(scale * x). Anchors are the rows whose id is divisible by ``every``; positives are the first ``positives`` other rows of
    the anchor's label by inner product, smaller id first on ties; negatives the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. A negative positive_score has an empty window. All rows are indexed and
    searched without loss; only the shape of the top tree comes from a sample of at most ``most_sample`` rows. Rows that repeat an id are rows
    of their own (each copy is an anchor; a copy is another row's positive). Without rows or anchors the result is empty. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, rows_path = written_at(labelled_vectors(vectors, size, scale, id_col, vector_col, label_col), "labelled")
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n, largest = rows.agg(F.count("*"), F.max("norm")).first()
    if not n:
        return spark.createDataFrame([], names)
    share = min(1.0, 1.5 * most_sample / n)
    picked = rows.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 30)) < int(share * (1 << 30))).select("x", F.xxhash64("x", "vec_id").alias("h"))
    sample = picked.orderBy("h", "x").limit(most_sample).select("x").toArrow().column(0).combine_chunks()
    depth = int(min(most_depth, max(0, np.ceil(np.log2(n / block_rows)))))
    top = Top(augmented(unpacked(sample, size), largest), depth, size + 1)
    index, path = written_at(index_blocks(rows, top, largest, size, block_rows, leaf), "index")
    anchors, path2 = written_at(rows.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("q"), "vec_id", "label", "x", "norm"), "anchors")
    removed(spark, rows_path)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("p"), F.lit(MOST).alias("hi"), F.lit(LEAST).alias("lo")))
    near, more = search(index, anchors.select("q", "label", "x", whole.alias("windows")), top, largest, size, True, positives + 1, query_block)
    # the anchor itself is one of its label's rows: one row of its id and score goes, whichever of equal copies
    own = Window.partitionBy("q").orderBy(F.desc((F.col("id") == F.col("vec_id")) & (F.col("score") == F.col("norm"))), "rank")
    others = near.join(anchors.select("q", "vec_id", "norm"), "q").withColumn("self", (F.row_number().over(own) == 1) & (F.col("id") == F.col("vec_id")) & (F.col("score") == F.col("norm")))
    ranked = others.where(~F.col("self")).withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where(F.col("place") <= positives)
    chosen, path3 = written_at(ranked.select("q", F.col("vec_id").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("p")), "positives")
    ends = F.struct(F.col("p"), F.expr(f"(p * {high} - pmod(p * {high}, 100)) div 100").alias("hi"), F.expr(f"(p * {low} + pmod(-p * {low}, 100)) div 100").alias("lo"))
    windows = chosen.where("p >= 0").select("q", ends.alias("w")).groupBy("q").agg(F.sort_array(F.collect_set("w")).alias("windows"))  # at most ``positives`` a query
    far, most = search(index, anchors.select("q", "label", "x").join(windows, "q"), top, largest, size, False, negatives, query_block)
    mined = chosen.join(far, ["q", "p"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"))
    result, _ = written_at(mined, "negatives")
    for folder in [path, path2, *more, path3, *most]:
        removed(spark, folder)
    return result
