"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``distance`` bits are linked. The 64 bits are cut into m partitions, correlated bits together,
and partition i gets its own threshold t_i with sum(t_i) = distance - m + 1 (a threshold of -1 leaves
the partition out): two fingerprints within the distance must be within t_i in some partition i. Bits'
agreement and the load of every partition's values are counted over all fingerprints; dynamic
programming then picks thresholds of the least estimated cost, and the m of the least cost wins, so
the plan changes with the corpus. A fingerprint is stored and probed under its partition's value with each
choice of t_i bits masked; fingerprints that meet are compared in full.

Only distinct fingerprints are searched, so copies cost nothing. A signature's members are never
written as pairs: they are compared inside a task in strides and only the links of a spanning forest
leave it. The members of a signature with many of them meet under finer signatures, which add an equal part of the other bits; only
a finer one that still has many members is split into pairs of chunks that go to tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import digest, texts, without, written
from docket.llm.components import components

CHUNK = 2048  # members of a signature that one task compares with as many others
BITS = 64


def fingerprint(text: str, shingle: int = 3) -> int:
    """Bit b is set if over half of the shingles' XXH64 (seed 42) have it; no words: zero."""
    words = text.encode().lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone splits
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    last = ends[shingle - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[s:e], 42) for s, e in zip(starts, last)], "<u8")
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, 4096):
        counts += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", with_digest: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long; also h, the digest of its text, on request."""
    rows = texts(docs, id_col, text_col)
    rows = rows.select("doc_id", "text", digest(F.col("text")).alias("h")) if with_digest else rows
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), *[("h", pa.string())] * with_digest])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], schema=schema)

    return rows.mapInArrow(of, "doc_id long, fp long" + ", h string" * with_digest)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for bits i and j how many have both, counted over all of them."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
        cells = np.arange(BITS * BITS)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(both.ravel().astype(np.int64))], names=["cell", "n"])

    n = fps.count()
    both = np.zeros(BITS * BITS)
    for r in fps.mapInArrow(counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 4096 rows
        both[r.cell] = r.n
    return n, both.reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of about the same size: each is grown from a seed by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    link = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(link, 0)
    free, parts = set(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        rest = sorted(free)
        part = [rest[int(np.argmax(link[np.ix_(rest, rest)].sum(1)))]]
        while len(part) < size:
            rest = sorted(free - set(part))
            part.append(rest[int(np.argmax(link[np.ix_(rest, part)].sum(1)))])
        free -= set(part)
        parts.append(sorted(part))
    return parts


def part_value(fp, bits: list[int]):
    """SQL column of the bits of one partition, the others zero."""
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def plan(fps: DataFrame, distance: int, most_parts: int = 4) -> list[tuple[list[int], int]]:
    """The partitions and thresholds of the least estimated cost."""
    n, both = bit_statistics(fps)
    p = np.diag(both) / max(n, 1)
    agree = p**2 + (1 - p) ** 2
    choices = {m: correlated_parts(n, both, m) for m in range(1, min(most_parts, distance + 1) + 1)}
    flat = [(m, i, part) for m, parts in choices.items() for i, part in enumerate(parts)]
    one = fps.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), part_value(F.col("fp"), part).alias("v")) for k, (_, _, part) in enumerate(flat)))).alias("s"))
    loads = one.groupBy("s.k", "s.v").agg(F.count("*").alias("c")).groupBy("k").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs"))
    measured = {r.k: r.pairs for r in loads.collect()}  # one row per partition tried
    best = None
    for m, parts in choices.items():
        cost = []
        for i, part in enumerate(parts):
            dist = np.zeros(distance + 1)
            dist[0] = 1
            for b in part:  # distribution of the distance of two fingerprints within the partition
                dist = dist * agree[b] + np.concatenate([[0], dist[:-1]]) * (1 - agree[b])
            k = next(j for j, (mm, ii, _) in enumerate(flat) if (mm, ii) == (m, i))
            pairs = max(measured.get(k, 0.0), dist[0] * n * (n - 1) / 2)
            rows, line = 1.0, [0.0]
            for t in range(distance + 1):
                keys = float(len(list(combinations(range(len(part)), t)))) if t <= 3 else float("inf")
                rows = keys * max(n, 1)
                met = pairs * dist[: t + 1].sum() / max(dist[0], 1e-12)
                line.append(rows + 0.05 * met)
            cost.append(line)  # line[t + 1] is the cost of threshold t
        need = distance - m + 1
        table = {0: (0.0, [])}  # sum of thresholds + parts so far -> least cost
        for line in cost:
            step = {}
            for total, (c, chosen) in table.items():
                for t in range(-1, distance + 1):
                    key = total + t + 1
                    if key <= need + m and (key not in step or c + line[t + 1] < step[key][0]):
                        step[key] = (c + line[t + 1], [*chosen, t])
            table = step
        c, chosen = table[need + m]
        if best is None or c < best[0]:
            best = (c, [(part, t) for part, t in zip(parts, chosen) if t >= 0])
    return best[1]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the links (a, b)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            kept.append((x, y))
    return kept


def _links(sig: np.ndarray, side: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by signature; side 0: all with all, 1 and 2: only 1 with 2."""
    a, b, step = [], [], 1
    at = np.arange(len(sig))
    while True:
        at = at[at < len(sig) - step]
        at = at[sig[at] == sig[at + step]]
        if not len(at):
            break
        ok = at[(side[at] != side[at + step]) | (side[at] == 0)]
        near = ok[np.bitwise_count(fp[ok] ^ fp[ok + step]) <= distance]
        near = near[fp[near] != fp[near + step]]
        a.append(fp[near])
        b.append(fp[near + step])
        step += 1
        if sum(map(len, a)) > 200_000:
            kept = np.array(_forest(np.concatenate(a), np.concatenate(b)), np.uint64).reshape(-1, 2)
            a, b = [kept[:, 0]], [kept[:, 1]]
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def links(fps: DataFrame, distance: int = 3, most_parts: int = 4, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs within ``distance`` would."""
    parts = plan(fps, distance, most_parts)
    signatures, free = [], []
    for k, (bits, t) in enumerate(parts):
        for drop in combinations(bits, t):
            held = [b for b in bits if b not in drop]
            signatures.append(F.xxhash64(F.lit(k), F.lit(",".join(map(str, drop))), part_value(F.col("fp"), held)))
            rest = [b for b in range(BITS) if b not in held]
            free += [rest[j :: distance + 1] for j in range(distance + 1)]
    rows = fps.select("fp", F.posexplode(F.array(*signatures)).alias("spec", "sig"))
    load = written(rows.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1"), "load")
    rows = rows.join(load, "sig")
    meeting = rows.where(F.col("n") <= chunk).select("sig", F.lit(0).alias("side"), "fp")
    if not load.where(F.col("n") > chunk).isEmpty():
        # Members of a signature differ in its other bits alone: cut into distance + 1 parts, some part of them is equal.
        masks = F.array(*(part_value(F.lit(-1).cast("long"), bits) for bits in free))
        again = F.explode(F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda j: F.xxhash64("sig", j, F.col("fp").bitwiseAND(F.element_at(masks, F.col("spec") * (distance + 1) + j + 1)))))
        finer = written(rows.where(F.col("n") > chunk).select("fp", again.alias("sig")), "finer")
        finer = finer.join(finer.groupBy("sig").agg(F.ceil(F.count("*") / chunk).cast("int").alias("k"), F.count("*").alias("n")).where("n > 1"), "sig")
        meeting = meeting.union(finer.where("k = 1").select("sig", F.lit(0).alias("side"), "fp"))
        # What is still too large goes in pairs of chunks.
        split = finer.where("k > 1").withColumn("c", F.pmod(F.xxhash64("fp"), F.col("k").cast("long")).cast("int"))
        split = split.select("fp", "sig", "c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("d"))
        meeting = meeting.union(split.select(
            F.xxhash64("sig", F.least("c", "d"), F.greatest("c", "d")).alias("sig"),
            F.when(F.col("c") == F.col("d"), 0).when(F.col("c") < F.col("d"), 1).otherwise(2).alias("side"), "fp",
        ))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last signature, which may go on in the next batch
        for batch in _with_end(batches):
            now = None if batch is None else [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if held is not None and now is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            now = held if now is None else now
            if now is None or not len(now[0]):
                continue
            cut = len(now[0]) if batch is None else int(np.searchsorted(now[0], now[0][-1]))
            held = [x[cut:] for x in now]
            if cut:
                a, b = _links(now[0][:cut], now[1][:cut], np.ascontiguousarray(now[2][:cut]).view(np.uint64), distance)
                kept = np.array(_forest(a, b), np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(kept[:, c]).view(np.int64)) for c in (0, 1)], schema=schema)

    return meeting.repartition("sig").sortWithinPartitions("sig").mapInArrow(meet, "a long, b long")


def _with_end(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    A null text is empty; documents without a word have fingerprint zero and are linked like any other.
    Repeated rows share their fingerprint and so their component. A null id never is a component's id
    unless all its ids are null. An empty table gives an empty result. Whole texts are read, however long; other columns are
    ignored, whatever their names.
    """
    prints = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    return prints.join(grouped(prints, distance), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint of (doc_id, fp)."""
    least = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    groups = components(links(least.select("fp"), distance))
    named = least.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return written(named.select("fp", "component").join(ids, "component").select("fp", "component_id"), "components")


def drop_near_copies(docs: DataFrame, distance: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, but of each group of near-duplicates only those of the smallest id.

    A row goes by its id and its text, so of rows that share an id a text without near copies stays. Rows without an id
    stay only where no near copy has one. Null and empty texts, and all others without a word, are one group.
    Repeated rows of the smallest id all stay. An empty table stays empty; whole texts are read, however long.
    """
    prints = written(fingerprints(docs, shingle, id_col, text_col, True), "fingerprints")
    dropped = prints.join(grouped(prints, distance), "fp").where("not doc_id <=> component_id")
    return without(docs, dropped, id_col, text_col)
