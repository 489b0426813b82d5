"""Removal of byte strings that occur elsewhere in a corpus, by a hash-compared suffix sort around shared anchors.

Every window of ``length`` bytes picks one of its k-grams by content alone (the least mixed rolling hash), so equal windows pick
the same k-gram at the same place. Only picked k-grams (anchors) that occur in two places or more are looked at further. The occurrences
of an anchor meet in one task with the bytes of their windows. There the suffixes from the anchor are sorted by mergesort
whose comparisons take logarithmic time: prefix polynomial hashes and binary search find the common extension of two suffixes,
and the next byte decides. Windows recur where the extensions to the right and to the left of an anchor together span ``length``;
all extensions that count are compared byte by byte afterwards, so a hash collision cannot remove anything.

Copies of a whole text, compared byte by byte, take part once, and are removed whole.

No task gets more than ``most`` different stretches of bytes around an anchor. Where an anchor has more occurrences, equal stretches are
collapsed by grouping on their bytes, map-side first (all that share one recur as a whole), and if more than
``most`` different ones are left, their windows are parted by the place of the anchor within, WAYS at a time, and
by the bytes that all windows of a part have in common; then the same again. A part ends as windows of one place and one content,
so however common a passage is, its inner parts collapse and only the parts that its ends run through go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docket.llm.common import slices, texts, written

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
PIECE = 1 << 19  # bytes whose anchors are picked at a time; places within fit 20 bits
CHUNK = 3 << 20  # bytes of windows that a task sorts at a time
MOST = 20_000  # stretches of one anchor that a task sorts: some 13 MB
WAYS = 8
SALTS = 16


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, U)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    size = 1 << max(20, int(n).bit_length())
    p, q = _powers(size)
    return p[:n], q[:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * base^place: (s[j] - s[i]) * base^-i is the hash of data[i:j]."""
    s = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data))[0], out=s[1:])
    return s


def anchors(raw: bytes, length: int, k: int, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hash, place, first and last window start of each picked k-gram; one that is picked on both sides of a piece's border comes once for each."""
    for begin in range(0, len(raw) - length + 1, piece):
        data = np.frombuffer(raw, np.uint8, min(piece + length - 1, len(raw) - begin), begin)
        n, w = len(data) - k + 1, length - k + 1
        s = prefix(data)
        h = (s[k:] - s[:-k]) * powers(n)[1]
        h ^= h >> U(31)
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(29)
        v = (h & ~U(0xFFFFF)) | np.arange(n, dtype=U)
        pad = np.concatenate([v, np.full(-n % w, ~U(0))]).reshape(-1, w)
        left = np.minimum.accumulate(pad, 1).ravel()
        right = np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(right[: n - w + 1], left[w - 1 : n]) & U(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        at = place[first]
        yield h[at].view(np.int64), at + begin, first + begin, last + begin


class Occurrences:
    """Occurrences of anchors with the bytes of their windows, sorted by anchor."""

    def __init__(self, group: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, segments: list[bytes], length: int):
        self.length, self.n = length, len(group)
        self.data = np.frombuffer(b"".join(segments), np.uint8)
        sizes = np.array([len(x) for x in segments])
        start = np.cumsum(sizes) - sizes
        self.lo = place - first  # bytes to the left of the anchor
        self.hi = last + length - place  # and to the right
        self.least = place - last  # offsets of the anchor in its windows: least .. lo
        self.p = start + self.lo
        self.s, self.inv = prefix(self.data), powers(len(self.data) + 1)[1]
        new = np.concatenate([[True], group[1:] != group[:-1]])
        self.g0 = np.flatnonzero(new)[np.cumsum(new) - 1]
        self.gn = np.diff(np.append(np.flatnonzero(new), self.n))[np.cumsum(new) - 1]

    def _same(self, x, y, n):
        return (self.s[x + n] - self.s[x]) * self.inv[x] == (self.s[y + n] - self.s[y]) * self.inv[y]

    def extension(self, i, j, leftwards=False):
        """Length of the common extension of two anchors, by binary search on hashes."""
        x, y = self.p[i], self.p[j]
        low = np.zeros(len(x), np.int64)
        high = np.minimum(self.lo[i], self.lo[j]) if leftwards else np.minimum(self.hi[i], self.hi[j])
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = self._same(x - mid, y - mid, mid) if leftwards else self._same(x, y, mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def less(self, i, j):
        n = self.extension(i, j)
        ended = (n == self.hi[i]) | (n == self.hi[j])
        last = len(self.data) - 1
        return np.where(ended, self.hi[i] < self.hi[j], self.data[np.minimum(self.p[i] + n, last)] < self.data[np.minimum(self.p[j] + n, last)])

    def sorted(self) -> np.ndarray:
        """Mergesort of each group's suffixes; groups stay where they are. All merges of a level run together."""
        order, width, widest = np.arange(self.n), 1, int(self.gn.max(initial=1))
        while width < widest:
            q = np.flatnonzero(self.gn > width)
            local = q - self.g0[q]
            run = local // width
            other = self.g0[q] + (run ^ 1) * width
            end = np.minimum(other + width, self.g0[q] + self.gn[q])
            low, high = other.copy(), np.maximum(end, other)
            item, right = order[q], run % 2 == 1
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                a, b = order[mid], item[open_]
                r = right[open_]
                before = np.where(r, ~self.less(b, a), self.less(a, b))
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            to = self.g0[q] + run // 2 * 2 * width + local % width + (low - other)
            order[to] = item
            width *= 2
        return order

    def verified(self, i, j, left, right):
        """The extensions as the bytes have them."""
        n = left + right
        flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, y = np.repeat(self.p[i] - left, n) + flat, np.repeat(self.p[j] - left, n) + flat
        bad = np.flatnonzero(self.data[x] != self.data[y])
        for k in np.unique(np.repeat(np.arange(len(n)), n)[bad]).tolist() if len(bad) else ():
            a, b = int(self.p[i[k]]), int(self.p[j[k]])
            u, v = self.data[a : a + right[k]], self.data[b : b + right[k]]
            right[k] = int(np.argmax(np.append(u != v, True)))
            u, v = self.data[a - left[k] : a][::-1], self.data[b - left[k] : b][::-1]
            left[k] = int(np.argmax(np.append(u != v, True)))
        return left, right

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(occurrence, least offset, greatest offset) of runs of windows that recur in the group."""
        order, length = self.sorted(), self.length
        pair = np.flatnonzero(self.g0[:-1] == self.g0[1:])
        i, j = order[pair], order[pair + 1]
        right, left = self.extension(i, j), self.extension(i, j, True)
        lcp = np.zeros(self.n, np.int64)  # with the one before in order
        lcp[pair + 1] = right
        left, right = self.verified(i, j, left.copy(), right.copy())
        who, low, high = [np.concatenate([i, j])], [np.concatenate([length - right] * 2)], [np.concatenate([left] * 2)]
        low[0], high[0] = np.maximum(low[0], self.least[who[0]]), np.minimum(high[0], self.lo[who[0]])
        done = np.zeros(self.n, bool)
        done[who[0][(low[0] == self.least[who[0]]) & (high[0] == self.lo[who[0]])]] = True
        todo = np.zeros(self.n, bool)
        todo[self.g0[np.flatnonzero(~done & (self.gn > 2))]] = True
        e = np.flatnonzero(todo[self.g0])  # places in order, of groups that neighbours did not settle
        if len(e):
            occ = order[e]
            found: list[np.ndarray] = []
            edge = self.g0[e] == e
            for d in range(int(self.least[occ].min()), int(self.lo[occ].max()) + 1):
                block = np.cumsum(edge | (lcp[e] < length - d)).astype(U)
                on = np.flatnonzero((self.least[occ] <= d) & (self.lo[occ] >= d))
                p = self.p[occ[on]]
                key = ((self.s[p] - self.s[p - d]) * self.inv[p - d] + U(1)) * U(0x94D049BB133111EB) ^ block[on] * U(BASE)
                by = np.argsort(key, kind="stable")
                twin = np.flatnonzero(key[by][1:] == key[by][:-1])
                a, b = occ[on[by[twin]]], occ[on[by[twin + 1]]]
                found.append(np.stack([np.concatenate([a, b]), np.concatenate([b, a])], 1))
            twins = np.unique(np.concatenate(found), axis=0)
            i, j = twins[:, 0], twins[:, 1]
            left, right = self.verified(i, j, self.extension(i, j, True), self.extension(i, j))
            who.append(i)
            low.append(np.maximum(length - right, self.least[i]))
            high.append(np.minimum(left, self.lo[i]))
        who, low, high = np.concatenate(who), np.concatenate(low), np.concatenate(high)
        good = low <= high
        return who[good], low[good], high[good]


def text_anchors(raw: bytes, length: int, k: int, piece: int) -> list[np.ndarray]:
    """anchors() of a whole text; the ranges of a k-gram from both sides of a piece's border adjoin and become one."""
    parts = list(anchors(raw, length, k, piece))
    if not parts:
        return []
    hashes, place, first, last = (np.concatenate(c) for c in zip(*parts))
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return [hashes[start], place[start], first[start], last[np.append(start[1:], len(place)) - 1]]


def _batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _semi(rows: DataFrame, keys: DataFrame, on: list[str], spread: Column) -> DataFrame:
    """Semi-join in which the rows of one key are spread over SALTS tasks."""
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(keys.select(*on, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), [*on, "salt"], "left_semi").drop("salt")


def identified(rows: DataFrame, content_hash: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with t, equal only for texts of equal bytes, and (t, copies, rep, rows_of_an_id) per distinct text.

    t is a hash; texts that share one are told apart by grouping on the bytes, and those that differ get a number after it.
    """
    each = lambda r: r.groupBy("t", "doc_id").agg(F.count("*").alias("n"))
    kinds_of = lambda r: written(each(r).groupBy("t").agg(F.sum("n").alias("copies"), F.min("doc_id").alias("rep"), F.max("n").alias("rows_of_an_id")), "texts")
    rows = rows.withColumn("t", content_hash(F.col("text")))
    kinds = kinds_of(rows)
    same = written(_semi(rows, kinds.where("copies > 1"), ["t"], F.col("doc_id")).groupBy("t", "text").agg(F.count("*").alias("n")), "same")
    clash = same.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t")
    if not clash.isEmpty():
        number = F.row_number().over(Window.partitionBy("t").orderBy("text"))
        apart = written(same.join(clash, "t", "left_semi").select("t", "text", number.alias("number")), "apart")
        rows = rows.join(apart, ["t", "text"], "left").select("doc_id", "text", F.when(F.col("number").isNull(), F.col("t")).otherwise(F.concat("t", F.encode(F.format_string("/%d", "number"), "UTF-8"))).alias("t"))
        kinds = kinds_of(rows)
    return rows, kinds


def parted(hot: DataFrame, length: int, k: int, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """For stretches of anchors with many occurrences: spans of those that recur as a whole, and groups of at most ``most`` to be sorted.

    A row is a range of windows: key, t, first (start of the bytes in the text), lo and least (greatest and least place of the
    anchor within a window), bytes. Windows of one key have anchors at places a .. b, and so bytes in common.
    """
    level, spans, groups, width = hot.withColumns({"a": F.lit(0), "b": F.lit(length - k)}), [], [], length - k + 1
    what = ["key", "lo", "least", "bytes"]
    while True:
        level = written(level, "level")
        kinds = written(level.groupBy(*what).agg(F.count("*").alias("n"), F.min(F.struct("t", "first")).alias("of"), F.min("a").alias("a"), F.min("b").alias("b")), "kinds")
        all_of_it = _semi(level, kinds.where("n > 1"), what, F.xxhash64("t", "first"))
        spans.append(all_of_it.select("t", F.col("first").alias("a"), (F.col("first") + F.col("lo") - F.col("least") + length).alias("b")))
        sizes = written(kinds.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
        rest = kinds.join(sizes, "key").select("key", "of.t", "of.first", "lo", "least", "bytes", "a", "b", "m")
        fits = F.lit(width == 1) | (F.col("m") <= most)  # of one place and one content: only texts of equal hashes differ
        groups.append(rest.where(fits).select(F.col("key").alias("anchor"), "t", (F.col("first") + F.col("lo")).alias("place"), "first", (F.col("first") + F.col("lo") - F.col("least")).alias("last"), "bytes"))
        if width == 1 or sizes.where(F.col("m") > most).isEmpty():
            return spans, groups
        width = -(-width // WAYS)
        part = F.explode(F.transform(F.sequence(F.lit(0), F.lit(WAYS - 1)), lambda i: F.struct((F.col("a") + i * width).alias("a"), F.least(F.col("a") + (i + 1) * width - 1, F.col("b")).alias("b"))))
        cut = rest.where(~fits).select("*", part.alias("p")).withColumns({"hi": F.least("lo", "p.b"), "low": F.greatest("least", "p.a")}).where("low <= hi and p.a <= p.b")
        common = F.substring(F.col("bytes"), F.col("lo") - F.col("p.a") + 1, F.col("p.a") - F.col("p.b") + length)
        level = cut.select(
            F.xxhash64("key", "p.a", "p.b", common).alias("key"), "t", (F.col("first") + F.col("lo") - F.col("hi")).cast("int").alias("first"),
            F.col("hi").alias("lo"), F.col("low").alias("least"), F.substring(F.col("bytes"), F.col("lo") - F.col("hi") + 1, F.col("hi") - F.col("low") + length).alias("bytes"), "p.a", "p.b",
        )


def repeated_spans(rows: DataFrame, kinds: DataFrame, length: int, k: int, most: int, chunk: int, piece: int) -> DataFrame:
    """For rows (doc_id, text, t) and their distinct texts: the byte spans (t, a, b) that recur."""
    pick = pa.schema([("t", pa.binary()), ("anchor", pa.int64()), ("place", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                parts = []
                for t, text in zip(some.column(0).to_pylist(), some.column(1)):
                    if found := text_anchors(text.as_py().encode(), length, k, piece):
                        parts.append(([t] * len(found[0]), *found))
                if parts:
                    cols = list(zip(*parts))
                    yield _batch(pick, [t for x in cols[0] for t in x], *(np.concatenate(c) for c in cols[1:]))

    long_enough = rows.where(F.octet_length("text") >= length)  # copies of a text have the same anchors at the same places
    all_anchors = written(long_enough.select("t", "text").mapInArrow(picked, "t binary, anchor long, place int, first int, last int"), "anchors")
    where = F.xxhash64("t", "place")
    twice = all_anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min(where).alias("x"), F.max(where).alias("y")).where("x <> y")
    twice = written(twice.select("anchor", (F.col("n") > most).alias("hot")), "twice")
    per_text = all_anchors.join(twice, "anchor").groupBy("t").agg(F.collect_set(F.struct("anchor", "place", "first", "last", "hot")).alias("spots"))
    one = per_text.join(kinds.where("rows_of_an_id = 1").select(F.col("t").alias("u"), "rep"), F.col("t") == F.col("u")).select("u", "rep", "spots")
    joined = long_enough.join(one, (F.col("t") == F.col("u")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("t", "text", "spots")
    if not (again := kinds.where("rows_of_an_id > 1")).isEmpty():
        joined = joined.union(_semi(long_enough, again, ["t"], F.spark_partition_id()).select("t", "text").distinct().join(per_text, "t").select("t", "text", "spots"))
    seg = pa.schema([("anchor", pa.int64()), ("t", pa.binary()), ("place", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("hot", pa.bool_()), ("bytes", pa.binary())])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, text, spots in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = text.as_py().encode()
                spots = spots.as_py()
                for at in range(0, len(spots), 5000):
                    some = spots[at : at + 5000]
                    yield _batch(seg, *([s[c] for s in some] if c != "t" else [t] * len(some) for c in ("anchor", "t", "place", "first", "last", "hot")), [raw[s["first"] : s["last"] + length] for s in some])

    shape = "anchor long, t binary, place int, first int, last int, hot boolean, bytes binary"
    windows = written(joined.select("t", "text", "spots").mapInArrow(segments, shape), "windows")
    span = pa.schema([("t", pa.binary()), ("a", pa.int32()), ("b", pa.int32())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]  # anchor, t, place, first, last, bytes
        size = 0

        def settle(n: int) -> Iterator[pa.RecordBatch]:
            anchor, t, place, first, last, data = (x[:n] for x in held)
            o = Occurrences(np.array(anchor), np.array(place), np.array(first), np.array(last), data, length)
            who, low, high = o.repeated()
            at = np.array(place)[who]
            yield _batch(span, [t[w] for w in who.tolist()], at - high, at - low + length)

        for batch in batches:
            for x, c in zip(held, batch.columns):
                x += c.to_pylist()
            size += batch.column(5).nbytes
            if size >= chunk:
                n = len(held[0]) - 1
                while n and held[0][n - 1] == held[0][-1]:
                    n -= 1
                if n:
                    yield from settle(n)
                    for x in held:
                        del x[:n]
                    size = sum(map(len, held[5]))
        if held[0]:
            yield from settle(len(held[0]))

    # Rows of an anchor come together, and in slices small enough that a task holds little more than one chunk.
    cold, spans = windows.where("not hot").select("anchor", "t", "place", "first", "last", "bytes"), None
    if not twice.where("hot").isEmpty():
        hot = windows.where("hot").select(F.col("anchor").alias("key"), "t", "first", (F.col("place") - F.col("first")).alias("lo"), (F.col("place") - F.col("last")).alias("least"), "bytes")
        whole, groups = parted(hot, length, k, most)
        spans = reduce(DataFrame.union, whole)
        cold = reduce(DataFrame.union, groups, cold)
    found = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "t binary, a int, b int")
    return found if spans is None else found.union(spans)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame, length: int = 400, k: int = 128, most: int = MOST, chunk: int = CHUNK, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text",
    content_hash: Callable[[Column], Column] = lambda text: F.unhex(F.md5(text)),
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, spans (array of start, end) and kept (binary: the bytes that stay).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the corpus, the same text
    included; strings are judged on the input and never cross texts. Texts are UTF-8 bytes; a null text is empty. All rows of
    equal texts of at least ``length`` bytes go whole, repeated rows too. Rows without an id take part like any other; other
    columns are ignored. An empty table gives an empty result. No hash decides alone: ``content_hash`` may collide.
    """
    rows, kinds = identified(texts(docs, id_col, text_col), content_hash)
    spans = repeated_spans(rows, kinds, length, k, most, chunk, piece)
    merged = spans.groupBy("t").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    fate = written(kinds.select("t", "copies").join(merged, "t", "left").where("copies > 1 or spans is not null"), "fate")
    joined = rows.join(fate, "t", "left").select("doc_id", "text", "copies", "spans")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (s for batch in batches for s in slices(batch)):
            out = []
            for doc_id, text, copies, found in zip(*(c.to_pylist() for c in some.columns)):
                raw = text.encode()
                runs = [(0, len(raw))] if (copies or 1) > 1 and len(raw) >= length else merge([(s["a"], s["b"]) for s in found or ()])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((doc_id, len(raw), len(raw) - len(kept), len(runs), [{"start": a, "end": b} for a, b in runs], kept))
            if out:
                yield _batch(schema, *zip(*out))

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
