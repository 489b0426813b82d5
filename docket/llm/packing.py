"""Packing of token sequences into fixed windows by best-fit decreasing.

Documents are tokenised and packed by the task that reads them, CHUNK_IDS ids at a time, so memory is bounded and nothing is
shuffled or gathered. Overlong documents are first cut into full windows; what is left of each is one
piece. Pieces of one length are interchangeable, so best-fit decreasing runs on a chunk's histogram of lengths, with
a segment tree indexed by remaining capacity that finds the tightest open window. The pieces of windows that it
leaves less than 99 % full go on to the next chunk; only a task's last chunk ends with them. Tasks number their windows from 0, and a
running sum over tasks (one number each) makes the numbers those of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docket.llm.common import slices, texts, written
from docket.llm.tokens import default_vocabulary, encoder

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, part int, turn long, offset long"
CHUNK_IDS = 4 << 20


class OpenWindows:
    """How many windows are open at each remaining capacity; finds the tightest that still fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def _add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.tree[at] += n
            at //= 2

    def put(self, capacity: int, first: int, n: int) -> None:
        if n and capacity:
            self.ranges.setdefault(capacity, []).append((first, n))
            self._add(capacity, n)

    def take(self, capacity: int) -> tuple[int, int]:
        first, n = self.ranges[capacity].pop()
        self._add(capacity, -n)
        return first, n

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least ``need`` that an open window has."""
        at = need + self.leaves
        if self.tree[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_rules(counts: dict[int, int], window: int) -> list[tuple]:
    """Best-fit decreasing over a histogram of piece lengths.

    A rule (length, first, past, sequence_id, per, offset) says: the piece of this length and rank r,
    first <= r < past, goes to window sequence_id + (r - first) // per, at offset + (r - first) % per * length.
    """
    opened, rules, windows = OpenWindows(window), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = opened.tightest(length)
            if capacity is None:
                capacity, per = window, window // length
                first, n = windows, -(-left // per)
                windows += n
            else:
                first, n = opened.take(capacity)
                per = capacity // length
            used = min(left, n * per)
            rules.append((length, rank, rank + used, first, per, window - capacity))
            full, part = divmod(used, per)
            opened.put(capacity - per * length, first, full)
            if part:
                opened.put(capacity - part * length, first + full, 1)
            touched = full + bool(part)
            opened.put(capacity, first + touched, n - touched)
            rank, left = rank + used, left - used
    return rules


class Packer:
    """Packs the pieces of one task, about ``most`` ids at a time; windows that are not nearly full wait for more pieces.

    What waits is at most half of ``most``, whatever the lengths are: beyond that the fullest windows go as they are. So each call
    that ``most`` ids called for places half of them, and packing all takes no more than twice the ids.
    """

    def __init__(self, window: int, part: int, most: int = CHUNK_IDS):
        self.window, self.part, self.most = window, part, most
        self.rows: list[tuple] = []  # doc_id, start, length, ids, doc_tokens
        self.held = self.next = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        for start in range(0, n, self.window):
            length = min(self.window, n - start)
            self.rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], n))
            self.held += length

    def placed(self, last: bool) -> Iterator[tuple]:
        """Rows with part, window of the part and offset. What stands in a window less than 99 % full stays for the next call, unless it is the last or too much stays."""
        by_length: dict[int, list[int]] = {}
        for k, row in enumerate(self.rows):
            by_length.setdefault(row[2], []).append(k)
        windows: dict[int, list[tuple[int, int]]] = {}
        for length, first, past, sequence, per, offset in best_fit_rules({n: len(x) for n, x in by_length.items()}, self.window):
            for r, k in enumerate(by_length[length][first:past]):
                windows.setdefault(sequence + r // per, []).append((k, offset + r % per * length))
        used = {w: sum(self.rows[k][2] for k, _ in pieces) for w, pieces in windows.items()}
        loose = {w: n for w, n in used.items() if not last and 100 * n < 99 * self.window}
        stays = sum(loose.values())
        for w in sorted(loose, key=lambda w: -used[w]):
            if 2 * stays <= self.most:
                break
            stays -= loose.pop(w)
        for w, pieces in windows.items():
            if w not in loose:
                for k, offset in pieces:
                    yield (*self.rows[k], self.part, self.next, offset)
                self.next += 1
        self.rows, self.held = [self.rows[k] for w in loose for k, _ in windows[w]], stays


def pieces_in_place(docs: DataFrame, window: int, vocabulary: str | None, end_id: int, chunk_ids: int) -> DataFrame:
    """Tokenise, cut and pack, all in the task that reads a document."""
    path = vocabulary or default_vocabulary()
    end = end_id.to_bytes(4, "little")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("turn", pa.int64()), ("offset", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId(), chunk_ids)

        def full(last: bool) -> Iterator[pa.RecordBatch]:
            rows = packer.placed(last)
            while some := list(islice(rows, 5000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

        for batch in batches:
            for some in slices(batch, 5000):
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder(path).encode(some.column(1))):
                    packer.add(doc_id, ids + end)
                if packer.held >= chunk_ids:
                    yield from full(False)
        yield from full(True)

    return docs.mapInArrow(cut, PIECE)


def pack(
    docs: DataFrame,
    window: int = 1024,
    vocabulary: str | None = None,
    end_id: int = 0,
    chunk_ids: int = CHUNK_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset.

    A document is the ids of its whole text and then ``end_id``; a null or empty text is the end id
    alone. Each id lies in exactly one piece. Sequence ids run from 0 without gaps, offsets
    within a sequence too. Repeated rows are packed each, rows without an id too; other columns are ignored; an empty
    table gives no pieces.
    """
    pieces = written(pieces_in_place(texts(docs, id_col, text_col), window, vocabulary, end_id, chunk_ids), "pieces")
    sizes = pieces.groupBy("part").agg((F.max("turn") + 1).alias("n"))  # one row per task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    placed = pieces.join(bases, "part")
    return placed.select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("base") + F.col("turn")).alias("sequence_id"), "offset")


def with_padding(pieces: DataFrame, window: int = 1024) -> DataFrame:
    """Adds padded_length: the window, or the used length itself where that is a power of two."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    power = F.expr("used & (used - 1)") == 0
    return pieces.join(used.select("sequence_id", F.when(power, F.col("used")).otherwise(window).alias("padded_length")), "sequence_id")
