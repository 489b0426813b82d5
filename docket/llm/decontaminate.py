"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number n of distinct word shingles, from one power of two to the next. A partition has
one signature length k for its items, their k smallest shingle hashes (a bottom-k MinHash), and two bounds that it is searched by. A
document that holds ``threshold`` of an item's shingles lacks at most m = floor((1 - threshold) * n) of them, so it holds
k - m of the signature at least; k is m + SPARE for the partition's largest item, and items that fewer hashes point to are no
candidates. A document with fewer shingles than the partition's smallest item needs is not held against
the partition at all. None of this depends on the document's length, so nothing is lost where a fixed-length signature of a
long document would lose it. Documents are scanned once where they lie; candidates are verified by exact shingle
containment on the words themselves.

The index holds only test items. It goes to the tasks in blocks of a bounded number of items and bytes; a
larger benchmark takes more scans, never a larger broadcast.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from math import floor

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from docket.llm.common import texts, written

WORD = re.compile(r"\w+")
ITEMS_PER_SCAN = 20_000
BYTES_PER_SCAN = 16 << 20  # of item texts, on average over the blocks
SPARE = 3
SALT = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word; emptied when it holds 200,000, and after each task, since workers outlive stages."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 200_000:
                self.clear()
            self[word] = value
        return value


HASHES = WordHashes()


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingle_hashes(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, from the words' hashes."""
    if len(hashed) < n:
        return hashed[:0]
    total = np.zeros(len(hashed) - n + 1, np.uint64)
    for k in range(n):
        total = (total ^ hashed[k : len(hashed) - n + 1 + k]) * SALT
        total ^= total >> np.uint64(29)
    return total


def hashed_words(found: list[str]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, found), np.uint64, len(found))


class Partition:
    """Items whose number of distinct shingles lies between two powers of two."""

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: float):
        sizes = [len(h) for _, h in items]
        lacks = lambda n: floor((1 - threshold) * n + 1e-9)
        self.k = lacks(max(sizes)) + SPARE
        self.least = min(sizes) - lacks(min(sizes))  # shingles that a document needs for any of the items
        self.needs, keys = {}, defaultdict(list)
        for (i, hashes), n in zip(items, sizes):
            self.needs[i] = max(1, min(self.k, n) - lacks(n))
            for h in hashes[: self.k].tolist():
                keys[h].append(i)
        self.order, self.items = np.array(sorted(keys), np.uint64), dict(keys)

    def candidates(self, own: np.ndarray) -> list[int]:
        hits: dict[int, int] = defaultdict(int)
        for h in own[np.isin(own, self.order)].tolist():
            for i in self.items[h]:
                hits[i] += 1
        return [i for i, n in hits.items() if n >= self.needs[i]]


class Index:
    """Size partitions of items, by shingle length (``shingle``, or less for items of fewer words)."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, shingle: int):
        self.threshold, self.items = threshold, {}
        sizes: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            found = words(text)
            if not found:
                continue  # an item without words cannot be found in anything
            n = min(shingle, len(found))  # an item of fewer words is one shingle
            self.items[item_id] = (n, {tuple(found[k : k + n]) for k in range(len(found) - n + 1)})
            hashes = np.unique(shingle_hashes(hashed_words(found), n))
            sizes[n][len(hashes).bit_length()].append((item_id, hashes))
        self.partitions = {n: [Partition(p, threshold) for _, p in sorted(s.items())] for n, s in sizes.items()}
        self.any = {n: np.unique(np.concatenate([p.order for p in parts])) for n, parts in self.partitions.items()}

    def search(self, text: str) -> list[tuple[int, float]]:
        found, out = words(text), []
        hashed = hashed_words(found)
        for n, parts in self.partitions.items():
            own, order = shingle_hashes(hashed, n), self.any[n]
            if not len(own):
                continue
            met = own[order[np.minimum(np.searchsorted(order, own), len(order) - 1)] == own]
            if not len(met):
                continue
            met = np.unique(met)
            near = [i for p in parts if len(own) >= p.least for i in p.candidates(met)]
            grams = set(zip(*(found[k:] for k in range(n)))) if near else ()
            for item_id in near:
                share = len(self.items[item_id][1] & grams) / len(self.items[item_id][1])
                if share >= self.threshold - 1e-9:
                    out.append((item_id, share))
        return sorted(out)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    items_per_scan: int = ITEMS_PER_SCAN,
    bytes_per_scan: int = BYTES_PER_SCAN,
) -> DataFrame:
    """(doc_id, item_id, containment) of every document and test item of which it holds ``threshold`` or more.

    Containment counts distinct word shingles (lower case, runs of letters and digits) of the item. An item
    of fewer words than ``shingle`` is one shingle; an item without words, or null, matches nothing. A null
    text is empty and matches nothing; whole texts are searched, however long. Rows of a repeated doc_id give a pair each; so do
    different texts of one item_id, equal rows of an item give one pair. An item whose id is null or no number has a null item_id.
    Other columns are ignored. Items are read in blocks of ``items_per_scan`` items and ``bytes_per_scan`` bytes on average.
    """
    rows, out = texts(docs, id_col, text_col), None
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("containment", pa.float64())])
    for index in _blocks(benchmark, item_col, item_text, items_per_scan, bytes_per_scan):

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ids, found = [i for i, _ in index.value], _indexed(index, threshold, shingle)
            for batch in batches:
                pairs = [(d, ids[k], c) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for k, c in found.search(t.as_py())]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pairs), schema)], schema=schema)
            HASHES.clear()

        hits = rows.mapInArrow(search, "doc_id long, item_id long, containment double")
        out = hits if out is None else out.union(hits)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, containment double")


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, items_per_scan: int, bytes_per_scan: int) -> Iterator[Broadcast]:
    """Broadcast lists of distinct (item id, text), each of a bounded number of items and bytes."""
    spark = benchmark.sparkSession
    items = written(benchmark.select(F.col(item_col).try_cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).distinct(), "items")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    blocks = max(-(-size.n // items_per_scan), -(-size.b // bytes_per_scan))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else items
        yield spark.sparkContext.broadcast([(r.i, r.t) for r in block.orderBy("i", "t").toLocalIterator()])


def _indexed(items: Broadcast, threshold: float, shingle: int) -> Index:
    """Items are numbered, so that neither a null nor a repeated id hides one."""
    return Index([(k, t) for k, (_, t) in enumerate(items.value)], threshold, shingle)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", items_per_scan: int = ITEMS_PER_SCAN, bytes_per_scan: int = BYTES_PER_SCAN,
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item. Rows are searched where they lie, without a join.

    Each row is judged by its own text, whatever its id, also where it is null or repeated. Null and empty texts stay; repeated rows
    share their fate. Texts of any length are read whole; an empty table stays empty, and without test items all rows stay.
    """
    for items in _blocks(benchmark, item_col, item_text, items_per_scan, bytes_per_scan):
        docs = docs.where(_clean(items, threshold, shingle)(F.col(text_col)))
    return docs


def _clean(items: Broadcast, threshold: float, shingle: int):
    """Whether a text holds none of the items."""

    @F.pandas_udf(BooleanType())
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _indexed(items, threshold, shingle)
        for batch in batches:
            yield pd.Series([not index.search(t or "") for t in batch], dtype=bool)
        HASHES.clear()

    return clean
