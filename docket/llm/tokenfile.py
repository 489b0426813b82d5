"""Token-id files: documents in ascending id order, range-coded in reset, checksummed blocks.

A file set is a Parquet table of chunks in the shared folder (Spark's committer makes it whole even when
executors are lost). A chunk row holds ``part``, ``chunk``, the ids and token counts of its documents, and their
tokens as blocks of the ``rangecode`` layout. Rows sort by (part, chunk); documents ascend.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docket.llm.common import shared_dir, slices, texts
from docket.llm.rangecode import BLOCK_IDS, decode_blocks, encode_blocks
from docket.llm.tokens import default_vocabulary, encoder

CHUNK = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("blocks", pa.list_(pa.binary()))])
CHUNK_BLOCKS = 1024


def write_token_files(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = 0, chunk_blocks: int = CHUNK_BLOCKS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every document and write the files; returns their path.

    A null or empty text is the end id alone; null ids come first; rows that repeat an id follow
    each other, texts ascending. An empty table writes an empty file set. A chunk holds ``chunk_blocks`` blocks, or more where a
    document is longer; other columns are ignored. Ids of 65,536 and more, as large vocabularies have them, are refused when they are met.
    """
    words = vocabulary or default_vocabulary()
    end = end_id.to_bytes(4, "little")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, doc_ids, sizes, data, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(data), "<u4")
            blocks = encode_blocks([ids[k : k + BLOCK_IDS] for k in range(0, len(ids), BLOCK_IDS)])
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, chunk, doc_ids, sizes, blocks), CHUNK)], schema=CHUNK)

        for batch in batches:
            for some in slices(batch, 5000):
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder(words).encode(some.column(1))):
                    doc_ids.append(doc_id)
                    sizes.append(len(ids) // 4 + 1)
                    data.append(ids + end)
                    held += sizes[-1]
                    if held >= chunk_blocks * BLOCK_IDS:
                        yield row()
                        chunk, doc_ids, sizes, data, held = chunk + 1, [], [], [], 0
        if doc_ids:
            yield row()

    path = path or f"{shared_dir(docs.sparkSession)}/tables/tokens-{uuid.uuid4().hex}"
    rows = texts(docs, id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(chunks, "part int, chunk int, doc_ids array<long>, n_tokens array<long>, blocks array<binary>").write.option("compression", "none").parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit)."""
    stored = spark.read.parquet(path)
    size = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    chunks = stored.select("part", "chunk", size.alias("size"))
    parts = chunks.groupBy("part").agg(F.sum("size").alias("size"))
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    parts = parts.select("part", F.coalesce(F.sum("size").over(first), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.select("part", "chunk", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("chunk_start")).join(parts, "part")
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("doc_id", pa.int64()), ("inner_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk, doc_ids, sizes, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.concatenate(decode_blocks(blocks)).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                begin = ends - sizes
                cols = ([part] * len(sizes), [chunk] * len(sizes), doc_ids, begin, sizes, [data[4 * a : 4 * b] for a, b in zip(begin, ends)])
                for at in range(0, len(sizes), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 2000], f.type) for c, f in zip(cols, schema)], schema=schema)

    out = stored.select("part", "chunk", "doc_ids", "n_tokens", "blocks").mapInArrow(documents, "part int, chunk int, doc_id long, inner_start long, n_tokens long, ids binary")
    return out.join(starts, ["part", "chunk"]).select("doc_id", (F.col("part_start") + F.col("chunk_start") + F.col("inner_start")).alias("start"), "n_tokens", "ids")
