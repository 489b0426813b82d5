"""Helpers shared by the corpus operators: inputs, shared scratch tables, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, one
    machine) a temporary folder is made and set for this session.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = f"file://{tempfile.mkdtemp(prefix='docket-')}"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: the table survives the loss of any executor, and its real size on
    disk is what the planner sees when it chooses between a broadcast and a shuffle join.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_at(df: DataFrame, name: str, group_rows: int | None = None) -> tuple[DataFrame, str]:
    """``written``, and the folder that holds the table, for ``removed`` once nothing reads it any more.

    ``group_rows`` is for rows of megabytes, the most that a row group has. A writer holds the rows of a row group in memory, and a reader up to
    4096 of them at once; without it a task's memory would grow with its share of the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    options = {"parquet.block.row.count.limit": group_rows} if group_rows else {}
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of ``written_at`` from the shared folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators read, under fixed names; a null text is empty."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, most_rows: int = 500, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Views of a batch that are small enough to become Python objects; Spark itself bounds a batch at 64 MB."""
    step = max(1, min(most_rows, batch.num_rows * most_bytes // max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def digest(text: Column) -> Column:
    """What tells rows of one id apart where decisions are joined back to rows: SHA-256 of the text, null as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def without(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs``, all columns, whose id and text are not in ``dropped`` (doc_id, h). Null ids are compared too.

    What is dropped grows with the corpus, so the plan is a shuffle whatever its size is now.
    """
    names = [f"dropped_{uuid.uuid4().hex}" for _ in range(2)]  # clash with no column
    out = dropped.select(F.col("doc_id").alias(names[0]), F.col("h").alias(names[1])).distinct().hint("merge")
    return docs.join(out, F.col(id_col).cast("long").eqNullSafe(F.col(names[0])) & (digest(F.col(text_col)) == F.col(names[1])), "left_anti")
