"""A source that is read once: a file stream whose checkpoint is the log of what is done, its rows split into good and dead ones in one pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def consume(stream: DataFrame, error: Column, out: str, log: str, before_commit: Callable[[DataFrame, int], None] | None = None) -> int:
    """Read all that is new in a file stream into ``out`` and return in how many batches.

    ``log`` is the stream's checkpoint: a file that it names is never read again. Rows with a non-null ``error`` are dead letters and go to the partition
    dead=true with that column, in the same write as the good ones. A batch replaces its own folder, so one that was cut off before it
    was logged, and is read again, leaves no row twice. ``before_commit(rows, batch)`` runs after the write, before the batch is logged. A
    batch with dead letters alone goes on as well: what one message is like says nothing about the next.
    """
    done: list[int] = []

    def write(rows: DataFrame, batch: int) -> None:
        told = rows.withColumn("error", error)
        told.withColumn("dead", F.col("error").isNotNull()).write.mode("overwrite").partitionBy("dead").parquet(f"{out}/batch={batch}")
        if before_commit is not None:
            before_commit(rows, batch)
        done.append(batch)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return len(done)


def consumed(spark: SparkSession, out: str, schema: StructType, dead: bool) -> DataFrame:
    """All good rows so far, or the dead letters with their error; empty before the first batch."""
    whole = StructType([*schema.fields, *StructType.fromDDL("error string").fields, StructField("batch", LongType()), StructField("dead", BooleanType())])
    try:
        found = spark.read.schema(whole).parquet(out)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], whole)
    kept = found.where(F.col("dead") == dead)
    return kept.select(*schema.names, "error", "batch") if dead else kept.select(*schema.names, "batch")
