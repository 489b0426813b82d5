"""Rate limits as a stream: every event is allowed or not, by a count per identity and window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docket.streaming.upserts import KeyedTable

OPEN = "identity string, epoch bigint, used bigint"
DECISION = "identity string, at timestamp, seq bigint, epoch bigint, used bigint, allowed boolean, retry_after bigint"


def limit_stream(events: DataFrame, identity: str, at: str, seq: str, seconds: int, limit: int, table: KeyedTable, out: str, checkpoint: str) -> DataFrame:
    """Run over all events that are there now (availableNow) and return DECISION for each so far, in the order of ``at`` and ``seq`` within a micro-batch.

    ``table`` (OPEN, key identity) holds each identity's open window and how often it was used in it; an event of an older window, which comes late, is counted
    on its own and changes nothing. Decisions lie in a folder a batch under ``out``, written before the table takes the batch in; a batch that runs again after that changes nothing.
    """
    spark, second = table.spark, F.unix_seconds("at")

    def decide(old: DataFrame, rows: DataFrame, batch: int) -> DataFrame:
        x = rows.withColumn("epoch", ((second - F.pmod(second, F.lit(seconds))) / seconds).cast("bigint"))
        o = old.select(F.col("identity").alias("who"), F.col("epoch").alias("open"), F.col("used").alias("before"))
        x = x.withColumn("n", F.row_number().over(Window.partitionBy("identity", "epoch").orderBy("at", "seq")).cast("bigint")).join(o.hint("merge"), F.col("identity").eqNullSafe(F.col("who")), "left")
        used = F.when(F.col("epoch") < F.col("open"), F.lit(1).cast("bigint")).when(F.col("epoch") == F.col("open"), F.col("before") + F.col("n")).otherwise(F.col("n"))
        x = x.withColumn("used", used).withColumn("allowed", F.col("used") <= limit).withColumn("retry_after", F.when(~F.col("allowed"), seconds - F.pmod(second, F.lit(seconds))))
        x.select("identity", "at", "seq", "epoch", "used", "allowed", "retry_after").write.mode("overwrite").parquet(f"{out}/batch={batch}")
        told = spark.read.schema(DECISION).parquet(f"{out}/batch={batch}").where("epoch is not null")
        last = old.unionByName(told.select("identity", "epoch", "used")).groupBy("identity").agg(F.max(F.struct("epoch", "used")).alias("last"))
        return last.select("identity", "last.*")

    def merge(rows: DataFrame, batch: int) -> None:
        table.merge(rows, batch, lambda old, x: decide(old, x, batch))

    x = events.select(F.col(identity).cast("string").alias("identity"), F.col(at).cast("timestamp").alias("at"), F.col(seq).cast("bigint").alias("seq"))
    x.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(DECISION).parquet(f"{out}/batch=*")
