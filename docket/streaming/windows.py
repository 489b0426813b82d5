"""Structured Streaming forms of metering and rate limits: state is one counter per open window and identity."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with an event-time column that can carry a watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("at", F.col("ts").cast("timestamp"))


def window_counts(stream: DataFrame, identity: str, width: str, late: str = "10 minutes") -> DataFrame:
    """Events per identity and tumbling window; windows close when the watermark passes them."""
    w = stream.withWatermark("at", late).groupBy(identity, F.window("at", width).alias("w")).agg(F.count("*").alias("used"))
    return w.select(identity, F.unix_seconds("w.start").alias("window_start"), "used")


def usage_counts(stream: DataFrame, org: str) -> DataFrame:
    return stream.groupBy(F.col(org).alias("org_id"), F.date_format("at", "yyyy-MM").alias("period")).agg(F.count("*").alias("events"))


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share (spark.checkpoint.dir); a temporary one only where that is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = f"file://{tempfile.mkdtemp(prefix='docket-')}"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run over all that is there now (availableNow) into a Parquet table of the shared folder and return it.

    Checkpoints and state lie there too. A batch that is run again replaces its own rows. Of update mode the latest row of each
    of ``keys`` counts, of complete mode the last batch, of append mode all rows.
    """
    spark, at = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/streams/{uuid.uuid4().hex}"
    done: list[int] = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")
        done.append(batch)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{at}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == max(done))
    if mode == "update":
        last = F.max_by(F.struct(*(c for c in stream.columns if c not in keys)), "batch").alias("last")
        rows = rows.groupBy(*keys).agg(last).select(*keys, "last.*")
    return rows.select(*stream.columns)


def once_per_message(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each message once while its key is within the watermark."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark([key])
