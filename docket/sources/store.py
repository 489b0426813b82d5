"""Small files beside tables, in any store that Spark reads, and tables in the shared folder that end a lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docket.streaming.windows import shared_dir


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    fs, place = _at(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that appears whole or not at all; one that is there already raises FileExistsError."""
    fs, place = _at(spark, path)
    _, spare = _at(spark, f"{path}.part")
    fs.mkdirs(place.getParent())
    out = fs.create(spare, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(place) or not fs.rename(spare, place):
        raise FileExistsError(path)


def get(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and rows stay as they are however often they are read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
