"""Tables with one row per key on plain Parquet: batches are merged in, only the hash buckets they touch are written again.

A version of the table is one commit record, which names for each bucket the folder that holds it, and for each writer the last batch that is in.
A batch appears whole when its record does; one that is merged twice, as after a restart of its stream, changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docket.sources import store

Fold = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """``folder`` holds log/<version>.json and data/<name>/bucket=<b>; ``schema`` includes ``keys``.

    ``buckets`` holds for the life of the table: choose it so that one bucket, rewritten by one task, stays small.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, keys: list[str], buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _version(self) -> tuple[int, dict]:
        logs = [int(n[:-5]) for n in store.names(self.spark, f"{self.folder}/log") if n.endswith(".json")]
        if not logs:
            return 0, {"where": {}, "writers": {}}
        return max(logs), json.loads(store.get(self.spark, f"{self.folder}/log/{max(logs)}.json"))

    def _rows(self, where: dict[str, str]) -> DataFrame:
        paths = [f"{self.folder}/data/{name}/bucket={b}" for b, name in sorted(where.items()) if name]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as of the last commit; without one it is empty."""
        return self._rows(self._version()[1]["where"])

    def merge(self, rows: DataFrame, batch: int, fold: Fold, writer: str = "") -> bool:
        """Fold a batch in; False if it is in already. Batches of one writer have rising numbers.

        ``fold(old, rows)`` gets the table's rows in the buckets that the batch touches, and the batch, and returns all rows of these buckets. A
        second writer that commits between is told by FileExistsError and loses nothing; it may merge again.
        """
        version, state = self._version()
        if batch <= state["writers"].get(writer, -1):
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = rows.persist()
        try:
            touched = [r.b for r in rows.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
            where = dict(state["where"])
            if touched:
                old = self._rows({str(b): where.get(str(b), "") for b in touched})
                name = uuid.uuid4().hex
                merged = fold(old, rows).select(*self.schema.names).withColumn("bucket", bucket)
                merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{name}")
                written = {n.removeprefix("bucket=") for n in store.names(self.spark, f"{self.folder}/data/{name}")}
                where |= {str(b): name if str(b) in written else "" for b in touched}
        finally:
            rows.unpersist()
        store.put(self.spark, f"{self.folder}/log/{version + 1}.json", json.dumps({"where": where, "writers": state["writers"] | {writer: batch}}))
        self._sweep(set(where.values()) | set(state["where"].values()), version)
        return True

    def _sweep(self, named: set[str], version: int) -> None:
        """Delete what neither this version nor the one before names, as a reader may still hold that one."""
        for name in store.names(self.spark, f"{self.folder}/data"):
            if name not in named:
                store.remove(self.spark, f"{self.folder}/data/{name}")
        for log in store.names(self.spark, f"{self.folder}/log"):
            if not log.endswith(".json") or int(log[:-5]) < version:
                store.remove(self.spark, f"{self.folder}/log/{log}")


def adding(keys: list[str], sums: list[str]) -> Fold:
    """Sums of each key over all batches."""
    return lambda old, rows: old.select(*keys, *sums).unionByName(rows.select(*keys, *sums)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def replacing(keys: list[str], order: list[str]) -> Fold:
    """Of each key the row that is last by ``order``; of equal ones, that of the later batch."""

    def fold(old: DataFrame, rows: DataFrame) -> DataFrame:
        both = old.withColumn("later", F.lit(0)).unionByName(rows.select(*old.columns).withColumn("later", F.lit(1)))
        last = both.groupBy(*keys).agg(F.max_by(F.struct(*old.columns), F.struct(*order, "later")).alias("row"))
        return last.select("row.*")

    return fold
