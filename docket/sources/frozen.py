"""Frozen files and caches: canonical lines, file digests, write-once sets, run outputs, calibrator knots, dead letters."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from docket.sources.files import pin


def sorted_keys(c: Column, kind: DataType) -> Column:
    """The value with the fields of every struct in it in the order of their names, at any depth."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*(sorted_keys(c[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: sorted_keys(x, kind.elementType))
    return c


def canonical_lines(df: DataFrame) -> DataFrame:
    """(value): each record as JSON with sorted keys at every depth, nulls kept, characters as they are."""
    row = F.struct(*(sorted_keys(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)))
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def idempotent(text: Column, schema: StructType) -> Column:
    """Whether a canonical line reads back to itself."""
    return F.coalesce(F.to_json(sorted_keys(F.from_json(text, schema), schema), {"ignoreNullFields": "false"}) == text, F.lit(False))


def unwrapped_label(reply: Column) -> Column:
    """The text of {"label": text}, else the reply as it is."""
    label = F.try_variant_get(F.try_parse_json(reply), "$.label", "variant")
    return F.when(F.schema_of_variant(label) == "STRING", label.cast("string")).otherwise(reply)


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of the bytes of one file, wherever it lies, read as a stream in small pieces: its size does not matter.

    The digest goes through the bytes in order, so it is one task by nature; ``pin`` and ``content_manifest`` are the digests that spread.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(place)
    if found is None or len(found) != 1 or not found[0].isFile():
        raise ValueError(f"{path}: {len(found) if found is not None else 0} files, not one")
    stream = fs.open(found[0].getPath())
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def frozen_jsonl(spark: SparkSession, path: str, schema: StructType | str, manifest: str, split: str) -> DataFrame:
    """Records of a frozen file whose bytes must have the SHA-256 that the manifest file states for ``split``."""
    text = spark.read.text(manifest, wholetext=True).first().value
    stated, found = json.loads(text)["splits"][split]["sha256"], file_digest(spark, path)
    if found != stated:
        raise ValueError(f"{path}: bytes are {found}, the manifest states {stated}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_source(spark: SparkSession, sources: dict[str, tuple[str, str]], name: str, schema: StructType | str) -> tuple[DataFrame, str]:
    """(records, digest) of a named source (name -> path and digest of its file); an unknown name or other bytes raise ValueError."""
    if name not in sources:
        raise ValueError(f"no source {name!r}; there are {', '.join(sorted(sources))}")
    path, digest = sources[name]
    if (found := file_digest(spark, path)) != digest:
        raise ValueError(f"{path}: bytes are {found}, not {digest}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path), digest


def freeze(df: DataFrame, path: str, refreeze: bool = False, entry: str | None = None, log: str = "") -> str:
    """Write a set of canonical lines once; returns "frozen", "intact" (the same lines are there) or "refrozen".

    Other lines than those there are refused (ValueError), unless ``refreeze`` and the text ``entry`` already stands in ``log``. The
    comparison is by an order-free digest of the lines, so neither files nor partitions matter.
    """
    if refreeze and (not entry or entry not in log):
        raise ValueError("to freeze again, name an entry that the log already holds")
    spark, lines = df.sparkSession, canonical_lines(df)
    try:
        there = pin(spark.read.text(path))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    if there is not None and not refreeze:
        if pin(lines) != there:
            raise ValueError(f"{path} is frozen and holds other lines")
        return "intact"
    if there is None:
        lines.write.text(path)
        return "frozen"
    spare = f"{path}.{uuid.uuid4().hex}"  # the lines may be computed from the old ones
    lines.write.text(spare)
    spark.read.text(spare).write.mode("overwrite").text(path)
    return "refrozen"


def content_manifest(df: DataFrame, split: str, label: str) -> DataFrame:
    """Per split: rows, rows per label (map), and an order-free digest of the canonical lines."""
    row = F.struct(*(sorted_keys(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)))
    h = F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.sum(F.conv(F.substring(h, k, 12), 16, 10).cast("decimal(38,0)"))
    per = df.groupBy(split, label).agg(F.count("*").alias("n"), *(part(1 + 12 * k).alias(f"s{k}") for k in range(5)))
    total = per.groupBy(split).agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(label), F.lit("none")), "n")))).alias("counts"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(5)))
    return total.select(split, "n", "counts", F.sha2(F.concat_ws("|", "n", *(F.col(f"s{k}").cast("string") for k in range(5))), 256).alias("digest"))


def write_run(predictions: DataFrame, sidecar: DataFrame, folder: str, run: str) -> None:
    """The two outputs of a run: predictions, and what is known about each reply."""
    predictions.write.mode("overwrite").json(f"{folder}/{run}/predictions")
    sidecar.write.mode("overwrite").json(f"{folder}/{run}/sidecar")


def put_replies(replies: DataFrame, folder: str, by: str) -> None:
    """Append replies to a cache partitioned by ``by``; rows that are there already, by id and hash, are not written again."""
    spark = replies.sparkSession
    try:
        known = spark.read.parquet(folder).select("id", "hash")
        replies = replies.join(known, ["id", "hash"], "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    replies.dropDuplicates(["id", "hash"]).write.mode("append").partitionBy(by).parquet(folder)


def append_orders(orders: DataFrame, folder: str) -> DataFrame:
    """Append orders with receipts told by their content to a folder; an order that is there already is not written twice. Returns the receipts."""
    content = F.to_json(F.struct(*sorted(orders.columns)), {"ignoreNullFields": "false"})
    x = orders.withColumn("order_id", F.concat(F.lit("ORD-"), F.upper(F.substring(F.sha2(content, 256), 1, 8))))
    spark, new = orders.sparkSession, x.dropDuplicates(["order_id"])
    try:
        new = new.join(spark.read.schema(x.schema).json(folder).select("order_id"), "order_id", "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.select(*x.columns).write.mode("append").json(folder)
    return x


def save_knots(knots: DataFrame, path: str) -> None:
    """The knots (x, y) of a calibrator as one JSON object of two lists; there are at most as many as distinct confidences kept."""
    lists = knots.agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("k"))
    out = lists.select(F.to_json(F.struct(F.transform("k", lambda s: s["x"]).alias("x_knots"), F.transform("k", lambda s: s["y"]).alias("y_knots"))).alias("value"))
    out.coalesce(1).write.mode("overwrite").text(path)


def load_knots(spark: SparkSession, path: str) -> DataFrame:
    """(x, y) of a saved calibrator."""
    saved = spark.read.schema("x_knots array<double>, y_knots array<double>").option("multiLine", "true").json(path)
    return saved.select(F.explode(F.arrays_zip("x_knots", "y_knots")).alias("k")).select(F.col("k.x_knots").alias("x"), F.col("k.y_knots").alias("y"))


def report_value(spark: SparkSession, path: str, field: str) -> object:
    """One value of a JSON report, by its path of names; null if it is not there."""
    text = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$." + field).alias("v")).first()
    return None if text is None or text.v is None else json.loads(text.v)


def dead_letters(parsed: DataFrame, error: str) -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with one); raises ValueError if there are rows and all failed."""
    state = parsed.agg(F.count("*").alias("n"), F.count(error).alias("bad")).first()
    if state.n and state.bad == state.n:
        raise ValueError(f"all {state.n} messages failed")
    return parsed.where(F.col(error).isNull()), parsed.where(F.col(error).isNotNull())
