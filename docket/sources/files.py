"""Readers that check what they read, and writers with stable bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docket.functions.columns import local_time


def pinned_jsonl(spark: SparkSession, path: str, schema: StructType, digest: str, rows: int | None = None) -> DataFrame:
    """Records of a JSONL file set whose pin (see ``pin``) must be ``digest``; a wrong pin or row count raises ValueError."""
    text = spark.read.text(path)
    found, n = pin(text)
    if found != digest or rows is not None and n != rows:
        raise ValueError(f"{path}: pin {found} of {n} rows, not {digest} of {rows}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def pin(lines: DataFrame, column: str = "value") -> tuple[str, int]:
    """Digest of a multiset of lines whatever their order or files: SHA-256 over counts and sums of line hashes."""
    h = F.sha2(F.col(column), 256)
    part = lambda k: F.sum(F.conv(F.substring(h, k, 12), 16, 10).cast("decimal(38,0)"))
    r = lines.agg(F.count("*").alias("n"), *(part(1 + 12 * k).alias(f"s{k}") for k in range(5))).select("n", F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n", "s0", "s1", "s2", "s3", "s4"))), 256).alias("d")).first()
    return r.d, r.n


def whole_messages(spark: SparkSession, folder: str, glob: str = "*.eml") -> DataFrame:
    """(path, raw) of each message file; order by path where order matters."""
    return spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def strict(c: Column, schema: str) -> Column:
    """Parsed JSON, or null if it does not parse, a key is missing or unknown."""
    parsed = F.from_json(c, schema, {"mode": "PERMISSIVE"})
    keys = F.array_sort(F.json_object_keys(c))
    fields = sorted(f.name for f in StructType.fromDDL(schema).fields)
    return F.when(keys == F.array(*map(F.lit, fields)), parsed)


def checked_predictions(raw: DataFrame, expected: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, problems): rows (id, payload); problems lists blank, unparsed, duplicate, unknown and missing ids.

    All problems come from one pass and one shuffle by id, which moves counts only. A blank or unparsed row is a problem each, an unknown
    id one for each of its rows.
    """
    parsed = strict(F.col("payload"), schema)
    blank = F.coalesce(F.trim("payload") == "", F.lit(False))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    row = raw.select("id", F.lit(1).alias("row"), blank.alias("blank"), (~blank & F.col("payload").isNotNull() & parsed.isNull()).alias("unparsed"))
    both = row.unionByName(expected.select("id", F.lit(0).alias("row"), F.lit(False).alias("blank"), F.lit(False).alias("unparsed")))
    per = both.groupBy("id").agg(F.sum("row").alias("rows"), count(F.col("blank")).alias("blank"), count(F.col("unparsed")).alias("unparsed"), F.count_if(F.col("row") == 0).alias("expected"))
    times = lambda n, what: F.array_repeat(F.lit(what), n.cast("int"))
    none = F.array().cast("array<string>")
    found = F.concat(
        times(F.col("blank"), "blank"), times(F.col("unparsed"), "unparsed"), F.when(F.col("rows") > 1, F.array(F.lit("duplicate"))).otherwise(none),
        F.when(F.col("expected") == 0, times(F.col("rows"), "unknown")).otherwise(none), F.when(F.col("rows") == 0, times(F.col("expected"), "missing")).otherwise(none),
    )
    return raw.select("id", parsed.alias("parsed")).where("parsed is not null"), per.select("id", F.explode(found).alias("problem"))


def pairs_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(confidence, correct) of a file of calibration pairs, one JSON object a line; a line that is none, or lacks one of both, ends the job."""
    read = spark.read.schema("confidence double, correct boolean").option("mode", "FAILFAST").json(path)
    whole = F.col("confidence").isNotNull() & F.col("correct").isNotNull()
    return read.where(F.when(whole, True).otherwise(F.raise_error(F.lit(f"{path}: a pair lacks its confidence or its outcome")).cast("boolean")))


def canonical_jsonl(df: DataFrame, path: str) -> None:
    """Write records with sorted keys, nulls kept; ordering of rows is the frame's."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def manifest(df: DataFrame, split: str) -> DataFrame:
    """Rows and an order-free digest of ids per split."""
    return df.groupBy(split).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("bigint")).alias("digest"))


def authored_blocks(files: DataFrame, column: str, header: str, zone: str, year: int, classes: list[str], gold_classes: list[str]) -> DataFrame:
    """Records of hand-written block files, one file a row: a ``### <id>`` line, From, Sent, Class and Subject lines, a blank line, the body and
    perhaps a ```gold fence.

    ``header`` is the pattern of an id. Returns id, sender, sent_at, email_class, subject, body, gold and error (null for a sound block).
    """
    starts = F.split(F.col(column), r"(?m)^(?=### )")
    block = F.col("block")
    name = lambda n: F.trim(F.regexp_extract(block, rf"(?m)^{n}:[ \t]*(.*)$", 1))
    head = rf"^### ({header})[ \t]*\nFrom:.*\nSent:.*\nClass:.*\nSubject:.*\n[ \t]*\n"
    x = files.select(F.explode(starts).alias("block")).where(F.trim("block") != "")
    x = x.select("block", F.regexp_extract(block, rf"^### ({header})[ \t]*(?:\n|\z)", 1).alias("id"), F.lower(name("From")).alias("sender"), name("Sent").alias("sent"), name("Class").alias("email_class"), name("Subject").alias("subject"), F.regexp_replace(block, head, "").alias("rest"))
    rest, cls = F.col("rest"), F.col("email_class")
    x = x.withColumn("body", F.btrim(F.regexp_replace(rest, r"(?s)(?:^|\n)```gold[ \t]*\n.*\z", ""), F.lit(" \t\n")))
    x = x.withColumn("gold", F.nullif(F.regexp_extract(rest, r"(?s)(?:^|\n)```gold[ \t]*\n(.*?)\n?```[ \t]*(?:\n|\z)", 1), F.lit("")))
    x = x.withColumn("sent_at", local_time(F.col("sent"), zone, year))
    error = (
        F.when(F.col("id") == "", "header").when(~block.rlike(head), "truncated").when(~cls.isin(classes), "class").when(F.col("sent_at").isNull(), "sent")
        .when(rest.rlike(r"(?:^|\n)```gold[ \t]*\n") & F.col("gold").isNull(), "open fence").when(rest.rlike(r"(?s)```gold.*\n```[ \t]*\n\s*\S"), "text after the fence")
        .when(F.col("body") == "", "empty body").when(cls.isin(gold_classes) & F.col("gold").isNull(), "gold missing").when(~cls.isin(gold_classes) & F.col("gold").isNotNull(), "gold not allowed")
    )
    return x.select("id", "sender", "sent_at", "email_class", "subject", "body", "gold", error.alias("error"))
