"""The audit report: records and the verdicts on them, by class and stratum, with note tags, findings and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions.columns import note_tags


def audit_report(records: DataFrame, verdicts: DataFrame, strata: dict[str, dict[str, Column]]) -> dict[str, DataFrame]:
    """Tables of an audit: classes, strata, tags, protocol, label_findings and evidence.

    ``records`` has id, email_class and whatever the predicates of ``strata`` (class -> name -> predicate) read; ``verdicts`` id, realistic, labels_correct
    and notes. Verdicts that are pending or half filled are an error, as is one on an unknown record: then there is nothing to report yet.
    Strata without a sampled record are listed with 0.
    """
    open_ = verdicts.where("realistic is null or labels_correct is null").count()
    if open_:
        raise ValueError(f"{open_} verdicts are not filled; finish the audit first")
    x = verdicts.join(records.withColumn("known", F.lit(True)), "id", "left")
    x = x.where(F.coalesce("known", F.raise_error(F.concat(F.lit("no record "), F.col("id").cast("string"))).cast("boolean")))
    named = F.array_compact(F.array(*(F.when((F.col("email_class") == c) & p, F.lit(f"{c}/{n}")) for c, of in strata.items() for n, p in of.items())))
    found = x.select(F.explode(named).alias("stratum"), "realistic").groupBy("stratum").agg(F.count("*").alias("sampled"), F.count_if(~F.col("realistic")).alias("unrealistic"))
    names = x.sparkSession.createDataFrame([(f"{c}/{n}",) for c, of in strata.items() for n in of], "stratum string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    tags = x.select("id", "notes", F.explode(note_tags(F.coalesce("notes", F.lit("")))).alias("t")).select("id", "notes", "t.tag", F.when(~F.col("t.qualifier").rlike("^(?:quirk|protocol):"), F.col("t.qualifier")).alias("qualifier"))
    return {
        "classes": x.groupBy("email_class").agg(F.count_if("realistic").alias("realistic"), F.count("*").alias("total")),
        "strata": names.join(found, "stratum", "left").select("stratum", zero("sampled"), zero("unrealistic")),
        "tags": tags.where(F.col("tag").startswith("quirk:")).groupBy("tag", F.coalesce("qualifier", F.lit("—")).alias("qualifier")).agg(F.count("*").alias("n")),
        "protocol": tags.where(F.col("tag").startswith("protocol:")).select("id", "notes"),
        "label_findings": x.where(~F.col("labels_correct")).select("id"),
        "evidence": x.where(~F.col("realistic")).drop("known", "realistic", "labels_correct"),
    }


def markdown(report: dict[str, DataFrame], most: int = 1000) -> str:
    """The report as a text of tables, each ordered by its columns. It is for readers: a table of over ``most`` rows is cut, and says so."""
    parts = []
    for name, table in report.items():
        rows = table.orderBy(*table.columns).limit(most + 1).collect()
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
        body = ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
        parts.append("\n".join([f"## {name.replace('_', ' ').capitalize()}", "", "| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns), *body, *(["", f"More than {most} rows."] if len(rows) > most else [])]))
    return "\n\n".join(parts) + "\n"
