"""Exact de-duplication by 128-bit content hash with byte comparison, all in the JVM.

Plan: (1) a thin shuffle of (hash, id) finds hashes that occur twice or more and writes them to the
shared folder; (2) only rows with such a hash are grouped by hash *and* text, so bytes decide who
is a copy of whom and two texts with one hash never merge; (3) the groups join back to the thin rows. Text is
shuffled only in (2), and not at all where the written table is small enough to be broadcast,
which the planner decides from its size on disk. The join of (2) is by hash and a salt, so a hot text is spread over
SALTS tasks, each of which collapses its copies before the shuffle of the grouping. The join of (3) has plain
exchanges on both sides, which AQE splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.llm.common import texts, without, written

SALTS = 16


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = F.md5,
    keep: str = "max",
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep``: "min" keeps the smallest id of equal texts, "max" the largest. A null text is
    empty and equals other empty texts. Rows that repeat an id count in ``group_size`` like any other
    row, and each is marked kept if its id is the one that stays. A null id stays only if all ids of
    the group are null. An empty table gives an empty result; other columns are ignored. Texts of any length are compared whole.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = texts(docs, id_col, text_col).withColumn("h", content_hash(F.col("text")))
    repeated = written(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "hashes")
    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    groups = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"], "left_semi")
        .groupBy("h", "text")
        .agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    groups = written(groups, "groups")
    thin = rows.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"))
    return thin.join(groups, ["h", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs``, all columns, without copies: of equal texts the row with the kept id.

    Rows that share both the kept id and the text all stay (an id names one document). Rows without an id
    stay only where no copy has one.
    """
    groups = exact_groups(docs, id_col, text_col, keep=keep)
    return without(docs, groups.where("not kept").select("doc_id", F.col("text_sha256").alias("h")), id_col, text_col)
