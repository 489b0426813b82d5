"""Registered queries on terms inside whole documents, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.operators import surfaces
from docket.plans.catalogue import query, t

_PHRASES = ["the", "of", "of the", "in the", "and", "que", "de", "de la", "is", "to"]
_OTHERS = ["er", "on", "es"]
_ANY = lambda terms: "|".join(sorted(terms, key=len, reverse=True))


def dictionary(spark, sf):
    """Phrases of several languages and the names of all parts; no document holds one of the latter, which is why the SQL can do without them."""
    return spark.createDataFrame([(p,) for p in _PHRASES], "term string").union(t(spark, sf, "part").select(F.concat(F.lit("Part "), F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string"))))


def texts(spark, sf):
    return t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


@query(rf"""with d as (select doc_id id, coalesce(text, '') x, regexp_extract_all(coalesce(text, ''), '(?i)\b(?:{_ANY(_PHRASES)})\b') m from documents)
 select id, len(m) spans, len(list_filter(m, lambda w: lower(w) = 'of the')) of_the, length(regexp_replace(x, '(?i)\b(?:{_ANY(_PHRASES)})\b', '#', 'g')) rest_chars from d""")
def term_masks(spark, sf):
    found = surfaces.masked_spans(surfaces.term_spans(texts(spark, sf), dictionary(spark, sf), ascii_words=True))
    return found.select("id", F.size("spans").cast("long").alias("spans"), F.size(F.filter("spans", lambda s: s["term"] == "of the")).cast("long").alias("of_the"), F.length("rest").cast("long").alias("rest_chars"))


@query(rf"""with r as (select doc_id id, regexp_replace(coalesce(text, ''), '(?i)\b(?:{_ANY(_PHRASES)})\b', '#', 'g') x from documents)
 select id, case when regexp_matches(x, '[0-9]') then 'digit' else nullif(lower(regexp_extract(x, '(?i)\b(?:{_ANY(_OTHERS)})\b')), '') end as "left" from r""")
def term_closures(spark, sf):
    others = spark.createDataFrame([(p,) for p in _OTHERS], "term string")
    return surfaces.closures(texts(spark, sf), dictionary(spark, sf), others, ascii_words=True).select("id", "left")
