"""Terms of a dictionary inside texts: one automaton of all terms, one pass a text, leftmost and then longest first.

Terms go to the tasks in blocks of bounded size, so a dictionary may be larger than a task; each block is one scan of the texts. A single block's occurrences are
chosen where they are found; those of several meet by text, where a fold over their places chooses.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docket.sources.store import written

SPANS = "array<struct<start:int,end:int,term:string>>"
MOST_ROWS = 500
MASK = "�"


def lowered(text: str) -> str:
    """Lower case with every character in its place: one whose lower case is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Of terms by their lower case; of terms that differ by case alone the first in order counts. Empty ones are left out."""
    found = ahocorasick.Automaton()
    for t in sorted(terms, reverse=True):
        if t:
            found.add_word(lowered(t), t)
    found.make_automaton()
    return found


def occurrences(found: ahocorasick.Automaton, text: str, ascii_words: bool) -> list[tuple[int, int, str]]:
    """(start, end, term) wherever a term stands between word boundaries; they may overlap."""
    if not text or not len(found):
        return []
    low = lowered(text)
    word = lambda c: (c.isalnum() or c == "_") and (not ascii_words or c.isascii())
    edge = lambda p: (p > 0 and word(text[p - 1])) != (p < len(text) and word(text[p]))
    out = []
    for last, term in found.iter(low):
        start = last + 1 - len(term)
        if edge(start) and edge(last + 1):
            out.append((start, last + 1, term))
    return out


def chosen(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Without overlaps: the leftmost first, of those that begin together the longest."""
    out, free = [], 0
    for s in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if s[0] >= free:
            out.append(s)
            free = s[1]
    return out


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u212a", "abcdefghijklmnopqrstuvwxyzk"  # with the sign for kelvin, the one other character whose lower case is ASCII


def _runs(c: Column) -> Column:
    """The different runs of ASCII letters, digits and underscores in a text, in lower case."""
    return F.array_distinct(F.array_remove(F.split(F.translate(c, UPPER, LOWER), "[^0-9a-z_]+"), ""))


def possible_terms(terms: DataFrame, texts: DataFrame, term: str, text_col: str) -> DataFrame:
    """The terms whose every ASCII run is a run of some text; no other can occur, as a term stands between word boundaries and so do the runs inside it."""
    known = texts.select(F.explode(_runs(F.col(text_col))).alias("run")).distinct()
    asked = terms.select(term, F.explode_outer(_runs(F.col(term))).alias("run"))
    met = asked.join(known.withColumn("known", F.lit(True)).hint("shuffle_hash"), "run", "left")
    return met.groupBy(term).agg(F.bool_and(F.col("run").isNull() | F.coalesce("known", F.lit(False))).alias("whole")).where("whole").select(term)


def term_spans(texts: DataFrame, terms: DataFrame, term: str = "term", id_col: str = "id", text_col: str = "text", ascii_words: bool = False, most_bytes: int = 32 << 20) -> DataFrame:
    """``texts`` with spans: the terms that occur in the text, whatever their case, between word boundaries, without overlaps, in order; places count from 0.

    Terms with words that no text has go first (possible_terms()), so the tasks hold those that may occur. Null texts have none. ``id_col`` tells rows apart; it is used only where the terms take several blocks of ``most_bytes``. ``ascii_words`` takes letters
    and digits beyond ASCII for no part of words.
    """
    words = written(possible_terms(terms.select(F.col(term).cast("string").alias("t")).where("t <> ''").distinct(), texts, "t", text_col), "terms")
    size = words.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks = max(1, -(-int(size) // most_bytes))
    spark, schema = texts.sparkSession, StructType([*texts.schema.fields, *StructType.fromDDL(f"spans {SPANS}").fields])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string())]))

    def scan(block: int, choose: bool) -> DataFrame:
        own = words if blocks == 1 else words.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast([r.t for r in own.collect()])  # about ``most_bytes``

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = automaton(sent.value)
            for b in (whole.slice(k, MOST_ROWS) for whole in batches for k in range(0, whole.num_rows, MOST_ROWS)):  # texts and spans are Python objects only so many at a time
                spans = [occurrences(found, t or "", ascii_words) for t in b.column(text_col).to_pylist()]
                rows = [[dict(zip(("start", "end", "term"), s)) for s in (chosen(x) if choose else x)] for x in spans]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], names=[*b.schema.names, "spans"])

        return texts.mapInArrow(of, schema)

    if blocks == 1:
        return scan(0, True)
    every = scan(0, False).select(id_col, "spans")
    for block in range(1, blocks):
        every = every.union(scan(block, False).select(id_col, "spans"))
    order = F.transform(F.flatten(F.collect_list("spans")), lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["term"].alias("term")))
    none = F.struct(F.array().cast(SPANS).alias("kept"), F.lit(0).alias("free"))
    add = lambda a, s: F.when(s["start"] >= a["free"], F.struct(F.concat(a["kept"], F.array(F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["term"].alias("term")))).cast(SPANS).alias("kept"), (-s["back"]).alias("free"))).otherwise(a)
    found = every.groupBy(id_col).agg(F.aggregate(F.array_sort(order), none, add)["kept"].alias("spans"))
    return texts.join(found, id_col).select(*texts.columns, "spans")


def masked_spans(spanned: DataFrame, text_col: str = "text", name: str = "rest") -> DataFrame:
    """``spanned`` with the text whose spans are each one mark, in one pass over its spans."""
    piece = lambda a, s: F.struct(F.concat(a["out"], F.substring(F.col(text_col), a["at"] + 1, s["start"] - a["at"]), F.lit(MASK)).alias("out"), s["end"].alias("at"))
    done = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), piece)
    rest = F.concat(done["out"], F.substring(F.col(text_col), done["at"] + 1, F.length(text_col)))
    return spanned.withColumn(name, F.coalesce(rest, F.lit("")))


def closures(texts: DataFrame, surfaces: DataFrame, terms: DataFrame, term: str = "term", id_col: str = "id", text_col: str = "text", ascii_words: bool = False) -> DataFrame:
    """``texts`` with what is left over after all ``surfaces`` are masked, though a surface should have held it (left): "digit", the first of ``terms``, or null."""
    masked = masked_spans(term_spans(texts, surfaces, term, id_col, text_col, ascii_words), text_col, "_rest").drop("spans")
    found = term_spans(masked, terms, term, id_col, "_rest", ascii_words)
    return found.withColumn("left", F.when(F.col("_rest").rlike("[0-9]"), "digit").otherwise(F.get("spans", F.lit(0))["term"])).drop("_rest", "spans")
