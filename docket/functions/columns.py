"""Column expressions used throughout: ratios, hashing, and the three text normalisers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0.0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def bucket(n: int, *keys: Column) -> Column:
    """Deterministic number below n from the keys' text: seeds, splits and shuffles without a random state."""
    text = F.concat_ws("|", *(k.cast("string") for k in keys))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(n))


@F.pandas_udf(StringType())
def casefolded(c: pd.Series) -> pd.Series:
    """Full case folding, as where 'ß' must equal 'SS'; for ASCII texts lower() does the same without Python."""
    return c.map(lambda v: v.casefold() if v is not None else None)


# Beyond ASCII, but with cases that the JVM and Python know alike: Latin letters and general punctuation, but for the few that fold to other than their lower case.
PLAINLY_CASED = r"^[\x00-\u024f\u2000-\u20cf]*$"
_FOLDS = {"ß": "ss", "ŉ": "ʼn", "ǰ": "ǰ"}


def norm_folded(c: Column) -> Column:
    """norm_text() with full case folding: only texts with letters beyond Latin go through Python."""
    plain = norm_text(c)
    latin = F.translate(plain, "µſ", "μs")
    for a, b in _FOLDS.items():
        latin = F.replace(latin, F.lit(a), F.lit(b))
    ascii, cased = F.octet_length(c) == F.char_length(c), c.rlike(PLAINLY_CASED)
    # Spark calls a Python function for every row, whatever stands around it: the others must give it a null
    return F.when(ascii, plain).when(cased, latin).otherwise(casefolded(F.when(~ascii & ~cased, plain)))


def folded(c: Column) -> Column:
    """Texts fold alike exactly where full case folding makes them equal ('STRASSE' and 'straße', 'ΣΟΦΟΣ' and 'σοφος'), all in the JVM.

    Going up and down again does that but for four letters: capital sharp s, which is its own capital, dotless i, which is none of i's, and the two small
    sigmas. What stands between up and down also keeps the optimiser from taking them for down alone.
    """
    whole = F.lower(F.translate(F.upper(F.translate(c, "ẞı", "ß\ufdd0")), "Σ\ufdd0", "σı"))
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(whole)


def norm_equal(c: Column) -> Column:
    """What texts are compared by in scoring: case folded, runs of white space single, trimmed."""
    return F.trim(F.regexp_replace(folded(c), r"(?U)\s+", " "))  # white space last: folding reads its text several times


def norm_text(c: Column) -> Column:
    """Lower case, runs of white space single, trimmed; punctuation stays."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


WHITE = " \t\n\r\f\x0b"


def normalize_label(c: Column) -> Column:
    """A classifier's label: outer space, quotes and backticks, then one full stop go; empty is null."""
    bare = F.btrim(F.btrim(F.btrim(c, F.lit(WHITE)), F.lit("`\"'")), F.lit(WHITE))
    return F.nullif(F.lower(F.btrim(F.regexp_replace(bare, r"\.\z", ""), F.lit(WHITE))), F.lit(""))


def repair_json(c: Column) -> Column:
    """The object inside a reply: fence unwrapped, then first brace to last brace; null without an object."""
    fenced = F.regexp_extract(c, r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = F.when(c.rlike(r"(?is)```(?:json)?\s*.*?```"), fenced).otherwise(c)
    return F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))


def cut_at_first(c: Column, *patterns: str) -> Column:
    """The text before the earliest match of any pattern."""
    places = [F.nullif(F.regexp_instr(c, F.lit(p)), F.lit(0)) for p in patterns]
    first = F.least(*places) if len(places) > 1 else places[0]
    return F.when(first.isNull(), c).otherwise(c.substr(F.lit(1), first - 1))


# Where quoted history and signatures begin.
QUOTE_MARKERS = (r"(?md)^On .*wrote:$", r"(?mdi)^-+\s*Original Message\s*-+$", r"(?md)^_{5,}$", r"(?md)^From:.*$")
SIGNATURE_MARKERS = (r"(?md)^-- $", r"(?mdi)^Sent from my \w+", r"(?mdi)^Get Outlook for \w+")


def strip_quoted(c: Column) -> Column:
    """Trailing lines that are blank or begin with '>' go."""
    return F.regexp_replace(c, r"(?:(?:^|\n)(?:>[^\n]*|[ \t]*))+\z", "")


def clean_body(c: Column) -> Column:
    """An e-mail body without the quoted reply and signature, blank lines single, trimmed."""
    bare = strip_quoted(cut_at_first(cut_at_first(c, *QUOTE_MARKERS), *SIGNATURE_MARKERS))
    return F.btrim(F.regexp_replace(bare, r"\n{3,}", "\n\n"), F.lit(" \t\n"))


def is_reply(subject: Column) -> Column:
    return F.lower(F.trim(subject)).startswith("re:")


def slug(c: Column) -> Column:
    """Runs of characters that a file name should not hold become one dash."""
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-")


# Questions about products or stock inside an order's text.
INQUIRY = (
    r"\bdo you (?:stock|have|carry|supply|sell)\b",
    r"\bdo you offer\b",
    r"\bis there a\b",
    r"\bare there any\b",
    r"\bwhat(?:'s| is) the (?:price|cost|lead time|moq)\b",
    r"\bcan you (?:source|get|supply)\b",
)


def is_inquiry(c: Column) -> Column:
    return c.rlike("(?i)" + "|".join(INQUIRY))


def po_pattern(template: Column) -> Column:
    """Regular expression of a purchase-order template, '#' being a digit."""
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(template, r"([\\.^$|?*+()\[\]{}])", r"\\$1"), F.lit("#"), F.lit(r"\d")), F.lit("$"))


def note_tags(c: Column) -> Column:
    """(tag, qualifier) for words like 'quirk:' or 'protocol:' and the word after."""
    words = F.transform(F.split(F.trim(c), r"\s+"), lambda w: F.btrim(w, F.lit(",.;()")))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.struct(F.element_at(words, i).alias("tag"), F.try_element_at(words, i + 1).alias("qualifier")))
    return F.filter(pairs, lambda p: p["tag"].rlike("^(?:quirk|protocol):$"))


def missing_fields(headers: dict[str, Column], lines: Column, required: list[str]) -> Column:
    """Names of header fields that are null or empty, and of null or empty required fields of each line (0 is a value)."""
    head = [F.when(F.coalesce(c.cast("string"), F.lit("")) == "", F.lit(n)) for n, c in headers.items()]
    none = F.when(F.coalesce(F.size(lines), F.lit(0)) < 1, F.lit("line_items"))
    per = F.flatten(F.transform(F.coalesce(lines, F.array()), lambda x, i: F.array(*(F.when(F.coalesce(x[f].cast("string"), F.lit("")) == "", F.concat(F.lit("line_items."), i.cast("string"), F.lit(f".{f}"))) for f in required))))
    return F.array_compact(F.concat(F.array(*head, none), per))


def masked(text: Column, surfaces: Column, mark: str = "\ufffd") -> Column:
    """The text with every surface replaced, longest first."""
    ordered = F.array_sort(F.array_distinct(surfaces), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.aggregate(ordered, text, lambda rest, s: F.replace(rest, s, F.lit(mark)))


def contained(text: Column, surfaces: Column) -> Column:
    """Whether every surface occurs, a short one outside of the longer surfaces that hold it."""
    return F.forall(surfaces, lambda s: F.instr(masked(text, F.filter(surfaces, lambda x: (x != s) & x.contains(s))), s) > 0)


def transposed(text: Column, at: Column) -> Column:
    """The characters at ``at`` (from 1) and after it exchanged; a place without a next one changes nothing."""
    swapped = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.lit(1)), F.substring(text, at, F.lit(1)), F.substring(text, at + 2, F.length(text)))
    return F.when((at >= 1) & (at < F.length(text)), swapped).otherwise(text)


def price_text(cents: Column) -> Column:
    return F.format_string("$%d.%02d", F.floor(cents / 100).cast("long"), F.pmod(cents, F.lit(100)).cast("long"))


def local_time(c: Column, zone: str, year: int | None = None) -> Column:
    """UTC time of 'YYYY-MM-DD HH:MM' in ``zone``; null if it is not such a text, no real time, or of another year."""
    at = F.when(c.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm")))
    return F.to_utc_timestamp(at if year is None else F.when(F.year(at) == year, at), zone)


def stripped_schema(c: Column, keywords: tuple[str, ...] = ("minLength", "minimum")) -> Column:
    """A JSON schema without some keywords, at any depth; null if it is no JSON.

    What stands under ``properties`` are names: one that is called like a keyword stays, and so do values of enum, const, default and examples.
    """
    gone = frozenset(keywords)

    def walk(node: object, names: bool) -> object:
        if isinstance(node, list):
            return [walk(v, False) for v in node]
        if not isinstance(node, dict):
            return node
        return {k: v if not names and k in ("enum", "const", "default", "examples") else walk(v, not names and k in ("properties", "$defs")) for k, v in node.items() if names or k not in gone}

    def strip(text: str | None) -> str | None:
        try:
            return json.dumps(walk(json.loads(text), False), ensure_ascii=False, separators=(",", ":")) if text is not None else None
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf(StringType())
    def stripped(texts: pd.Series) -> pd.Series:
        return texts.map(strip)

    return stripped(c)
