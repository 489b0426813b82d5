"""E-mail: MIME parsing to rows, in Arrow batches, with failures kept apart."""

from __future__ import annotations

import re
from email import message_from_string, policy
from email.message import Message
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

from docket.functions.columns import clean_body, is_reply

FIELDS = ("subject", "sender", "date", "in_reply_to", "references", "body", "error")


class _Text(HTMLParser):
    BREAKS = frozenset("p div br li tr h1 h2 h3 h4 ul ol table blockquote".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in self.BREAKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag in self.BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def html_text(page: str) -> str:
    """Text of an HTML body: blocks on lines of their own, links and images as their text."""
    parser = _Text()
    parser.feed(page)
    lines = (" ".join(x.split()) for x in "".join(parser.out).split("\n"))
    return "\n".join(x for x in lines if x)


# The same messages, but headers that come again, such as content types, are parsed once: a header object never changes.
POLICY = policy.default.clone(header_factory=lru_cache(1024)(policy.default.header_factory))
_WORD = r"[A-Za-z0-9]+(?:[._+-][A-Za-z0-9]+)*"
PLAIN = {"subject": re.compile(rf"{_WORD}(?: {_WORD})*"), "from": re.compile(rf"{_WORD}@{_WORD}")}


def header(m: Message, name: str) -> str | None:
    """The text of a header; a plain one is what it says, any other goes through the parser."""
    raw = next((v for k, v in m.raw_items() if k.lower() == name), None)
    if raw is not None and name in PLAIN and len(raw) < 200 and PLAIN[name].fullmatch(raw):
        return raw
    return None if raw is None else str(m.get(name))


def parse_message(raw: str) -> dict:
    out = dict.fromkeys(FIELDS)
    try:
        m = message_from_string(raw, policy=POLICY)
        parts = [p for p in m.walk() if not p.is_multipart()]
        plain = next((p for p in parts if p.get_content_type() == "text/plain"), None)
        rich = next((p for p in parts if p.get_content_type() == "text/html"), None)
        body = plain.get_content() if plain else html_text(rich.get_content()) if rich else ""
        for name in ("subject", "date", "in_reply_to", "references"):
            out[name] = header(m, name.replace("_", "-"))
        return out | {"sender": header(m, "from"), "body": body.replace("\r\n", "\n")}
    except Exception as e:  # one bad message must not end the batch
        return out | {"error": f"{type(e).__name__}: {e}"}


@pandas_udf(StructType([StructField(f, StringType()) for f in FIELDS]))
def parse_messages(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_message(x or "") for x in raw], columns=list(FIELDS)).astype(object)


def standardized(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds m (parsed parts), body (cleaned), reply flag and asks: a short body (under 25 words) of a reply asks for its thread."""
    x = messages.withColumn("m", parse_messages(F.col(raw))).withColumn("body", clean_body(F.coalesce("m.body", F.lit(""))))
    x = x.withColumn("is_reply", F.col("m.in_reply_to").isNotNull() | F.coalesce(is_reply(F.col("m.subject")), F.lit(False)))
    words = F.size(F.filter(F.split("body", r"\s+"), lambda w: w != ""))
    return x.withColumn("asks", F.when(F.col("is_reply") & (words < 25), F.array(F.lit("short_reply"))).otherwise(F.array().cast("array<string>")))
