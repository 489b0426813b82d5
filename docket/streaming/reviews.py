"""The review as a stream: where items stand is a keyed table, into which each micro-batch of decisions is folded.

A batch's decisions come after the status and edits that the table holds of their items, and are judged and settled (resolved, sent, held, amended) by the windows and joins
of reviewing.py, not in Python row by row. The stream restarts from its checkpoint: a batch that runs again changes nothing. edited(), complete() and version() are the
plain form of an order's edits, which the tests hold the columns to.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.operators.evaluation import ORDER, ORDER_FIELDS
from docket.operators.flow import DELETED, LINE_FIELDS
from docket.operators.reviewing import decided, orders_of, resumed, settled
from docket.sources.store import written
from docket.streaming.upserts import KeyedTable

SUBMITTED = f"item bigint, batch bigint, at timestamp, seq bigint, extraction {ORDER}"
EMPTY = {f: None for f in (*ORDER_FIELDS, "notes")} | {"line_items": []}


def edited(order: dict | None, edits: dict[str, str]) -> dict:
    """flow.apply_edits() of one order; see there."""
    out = {f: edits.get(f, (order or EMPTY)[f]) for f in (*ORDER_FIELDS, "notes")}
    lines = [dict(line) for line in (order or EMPTY)["line_items"] or []]
    paths = [(int(m[1]), m[2], v) for k, v in edits.items() if (m := re.fullmatch(r"line_items\.([0-9]+)(?:\.(.*))?", k, re.S))]
    for place in sorted({p for p, f, v in paths if f is not None and v != DELETED}):
        if place == len(lines):
            lines.append(dict.fromkeys(LINE_FIELDS))
    for place, field, value in paths:
        if field in LINE_FIELDS and place < len(lines) and value != DELETED:
            whole = re.fullmatch(r"[ \t\n\r\f\v]*(-*[0-9]+)[ \t\n\r\f\v]*", value) if field == "quantity" else None
            lines[place][field] = value if field != "quantity" else int(whole[1]) if whole and not whole[1].startswith("--") else None
    gone = {p for p, _, v in paths if v == DELETED}
    return out | {"line_items": [line for k, line in enumerate(lines) if k not in gone]}


def complete(order: dict) -> bool:
    """Whether flow.missing_after() finds nothing."""
    blank = lambda v: v is None or v == ""
    return bool(order["line_items"]) and not any(blank(order[f]) for f in ORDER_FIELDS) and not any(blank(line[f]) for line in order["line_items"] for f in ("product_text", "quantity"))


def version(edits: dict[str, str]) -> str:
    return json.dumps([{"key": k, "value": v} for k, v in sorted(edits.items())], ensure_ascii=False, separators=(",", ":"))


def first_submissions(old: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each item the submission of the earliest batch, there the first by at and seq."""
    both = old.unionByName(rows)
    return both.groupBy("item").agg(F.min_by(F.struct(*both.columns), F.struct("batch", "at", "seq")).alias("row")).select("row.*")


def review_stream(log: DataFrame, table: KeyedTable, terms: DataFrame, products: DataFrame, checkpoint: str) -> int:
    """Run over all that is there now (availableNow) and return the number of batches. ``log`` is a stream of reviewing.LOG, ``table`` has the
    schema reviewing.STATE and the key item. Orders submitted are kept in a keyed table of their own beside the checkpoint."""
    submitted = KeyedTable(table.spark, f"{checkpoint.rstrip('/')}-submitted", SUBMITTED, ["item"], table.buckets)
    done: list[int] = []

    def merge(rows: DataFrame, batch: int) -> None:
        first = rows.where("action = 'submitted' and item is not null").select("item", F.lit(batch).cast("bigint").alias("batch"), "at", "seq", "extraction")
        submitted.merge(first, batch, first_submissions)
        known = submitted.read()

        def fold(old: DataFrame, decisions: DataFrame) -> DataFrame:
            log = written(resumed(old, known, decisions, batch), "resumed")
            orders = orders_of(log)
            return settled(old, written(decided(log, orders), "decided"), terms, products, orders)

        table.merge(rows.where("action <> 'submitted' and item is not null"), batch, fold)
        done.append(batch)

    log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(done)
