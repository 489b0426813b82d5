"""Review and audit of extracted orders: flags, reasons, messages, corrections, verdicts, ledgers, caches, gates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, MapType, StringType

from docket.functions.columns import ratio
from docket.operators.orders import in_band
from docket.operators.scoring import interpolate


# --- review items ----------------------------------------------------------------------------------------------------
def field_flags(confidence: Column, knots: list[tuple[float, float]]) -> Column:
    """Per field path of a confidence map: raw and calibrated confidence, and whether the raw one is in the band."""
    return F.transform(
        F.map_entries(confidence),
        lambda e: F.struct(e["key"].alias("path"), e["value"].alias("raw_confidence"), interpolate(e["value"], knots).alias("calibrated_confidence"), in_band(e["value"]).alias("in_band")),
    )


def reason(violations: Column, asks: Column, n_band: Column) -> Column:
    """(kind, label) that a queue shows: the first violation, else the first ask, else the number of fields in the band."""
    ask = F.get(asks, 0)
    fields = F.concat(n_band.cast("string"), F.when(n_band == 1, " field").otherwise(" fields"), F.lit(" — model moderately confident"))
    label = F.when(F.size(violations) > 0, F.get(violations, 0)).when(F.size(asks) > 0, ask).otherwise(fields)
    kind = F.when(F.size(violations) > 0, "violation").when(F.size(asks) > 0, F.when(F.lower(ask).contains("reply"), "reply").otherwise("violation")).otherwise("band")
    return F.struct(kind.alias("kind"), label.alias("label"))


def policy_violations(route: Column, has_extraction: Column) -> Column:
    """Breaches of the routing contract: only the extract route carries an extraction, and it must."""
    return F.array_compact(
        F.array(
            F.when(route.isNull(), "no route assigned"),
            F.when((route == "extract") & ~has_extraction, "EXTRACT route without an extraction"),
            F.when((route != "extract") & has_extraction, F.concat(route, F.lit(" route carries an unexpected extraction"))),
        )
    )


def _reference(po: Column) -> Column:
    return F.coalesce(F.nullif(po, F.lit("")), F.lit("(no PO)"))


def submitted_message(po: Column, order_id: Column, n_lines: Column, total_cents: Column) -> Column:
    lines = F.when(n_lines == 1, " line, $").otherwise(" lines, $")
    return F.concat(F.lit("Order "), _reference(po), F.lit(" accepted into the ERP as "), order_id, F.lit(" — "), n_lines.cast("string"), lines, F.format_number(total_cents / 100, 2), F.lit("."))


def held_message(po: Column, unresolved: Column, issues: Column) -> Column:
    part = lambda names, text: F.when(F.size(names) > 0, F.concat(F.size(names).cast("string"), F.lit(text), F.array_join(names, ", ")))
    detail = F.concat_ws("; ", part(unresolved, " product(s) not matched to a SKU: "), part(issues, " quantity issue(s): "))
    return F.concat(F.lit("Order "), _reference(po), F.lit(" held for manual mapping — "), detail, F.lit("."))


def corrections(items: DataFrame, status: str = "status", edits: str = "edits", extraction: str = "extraction") -> DataFrame:
    """Reviewed items that correct an extraction, with correction_type: edited (edits made, then edited or approved) or rejected."""
    has_edits = F.coalesce(F.size(F.col(edits)), F.lit(0)) > 0
    kind = F.when(F.col(status).isin("edited", "approved") & has_edits, "edited").when(F.col(status) == "rejected", "rejected")
    return items.withColumn("correction_type", F.when(F.col(extraction).isNotNull(), kind)).where("correction_type is not null")


def training_corrections(items: DataFrame, **names: str) -> DataFrame:
    """Corrections that say what is right; a rejection does not."""
    return corrections(items, **names).where("correction_type = 'edited'")


def receipts(orders: DataFrame, content: list[str]) -> DataFrame:
    """Order number from the order's content: sending the same order again gives the same number."""
    return orders.withColumn("order_id", F.concat(F.lit("ORD-"), F.upper(F.substring(F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content)), 256), 1, 8))))


def submit_once(sent: DataFrame, item: str, edits: str, time: str, tie: str) -> DataFrame:
    """Of submissions of an item with the same edits only the first goes out."""
    return sent.groupBy(item, edits).agg(F.min_by(F.struct(time, tie), F.struct(time, tie)).alias("first"), F.count("*").alias("attempts")).select(item, edits, f"first.{tie}", "attempts")


# --- confidence ------------------------------------------------------------------------------------------------------
def token_spans(tokens: Column) -> Column:
    """(start, end) of each token in their concatenation."""
    ends = F.aggregate(tokens, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
    return F.transform(tokens, lambda x, k: F.struct(F.get(ends, k).alias("start"), F.get(ends, k + 1).alias("end")))


@pandas_udf(MapType(StringType(), DoubleType()))
def field_confidences(tokens: pd.Series, logprobs: pd.Series, fields: pd.Series) -> pd.Series:
    """Confidence by path: the geometric mean of the probabilities of the tokens that touch the field's value.

    ``fields``: array of (path, key, value as JSON text) in the order written. A value is searched from its key onward,
    keys from the value before; one that is not there, or that no token touches, has no entry.
    """
    import numpy as np

    def one(words, logs, wanted) -> dict[str, float]:
        if words is None or wanted is None:
            return {}
        text = "".join(words)
        ends = np.cumsum([len(w) for w in words])
        before = np.concatenate([[0.0], np.cumsum(logs)])
        at, out = 0, {}
        for path, key, value in ((f["path"], f["key"], f["value"]) for f in wanted):
            at = max(at, text.find(f'"{key}"', at))
            start = text.find(value, at)
            start = start if start >= 0 else text.find(value)
            if start < 0:
                continue
            at = start + len(value)
            first, last = np.searchsorted(ends, start, "right"), min(np.searchsorted(ends, at, "left"), len(ends) - 1)
            if first <= last:
                out[path] = float(np.exp((before[last + 1] - before[first]) / (last + 1 - first)))
        return out

    return pd.Series([one(*r) for r in zip(tokens, logprobs, fields)])


# --- audit -----------------------------------------------------------------------------------------------------------
def verdict_problems(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """(line, problem) of a verdict file: ``lines`` (line, value), ``expected`` (line, id), both numbered from 1.

    A line is an object with exactly the keys id, realistic, labels_correct and notes, verdicts true, false or null, and
    the id expected there. Lines too many or missing are problems too.
    """
    v = F.col("value")
    parsed = F.try_parse_json(v)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant"))
    keys = F.array_sort(F.json_object_keys(v))
    judged = lambda k: F.coalesce(kind(k), F.lit("VOID")).isin("BOOLEAN", "VOID")
    problem = (
        F.when(v.isNull(), "missing line").when(F.trim(v) == "", "blank line").when(parsed.isNull(), "invalid JSON")
        .when(~F.coalesce(keys == F.array(*map(F.lit, ("id", "labels_correct", "notes", "realistic"))), F.lit(False)), "keys")
        .when(~(judged("realistic") & judged("labels_correct")), "verdict is not true, false or null")
        .when(~F.coalesce(kind("notes") == "STRING", F.lit(False)), "notes is not a string")
        .when(F.col("id").isNull(), "line too many").when(F.get_json_object(v, "$.id") != F.col("id"), "id out of order")
    )
    return lines.join(expected, "line", "full").select("line", problem.alias("problem")).where("problem is not null")


def verdict_progress(verdicts: DataFrame, *by: str) -> DataFrame:
    """Counts of tri-state verdicts (realistic, labels_correct): filled, partial, pending, and of each outcome."""
    r, c = F.col("realistic"), F.col("labels_correct")
    return verdicts.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(r.isNotNull() & c.isNotNull()).alias("filled"), F.count_if(r.isNull() != c.isNull()).alias("partial"), F.count_if(r.isNull() & c.isNull()).alias("pending"),
        F.count_if(r).alias("realistic_true"), F.count_if(~r).alias("realistic_false"), F.count_if(c).alias("labels_true"), F.count_if(~c).alias("labels_false"),
    )


def strata_of(strata: dict[str, Column]) -> Column:
    """Names of the strata that a row belongs to."""
    return F.array_compact(F.array(*(F.when(p, F.lit(n)) for n, p in strata.items())))


def coverage_sample(rows: DataFrame, strata: dict[str, Column], minimum: int, target: int, key: str, seed: int) -> DataFrame:
    """(key) of at least ``target`` rows holding ``minimum`` of every stratum, rarest stratum first.

    A row chosen for one stratum counts for all of its strata; the rest is filled by the least hashes. Only each
    stratum's ``minimum`` least hashed rows and the ``target`` least of all can be chosen, so no more than that is gathered.
    A stratum with fewer rows than ``minimum`` raises ValueError.
    """
    x = rows.select(key, strata_of(strata).alias("strata"), F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))).alias("o"))
    each = x.withColumn("s", F.explode("strata"))
    sizes = {r.s: r.n for r in each.groupBy("s").agg(F.count("*").alias("n")).collect()}  # one row per stratum
    if short := sorted(n for n in strata if sizes.get(n, 0) < minimum):
        raise ValueError(f"fewer than {minimum} rows in {', '.join(short)}")
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("o", key))).where(F.col("n") <= minimum)
    pool = sorted({(r.o, r[key], tuple(r.strata)) for part in (first, x.orderBy("o", key).limit(target)) for r in part.select("o", key, "strata").collect()})
    chosen: dict = {}
    for s in sorted(strata, key=lambda n: (sizes[n], n)):
        held = sum(s in names for names in chosen.values())
        free = [(k, names) for _, k, names in pool if s in names and k not in chosen]
        chosen.update(free[: max(0, minimum - held)])
    fill = [k for _, k, _ in pool if k not in chosen][: max(0, target - len(chosen))]
    return rows.sparkSession.createDataFrame([(k,) for k in [*chosen, *fill]], rows.select(key).schema)


def ledger(flagged: DataFrame, derived: DataFrame, key: str, kind: str) -> DataFrame:
    """Per kind: rows flagged, derived, both, and those of one side only; reconciled if no row is."""
    both = flagged.select(key, kind).distinct().withColumn("f", F.lit(1)).join(derived.select(key, kind).distinct().withColumn("d", F.lit(1)), [key, kind], "full")
    f, d = F.col("f").isNotNull(), F.col("d").isNotNull()
    out = both.groupBy(kind).agg(F.count_if(f).alias("flagged"), F.count_if(d).alias("derived"), F.count_if(f & d).alias("matched"), F.count_if(f & ~d).alias("flag_only"), F.count_if(d & ~f).alias("derived_only"))
    return out.withColumn("reconciled", (F.col("flag_only") == 0) & (F.col("derived_only") == 0))


def targeted_gate(cases: DataFrame, by: str) -> DataFrame:
    """Precision and recall of matched items over sums of (matched, pred_items, gold_items)."""
    sums = cases.groupBy(by).agg(*(F.sum(c).alias(c) for c in ("matched", "pred_items", "gold_items")))
    return sums.withColumn("precision", ratio(F.col("matched"), F.col("pred_items"))).withColumn("recall", ratio(F.col("matched"), F.col("gold_items")))


def composition(examples: DataFrame, label: str, n_lines: str, classes: list[str]) -> DataFrame:
    return examples.agg(F.count("*").alias("n"), *(F.count_if(F.col(label) == c).alias(c) for c in classes), F.round(F.coalesce(F.avg(n_lines), F.lit(0.0)), 3).alias("avg_line_items"))


# --- tables ----------------------------------------------------------------------------------------------------------
def cache_lookup(requests: DataFrame, cache: DataFrame, on: list[str], contract: list[str]) -> DataFrame:
    """Each request with its cached payload and outcome: hit, stale (another contract) or miss; a stale payload is not used."""
    held = cache.select(*on, F.struct(*contract).alias("held"), "payload")
    x = requests.withColumn("wanted", F.struct(*contract)).join(held, on, "left")
    outcome = F.when(F.col("held").isNull(), "miss").when(F.col("held").eqNullSafe(F.col("wanted")), "hit").otherwise("stale")
    return x.withColumn("outcome", outcome).withColumn("payload", F.when(F.col("outcome") == "hit", F.col("payload"))).drop("held", "wanted")


def last_per(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, as when a later record replaces an earlier one."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def first_per(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def most_common(rows: DataFrame, value: str, order: str, limit: int | None = None) -> DataFrame:
    """Counts of values, most frequent first, equal ones by first appearance."""
    x = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen")
    return x.limit(limit) if limit is not None else x


def term_conflicts(terms: DataFrame, term: str, owner: str) -> DataFrame:
    """Terms that name more than one thing, with how many."""
    return terms.groupBy(term).agg(F.count_distinct(owner).alias("owners")).where("owners > 1")


def failed_checks(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, problem) for each check that does not hold; null does not hold."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items())))
    return rows.select(key, F.explode(failed).alias("problem"))


def weighted_choice(draw: Column, weights: dict[str, int]) -> Column:
    """Name whose share of the summed weights holds ``draw`` (from 0, below the sum)."""
    out, upto = None, 0
    for name, w in weights.items():
        upto += w
        out = F.when(draw < upto, name) if out is None else out.when(draw < upto, name)
    return out


def markdown_rows(*cells: Column) -> Column:
    """A line of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("")) for c in cells)), F.lit(" |"))
