"""Evaluation of predicted orders against gold records: joins, tallies over aligned line items, slices and reports.

A record has id, email_class and gold (ORDER, null where a record carries no order); a prediction has id, classification and
extraction (PREDICTION, null where none was tried). Tallies are one row a record and merge by sums; ratios come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions.columns import norm_equal, ratio
from docket.operators.align import COUNTS, EXHAUSTIVE, compared, paired
from docket.operators.orders import route_of
from docket.operators.scoring import prf

# The fields of an order.
ORDER_FIELDS = ("customer_po_text", "requested_date_text", "delivery_address_text", "buyer_name_text")
ITEM_FIELDS = ("product_text", "quantity", "unit_text", "unit_price_text")
LINE = "struct<product_text:string,quantity:bigint,unit_text:string,unit_price_text:string,item_notes:string>"
ORDER = f"struct<{','.join(f'{f}:string' for f in ORDER_FIELDS)},notes:string,line_items:array<{LINE}>>"
PREDICTION = f"struct<parsed:{ORDER},repair_used:boolean>"
CLASSES = ("new_order", "amendment", "cancellation", "inquiry", "other")
# What records are sliced by.
FLAGS = ("missing_po", "missing_quantity", "ambiguous_site", "discontinued_item", "qty_below_moq", "qty_above_max", "pack_size_trap", "mention_typo", "unsigned", "prices_stated", "price_mismatch")
LAYOUTS = ("dash_list", "x_list", "reverse_list", "prose")
PLACEMENTS = ("subject_only", "body_only", "both")


def empty_order() -> Column:
    """An order with no field and no line: what a missing extraction is scored as."""
    return F.from_json(F.lit('{"line_items": []}'), ORDER)


def reference_predictions(records: DataFrame, kind: str) -> DataFrame:
    """Predictions that bound a score: "oracle" repeats the gold, "empty" predicts no class and an empty order."""
    if kind not in ("oracle", "empty"):
        raise ValueError(f"no reference predictor {kind!r}")
    order, label = (F.col("gold"), F.col("email_class")) if kind == "oracle" else (empty_order(), F.lit(None).cast("string"))
    extraction = F.when(F.col("gold").isNotNull(), F.struct(order.alias("parsed"), F.lit(False).alias("repair_used")))
    return records.select("id", label.alias("classification"), extraction.cast(PREDICTION).alias("extraction"))


def with_predictions(records: DataFrame, predictions: DataFrame, missing: str = "error") -> DataFrame:
    """Records with classification and extraction. A record without a prediction is an error, skipped ("skip") or kept without one ("empty")."""
    p = predictions.select("id", "classification", "extraction", F.lit(True).alias("predicted"))
    joined = records.join(p, "id", "inner" if missing == "skip" else "left")
    if missing == "error":
        joined = joined.where(F.coalesce("predicted", F.raise_error(F.concat(F.lit("no prediction for record "), F.col("id").cast("string"))).cast("boolean")))
    return joined.drop("predicted")


def _same(g: Column, p: Column) -> Column:
    return norm_equal(g.cast("string")) == norm_equal(p.cast("string"))


def _words(c: Column) -> Column:
    return F.filter(F.split(norm_equal(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")


def _overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of words."""
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(times(a, w), times(b, w)))


def tallies(joined: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per record with gold: the kept columns, fields (array of COUNTS per field), parsed, repair_used, alignment and note-token counts.

    Items pair by the greatest total similarity; slots of an unpaired gold item are misses, of an unpaired predicted one hallucinations.
    """
    x = joined.where("gold is not null")
    order, parsed = F.col("extraction.parsed"), F.col("extraction.parsed").isNotNull()
    # Fields one by one: code that carries whole orders from row to row is too long for the JVM to compile.
    flat = [F.col(f"{side}.{f}").alias(f"{name}_{f}") for side, name in (("gold", "g"), ("extraction.parsed", "p")) for f in (*ORDER_FIELDS, "notes")]
    lines = F.when(parsed, order["line_items"]).otherwise(F.array().cast(f"array<{LINE}>"))
    x = x.select("id", *keep, *flat, F.col("gold.line_items").alias("gi"), lines.alias("pi"), parsed.alias("parsed"), F.coalesce("extraction.repair_used", F.lit(False)).alias("repair"))
    gi, pi = F.col("gi"), F.col("pi")
    head = lambda side: F.struct(*(F.col(f"{side}_{f}").alias(f) for f in ORDER_FIELDS))
    x = x.withColumn("slots", compared(gi, pi, head("g"), head("p"))).withColumn("pairs", F.col("slots.pairs"))
    pairs = F.transform("pairs", lambda e: F.struct(F.get(gi, e["i"]).alias("g"), F.get(pi, e["j"]).alias("p")))
    x = x.withColumn("both", pairs)
    g, p = _words(F.col("g_notes")), _words(F.col("p_notes"))
    item_words = lambda items: F.aggregate(F.transform(items, lambda i: F.size(_words(i["item_notes"]))), F.lit(0), lambda a, n: a + n)
    item_overlap = F.aggregate(F.transform("both", lambda e: _overlap(_words(e["g"]["item_notes"]), _words(e["p"]["item_notes"]))), F.lit(0), lambda a, n: a + n)
    greedy = (F.size(gi) > 0) & (F.size(pi) > 0) & ((F.size(gi) > EXHAUSTIVE) | (F.size(pi) > EXHAUSTIVE))
    numbers = {
        "parsed": F.col("parsed"), "repair_used": F.col("repair"), "gold_items": F.size(gi), "pred_items": F.size(pi), "matched": F.size("pairs"), "greedy_runs": greedy,
        "product_correct": F.get("slots.fields", F.lit(len(ORDER_FIELDS)))["correct"],
        "notes_overlap": _overlap(g, p), "notes_gold": F.size(g), "notes_pred": F.size(p), "item_notes_overlap": item_overlap, "item_notes_gold": item_words(gi), "item_notes_pred": item_words(pi),
    }
    return x.select("id", *keep, F.col("slots.fields"), *(c.cast("long").alias(n) for n, c in numbers.items()))


def field_report(tally: DataFrame, by: list[str] = ("field",)) -> DataFrame:
    """Counts and rates per field, or over all fields where ``by`` does not name "field"."""
    c = lambda n: F.col(n)
    s = tally.select(*(b for b in by if b != "field"), F.explode("fields").alias("f")).select(*(b for b in by if b != "field"), "f.*")
    s = s.groupBy(*by).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in COUNTS))
    return s.select(
        *by, *COUNTS, *prf(c("correct"), c("wrong") + c("hallucination"), c("wrong") + c("miss")),
        ratio(c("correct") + c("null_agree"), c("correct") + c("wrong") + c("hallucination") + c("miss") + c("null_agree")).alias("accuracy"),
        ratio(c("strict_correct"), c("correct")).alias("strict_rate"), ratio(c("hallucination"), c("hallucination") + c("null_agree")).alias("hallucination_rate"),
    )


def record_report(tally: DataFrame, by: list[str] = ()) -> DataFrame:
    """Records, parse and repair rates, alignment precision, recall and F1, note-token F1."""
    names = ("parsed", "repair_used", "gold_items", "pred_items", "matched", "greedy_runs", "product_correct", "notes_overlap", "notes_gold", "notes_pred", "item_notes_overlap", "item_notes_gold", "item_notes_pred")
    s = tally.groupBy(*by).agg(F.count("*").alias("records"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    c = lambda n: F.col(n)
    f1 = lambda a, x, y: ratio(2 * c(a), c(x) + c(y))
    return s.select(
        *by, "records", *names, ratio(c("parsed"), c("records")).alias("parse_rate"), ratio(c("repair_used"), c("records")).alias("repair_rate"),
        ratio(c("product_correct"), c("pred_items")).alias("alignment_precision"), ratio(c("product_correct"), c("gold_items")).alias("alignment_recall"), f1("product_correct", "pred_items", "gold_items").alias("alignment_f1"),
        f1("notes_overlap", "notes_gold", "notes_pred").alias("notes_f1"), f1("item_notes_overlap", "item_notes_gold", "item_notes_pred").alias("item_notes_f1"),
    )


def slices(source: str = "synthetic") -> dict[str, Column]:
    """Predicates over email_class, flags (map), route, layout and po_placement: 26 slices, 5 for hand-written records."""
    c = F.col("email_class")
    out = {f"class:{k}": c == k for k in CLASSES}
    if source == "synthetic":
        out |= {f"flag:{k}": (c == "new_order") & F.coalesce(F.try_element_at("flags", F.lit(k)), F.lit(False)) for k in FLAGS}
        out |= {f"{column}:{k}": F.col(column) == k for column, values in (("route", ("touchless", "clarification", "exception")), ("layout", LAYOUTS), ("po_placement", PLACEMENTS)) for k in values}
    return out


def slice_report(joined: DataFrame, source: str = "synthetic") -> DataFrame:
    """Per slice: n, accuracy, n_extraction, headline_f1 and alignment_f1 (null without gold); slices without records have n = 0."""
    named = slices(source)
    marked = joined.withColumn("slices", F.array_compact(F.array(*(F.when(p, F.lit(n)) for n, p in named.items()))))
    hit = (F.col("email_class") == F.col("classification")).cast("long")
    per = marked.select(F.explode("slices").alias("slice"), F.coalesce(hit, F.lit(0)).alias("hit")).groupBy("slice").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    t = tallies(marked, ["slices"]).withColumn("slice", F.explode("slices")).drop("slices")
    # Both reports from one grouping: the field counts of a record add up before the shuffle.
    over = lambda n: F.aggregate("fields", F.lit(0).cast("long"), lambda a, f: a + f[n]).alias(n)
    flat = t.select("slice", "product_correct", "pred_items", "gold_items", *map(over, ("correct", "wrong", "hallucination", "miss")))
    s = flat.groupBy("slice").agg(F.count("*").alias("n_extraction"), *(F.sum(c).alias(c) for c in flat.columns[1:]))
    f1 = ratio(2 * F.col("correct"), 2 * (F.col("correct") + F.col("wrong")) + F.col("hallucination") + F.col("miss"))
    s = s.select("slice", "n_extraction", f1.alias("headline_f1"), ratio(2 * F.col("product_correct"), F.col("pred_items") + F.col("gold_items")).alias("alignment_f1"))
    dim = joined.sparkSession.createDataFrame([(n,) for n in named], "slice string")
    found = dim.join(per, "slice", "left").join(s, "slice", "left")
    return found.select("slice", F.coalesce("n", F.lit(0)).cast("long").alias("n"), ratio(F.col("hits"), F.col("n")).alias("accuracy"), F.coalesce("n_extraction", F.lit(0)).cast("long").alias("n_extraction"), "headline_f1", "alignment_f1")


def trap_report(joined: DataFrame, traps: str) -> DataFrame:
    """Recall of the lines of new orders whose places are in the array ``traps``: records, items, matched and recall per field."""
    x = joined.where((F.col("email_class") == "new_order") & (F.size(traps) > 0) & F.col("gold").isNotNull())
    pi = F.coalesce("extraction.parsed.line_items", F.array().cast(f"array<{LINE}>"))
    gi = F.col("gold.line_items")
    x = x.select("id", traps, gi.alias("g"), pi.alias("p"), paired(gi, pi).alias("pairs")).withColumn("at", F.explode(traps))
    j = F.get(F.filter("pairs", lambda e: e["i"] == F.col("at")), F.lit(0))["j"]
    x = x.select("id", F.get("g", F.col("at")).alias("g"), F.get("p", j).alias("p"), j.isNotNull().alias("hit"))
    fields = ("product_text", "quantity", "unit_text")
    right = [F.count_if(_same(F.col(f"g.{f}"), F.col(f"p.{f}"))).alias(f"{f}_hits") for f in fields]
    s = x.agg(F.count_distinct("id").alias("records"), F.count("*").alias("items"), F.count_if("hit").alias("matched"), *right, *(F.count(f"g.{f}").alias(f"{f}_slots") for f in fields))
    return s.select("records", "items", ratio(F.col("matched"), F.col("items")).alias("match_rate"), *(ratio(F.col(f"{f}_hits"), F.col(f"{f}_slots")).alias(f"{f}_recall") for f in fields))


def semantics_report(joined: DataFrame) -> DataFrame:
    """Lines matched by quantity, unit and turn, whatever the alignment: totals, rates and the gap between a product held and met exactly."""
    side = lambda items, name: joined.where("gold is not null").select("id", F.posexplode(items).alias("at", "i")).where("i.quantity is not null").select("id", F.col("i.quantity").alias("q"), norm_equal(F.col("i.unit_text")).alias("u"), F.struct("at", norm_equal(F.col("i.product_text")).alias("product")).alias("i"), F.lit(name).alias("side"))
    both = side(F.col("gold.line_items"), "g").union(side(F.col("extraction.parsed.line_items"), "p"))
    keyed = both.groupBy("id", "q", "u").agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("i")))).alias(s) for s in "gp"))
    met = F.filter(F.arrays_zip("g", "p"), lambda z: z["g"].isNotNull() & z["p"].isNotNull())
    n = lambda test: F.coalesce(F.sum(F.size(F.filter("met", test))), F.lit(0)).alias
    x = keyed.withColumn("met", met)
    s = x.agg(
        F.coalesce(F.sum(F.size("g")), F.lit(0)).alias("anchorable_gold"), F.coalesce(F.sum(F.size("p")), F.lit(0)).alias("anchorable_pred"), F.coalesce(F.sum(F.size("met")), F.lit(0)).alias("matched"),
        n(lambda z: z["g"]["product"] == z["p"]["product"])("product_exact"), n(lambda z: z["p"]["product"].contains(z["g"]["product"]))("product_contains"),
    )
    c = lambda k: F.col(k)
    return s.select("*", ratio(c("matched"), c("anchorable_gold")).alias("match_rate"), ratio(c("product_exact"), c("matched")).alias("product_exact_rate"), ratio(c("product_contains"), c("matched")).alias("product_contains_rate"), ratio(c("product_contains") - c("product_exact"), c("matched")).alias("span_gap"))


def semantics_totals(joined: DataFrame) -> DataFrame:
    """semantics_report() with the hits of quantity and unit and the rate of the latter. Lines are matched by both, so each matched line hits both."""
    return semantics_report(joined).select("*", F.col("matched").alias("quantity_hit"), F.col("matched").alias("unit_hit"), ratio(F.col("matched"), F.col("matched")).alias("unit_hit_rate"))


def calibration_pairs(joined: DataFrame, confidences: str) -> DataFrame:
    """(field, confidence, correct) of each predicted slot with a confidence in the map ``confidences``; lines pair by place, up to the shorter list.

    Records without a parsed extraction give none. Both null is correct.
    """
    x = joined.where("gold is not null and extraction.parsed is not null")
    right = lambda g, p: F.coalesce(_same(g, p), g.isNull() & p.isNull())
    part = lambda name, path, g, p: F.struct(F.lit(name).alias("field"), F.try_element_at(F.col(confidences), path).alias("confidence"), right(g, p).alias("correct"))
    head = [part(f, F.lit(f), F.col(f"gold.{f}"), F.col(f"extraction.parsed.{f}")) for f in ORDER_FIELDS]
    g, p = F.col("gold.line_items"), F.col("extraction.parsed.line_items")
    n = F.least(F.size(g), F.size(p))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    lines = F.flatten(F.transform(places, lambda i: F.array(*(part(f"line_items.{f}", F.concat(F.lit("line_items."), i.cast("string"), F.lit(f".{f}")), F.get(g, i)[f], F.get(p, i)[f]) for f in ITEM_FIELDS))))
    return x.select(F.explode(F.concat(F.array(*head), lines)).alias("c")).select("c.*").where("confidence is not null")


def route_report(joined: DataFrame) -> DataFrame:
    """One row: n, routing and classification accuracy, predictions without a route, and what routing forgives (gap)."""
    gold, pred = route_of(F.col("email_class")), route_of(F.col("classification"))
    s = joined.agg(F.count("*").alias("n"), F.count_if(gold == pred).alias("routed"), F.count_if(F.col("email_class") == F.col("classification")).alias("classed"), F.count_if(pred.isNull()).alias("invalid_route"))
    routing, classing = ratio(F.col("routed"), F.col("n")), ratio(F.col("classed"), F.col("n"))
    return s.select("n", routing.alias("routing_accuracy"), classing.alias("classification_accuracy"), "invalid_route", (routing - classing).alias("gap"))


def route_confusion(joined: DataFrame) -> DataFrame:
    """Wrong routes: (gold_route, pred_route, n), "invalid" for a prediction without one."""
    gold, pred = F.coalesce(route_of(F.col("email_class")), F.lit("none")), F.coalesce(route_of(F.col("classification")), F.lit("invalid"))
    return joined.select(gold.alias("gold_route"), pred.alias("pred_route")).where("gold_route <> pred_route").groupBy("gold_route", "pred_route").agg(F.count("*").alias("n"))


def run_table(names: DataFrame, reports: DataFrame) -> DataFrame:
    """Each wanted run (run, place) with its figures, or with status "missing"."""
    found = names.join(reports.withColumn("status", F.lit("ok")), "run", "left")
    return found.withColumn("status", F.coalesce("status", F.lit("missing")))
