"""Evaluation: slot outcomes, alignment-free item semantics, classification, slices, bootstrap, calibration, gates.

All operators are lazy and work on counts that merge (integers first, ratios last), so they aggregate map-side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, NumericType, StructField, StructType

from docket.functions.columns import bucket, norm_equal, ratio

OUTCOMES = ("correct", "strict_correct", "wrong", "hallucination", "miss", "null_agree")


def slot_outcomes(df: DataFrame, fields: list[str], keep: list[str] = (), gold: str = "gold_", pred: str = "pred_") -> DataFrame:
    """One row per record and field: the kept columns, field, and a 0/1 column for each outcome."""
    slots = [F.struct(F.lit(f).alias("field"), F.col(gold + f).cast("string").alias("g"), F.col(pred + f).cast("string").alias("p")) for f in fields]
    long = df.select(*keep, F.explode(F.array(*slots)).alias("s")).select(*keep, "s.field", "s.g", "s.p")
    return long.select(*keep, "field", *(c.alias(n) for n, c in _flags(F.col("g"), F.col("p")).items()))


def _flags(g: Column, p: Column, free_text: bool = True) -> dict[str, Column]:
    """0 or 1 for each outcome of a slot; only texts that differ as they are have to be normalised."""
    strict = F.coalesce(g == p, F.lit(False))
    same = strict | F.coalesce(norm_equal(g) == norm_equal(p), F.lit(False)) if free_text else strict
    flags = {
        "correct": same, "strict_correct": strict, "wrong": g.isNotNull() & p.isNotNull() & ~same,
        "hallucination": g.isNull() & p.isNotNull(), "miss": g.isNotNull() & p.isNull(), "null_agree": g.isNull() & p.isNull(),
    }
    return {n: flags[n].cast("long") for n in OUTCOMES}


def _flags_of(df: DataFrame, field: str, gold: str, pred: str) -> dict[str, Column]:
    numbers = all(isinstance(df.schema[c + field].dataType, NumericType) for c in (gold, pred))
    return _flags(F.col(gold + field).cast("string"), F.col(pred + field).cast("string"), not numbers)


def slot_totals(df: DataFrame, fields: list[str], by: list[str] = (), gold: str = "gold_", pred: str = "pred_") -> DataFrame:
    """The outcomes of all fields counted per group: what slot_outcomes() adds up to, without a row for each slot."""
    each = [_flags_of(df, f, gold, pred) for f in fields]
    return df.groupBy(*by).agg(*(F.sum(reduce(add, (e[n] for e in each))).alias(n) for n in OUTCOMES))


def slot_counts(df: DataFrame, fields: list[str], by: list[str] = (), gold: str = "gold_", pred: str = "pred_") -> DataFrame:
    """The outcomes counted per group and field; records are aggregated as they lie, and only the counts become a row for each field."""
    sums = [F.struct(F.lit(f).alias("field"), *(F.sum(c).alias(n) for n, c in _flags_of(df, f, gold, pred).items())) for f in fields]
    rows = df.groupBy(*by).agg(F.array(*sums).alias("s")).select(*by, F.explode("s").alias("s"))
    return rows.select(*by, "s.*").where(F.col("correct").isNotNull())  # no records, no counts


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def slot_metrics(outcomes: DataFrame, by: list[str] = ()) -> DataFrame:
    """Precision, recall, F1, strict F1 and hallucination rate; a wrong slot counts against both precision and recall."""
    s = outcomes.groupBy(*by).agg(*(F.sum(n).alias(n) for n in OUTCOMES))
    tp, wrong = F.col("correct"), F.col("wrong")
    strict = F.col("strict_correct")
    fp, fn = wrong + F.col("hallucination"), wrong + F.col("miss")
    return s.select(*by, *OUTCOMES, *prf(tp, fp, fn), ratio(2 * strict, 2 * tp + fp + fn).alias("strict_f1"), ratio(F.col("hallucination"), F.col("hallucination") + F.col("null_agree")).alias("hallucination_rate"))


def micro_by_field(outcomes: DataFrame) -> DataFrame:
    """Per-field counts and, with a null field, the total: one pass by grouping sets."""
    g = outcomes.groupingSets([["field"], []], "field").agg(F.sum("correct").alias("correct"), F.sum("wrong").alias("wrong"), F.sum("miss").alias("miss"), F.sum("hallucination").alias("hallucination"))
    return g.withColumn("f1", ratio(2 * F.col("correct"), 2 * F.col("correct") + 2 * F.col("wrong") + F.col("miss") + F.col("hallucination")))


def token_overlap(df: DataFrame, key: str, gold: str, pred: str, norm: Callable[[Column], Column] = norm_equal) -> DataFrame:
    """Per record: size of the multiset intersection of words, and words of either side, both after ``norm``."""
    words = lambda c, side: df.select(key, F.explode(F.filter(F.split(norm(F.coalesce(F.col(c), F.lit(""))), " "), lambda w: w != "")).alias("w"), F.lit(side).alias("side"))
    counts = words(gold, 0).union(words(pred, 1)).groupBy(key, "w").agg(F.count_if(F.col("side") == 0).alias("g"), F.count_if(F.col("side") == 1).alias("p"))
    return counts.groupBy(key).agg(F.sum(F.least("g", "p")).alias("overlap"), F.sum("g").alias("gold_tokens"), F.sum("p").alias("pred_tokens"))


def item_semantics(gold: DataFrame, pred: DataFrame, record: str, quantity: str, unit: str, position: str, same: str) -> DataFrame:
    """Items matched by quantity, unit (null equals null) and position within that bucket; items without quantity stay out.

    Both sides go through one shuffle, which serves the numbering and the matching.
    """
    side = lambda df, n: df.where(F.col(quantity).isNotNull()).select(record, quantity, unit, F.col(position).alias("at"), F.col(same).alias("item"), F.lit(n).alias("side"))
    both = side(gold, 0).union(side(pred, 1)).repartition(record, quantity, unit)
    placed = both.withColumn("nth", F.row_number().over(Window.partitionBy(record, quantity, unit, "side").orderBy("at")))
    of = lambda n: F.max(F.when(F.col("side") == n, F.col("item")))
    met = placed.groupBy(record, quantity, unit, "nth").agg(F.count("*").alias("n"), of(0).eqNullSafe(of(1)).alias("product_same"))
    return met.where("n = 2").drop("n")


def confusion(df: DataFrame, gold: str, pred: str, classes: list[str]) -> DataFrame:
    """Counts by (gold, pred); a prediction that is null or no class is "invalid"."""
    valid = F.when(F.col(pred).isin(*classes), F.col(pred)).otherwise("invalid")
    return df.select(F.col(gold).alias("gold"), valid.alias("pred")).groupBy("gold", "pred").agg(F.count("*").alias("n"))


def class_metrics(table: DataFrame, classes: list[str]) -> DataFrame:
    """Per class of the domain, also those that never occur: support, precision, recall, F1."""
    spark = table.sparkSession
    domain = spark.createDataFrame([(c,) for c in classes], "label string")
    t = table.select("n", F.explode(F.array_distinct(F.array("gold", "pred"))).alias("label"), (F.col("gold") == F.col("pred")).alias("hit"), "gold", "pred")
    s = t.groupBy("label").agg(
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("pred") == F.col("label"), F.col("n"))), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum(F.when(F.col("gold") == F.col("label"), F.col("n"))), F.lit(0)).alias("support"),
    )
    s = domain.join(s, "label", "left").na.fill(0)
    return s.select("label", "support", *prf(F.col("tp"), F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")))


def accuracy_and_macro(table: DataFrame, classes: list[str]) -> DataFrame:
    """One row: n, accuracy, macro-F1 over the whole domain, invalid predictions."""
    per = class_metrics(table, classes).agg(F.round(F.sum("f1") / len(classes), 12).alias("macro_f1"))
    total = table.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"), F.sum(F.when(F.col("pred") == "invalid", F.col("n")).otherwise(0)).alias("invalid"))
    return total.select("n", ratio(F.col("hits"), F.col("n")).alias("accuracy"), "invalid").join(per)


def sliced(df: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """Each row once for every slice whose predicate holds, in column ``slice``."""
    names = F.array_compact(F.array(*(F.when(p, F.lit(n)) for n, p in slices.items())))
    return df.withColumn("slice", F.explode(names))


def resampled(records: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """Each record with every replicate's number (rep) and the times that it is in that resample (w).

    The weight is Poisson and comes from the record's hash, so records are never numbered, sorted or collected.
    """
    u = bucket(1_000_000, F.lit(seed), F.col("rep"), F.col(key)) / F.lit(1e6)
    cdf = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]  # of Poisson(1)
    return records.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", sum((u >= c).cast("long") for c in cdf))


def interval(values: DataFrame, *columns: str) -> DataFrame:
    """2.5 and 97.5 per cent percentiles (linear between values) of each column, and the number of replicates."""
    ends = [F.round(F.percentile(c, q), 9).alias(f"{c}_{n}" if len(columns) > 1 else n) for c in columns for n, q in (("low", 0.025), ("high", 0.975))]
    return values.agg(*ends, F.count("*").alias("replicates"))


def bootstrap(records: DataFrame, key: str, tp: str, fp: str, fn: str, replicates: int, seed: int) -> DataFrame:
    """Percentile interval of micro-F1 over resampled records; sums of weighted counts merge map-side."""
    return _f1_interval(resampled(records, key, replicates, seed), tp, fp, fn)


def _f1_interval(drawn: DataFrame, tp: str, fp: str, fn: str) -> DataFrame:
    return sums_interval(drawn.groupBy("rep").agg(*(F.sum(F.col("w") * F.col(c)).alias(n) for c, n in ((tp, "tp"), (fp, "fp"), (fn, "fn")))))


def sums_interval(sums: DataFrame) -> DataFrame:
    """Percentile interval of micro-F1 from a row of tp, fp and fn for each replicate."""
    return interval(sums.select(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1")), "f1")


def bootstrap_classes(records: DataFrame, key: str, gold: str, pred: str, replicates: int, seed: int) -> DataFrame:
    """Percentile intervals of accuracy and macro-F1; a class without gold rows in a replicate is no part of its macro-F1."""
    return _class_intervals(resampled(records, key, replicates, seed), gold, pred)


def _class_intervals(drawn: DataFrame, gold: str, pred: str) -> DataFrame:
    cells = drawn.groupBy("rep", F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.sum("w").alias("n"))
    n, same = F.col("n"), F.col("gold").eqNullSafe(F.col("pred"))
    each = cells.select("rep", "n", same.alias("same"), "gold", F.explode(F.array_distinct(F.array("gold", "pred"))).alias("label"))
    of = lambda p: F.coalesce(F.sum(F.when(p, n)), F.lit(0))
    per = each.groupBy("rep", "label").agg(of(F.col("same")).alias("tp"), of(F.col("gold") == F.col("label")).alias("support"), F.sum("n").alias("either"))
    f1 = ratio(2 * F.col("tp"), F.col("either") + F.col("tp"))  # gold and predicted counts add up to either + tp
    macro = per.where("support > 0").groupBy("rep").agg(F.avg(f1).alias("macro_f1"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy"))
    return interval(macro, "accuracy", "macro_f1")


def redrawn(cells: DataFrame, columns: list[str], replicates: int, seed: int) -> DataFrame:
    """Each row of (columns, n) with every replicate's number (rep) and how many of its n records are in that resample (w).

    The sum of n records' Poisson weights is Poisson with mean n, so equal records are drawn together: the cost is
    distinct rows times replicates, however many records there are. Draws come from the seed and the row's own values.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = hashlib.sha256(repr((seed, *(row[c] for c in columns))).encode()).digest()
                w = np.random.default_rng(np.frombuffer(name, np.uint32)).poisson(row["n"], replicates)
                yield pa.RecordBatch.from_arrays([*(pa.array([row[c]] * replicates, batch.schema.field(c).type) for c in columns), pa.array(np.arange(replicates)), pa.array(w)], names=[*columns, "rep", "w"])

    cells = cells.select(*columns, "n")
    return cells.mapInArrow(draw, StructType([*cells.schema.fields[:-1], StructField("rep", LongType()), StructField("w", LongType())]))


def bootstrap_counts(records: DataFrame, tp: str, fp: str, fn: str, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """bootstrap() with the reference's number of replicates; records of equal counts are drawn together."""
    return _f1_interval(redrawn(records.groupBy(tp, fp, fn).agg(F.count("*").alias("n")), [tp, fp, fn], replicates, seed), tp, fp, fn)


def bootstrap_confusion(records: DataFrame, gold: str, pred: str, replicates: int = 1000, seed: int = 3) -> DataFrame:
    """bootstrap_classes() with the reference's number of replicates; records of equal classes are drawn together."""
    return _class_intervals(redrawn(records.groupBy(gold, pred).agg(F.count("*").alias("n")), [gold, pred], replicates, seed), gold, pred)


def order_missed(table: DataFrame, orders: list[str], extracted: list[str]) -> DataFrame:
    """From a confusion table: gold rows of the order classes, and how many of them are predicted outside ``extracted``."""
    n = F.col("n")
    s = table.where(F.col("gold").isin(*orders)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("order_rows"), F.coalesce(F.sum(F.when(~F.col("pred").isin(*extracted), n)), F.lit(0)).alias("missed"))
    return s.withColumn("missed_rate", ratio(F.col("missed"), F.col("order_rows")))


def calibration_bins(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Equal-width bins with counts, sums and gap; 1.0 falls into the last bin, empty bins are left out."""
    b = F.least((F.col(confidence) * bins).cast("int"), F.lit(bins - 1))
    s = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(confidence), 9).alias("confidence"), ratio(F.sum(F.col(correct).cast("long")), F.count("*")).alias("accuracy"))
    return s.withColumn("gap", F.round(F.abs(F.col("confidence") - F.col("accuracy")), 8))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))


def interpolate(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear map through (x, y) knots, flat beyond the ends."""
    n, (xs, ys) = len(knots), zip(*knots)
    slopes = [(y1 - y0) / (x1 - x0) if x1 > x0 else 0.0 for (x0, y0), (x1, y1) in zip(knots, knots[1:])] + [0.0]
    xs, ys, slopes = (F.array(*(F.lit(float(v)) for v in values)) for values in (xs, ys, slopes))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
    below = F.aggregate(steps, F.lit(-1), lambda at, by: F.when((at + by < n) & (F.get(xs, at + by) < x), at + by).otherwise(at))  # binary search
    on = F.transform(F.array(below), lambda i: F.when(i < 0, F.get(ys, F.lit(0))).otherwise(F.get(ys, i) + (x - F.get(xs, i)) * F.get(slopes, i)))
    return F.when(x.isNotNull(), F.get(on, F.lit(0)))


def isotonic_knots(pairs: DataFrame, confidence: str, correct: str) -> list[tuple[float, float]]:
    """Boundaries and predictions of an isotonic fit (pool-adjacent-violators, distributed by pyspark.ml)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    data = pairs.select(F.col(confidence).cast("double").alias("x"), F.col(correct).cast("double").alias("label")).groupBy("x").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    model = IsotonicRegression(weightCol="weight").fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(data))
    return [(float(a), min(1.0, max(0.0, float(b)))) for a, b in zip(model.boundaries, model.predictions)]


def geometric_mean(probs: Column, floor: float = 1e-12) -> Column:
    """Of an array of probabilities; 1.0 if empty."""
    logs = F.aggregate(probs, F.lit(0.0), lambda a, p: a + F.log(F.greatest(p, F.lit(floor))))
    return F.when(F.size(probs) == 0, 1.0).otherwise(F.exp(logs / F.size(probs)))


def regression_gate(baseline: DataFrame, candidate: DataFrame, key: str = "source", metric: str = "f1", tolerance: float = 0.01) -> DataFrame:
    """Row per source: delta, and regressed if the candidate is below the baseline by more than the tolerance."""
    b, c = baseline.select(key, F.col(metric).alias("baseline")), candidate.select(key, F.col(metric).alias("candidate"))
    return b.join(c, key).withColumn("delta", F.round(F.col("candidate") - F.col("baseline"), 9)).withColumn("regressed", F.col("candidate") < F.col("baseline") - tolerance)
