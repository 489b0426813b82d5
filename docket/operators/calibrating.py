"""Isotonic calibration as tables: the fit by convex hulls of ranges, and its lookup by an as-of join.

Order the pairs by confidence and add up their number W and their hits S. The isotonic fit of the hits is the slope of the greatest convex function under the points
(W, S): its corners are where the fitted value changes. A corner of the whole is a corner of every range that holds it, so ranges are first reduced to
their own lower hulls, each by one task. What is left is cut at whole corners: for a level t, the last point with the least S - t W ends all fits up to t. Levels
are multiples of 2 ** -20 and S and W are integers, so this is exact; between two levels the pieces are independent, and each goes to one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docket.functions.columns import ratio
from docket.sources.store import written

UNIT = 1 << 20
PIECE = pa.schema([("piece", pa.int32()), ("x", pa.float64()), ("w", pa.int64()), ("s", pa.int64())])


class Hull:
    """The corners (x, w, s) of the lower hull of points that come in order of w, from the point (w, s) on."""

    def __init__(self, w: int = 0, s: int = 0):
        self.points: list[tuple] = [(None, w, s)]

    def add(self, x: float, w: int, s: int) -> None:
        p = self.points
        while len(p) > 1 and (p[-1][2] - p[-2][2]) * (w - p[-1][1]) >= (s - p[-1][2]) * (p[-1][1] - p[-2][1]):
            p.pop()
        p.append((x, w, s))


def hull_points(pairs: DataFrame, confidence: Column, correct: Column) -> DataFrame:
    """(x, w, s): the corners of the lower hulls of ranges of confidence, with pairs and hits up to x. Pairs with a null on either side are left out."""
    x = pairs.select(confidence.cast("double").alias("x"), correct.cast("boolean").cast("long").alias("hit")).where("x is not null and hit is not null and not isnan(x)")
    steps = x.groupBy("x").agg(F.count("*").alias("w"), F.sum("hit").alias("s")).repartitionByRange("x").sortWithinPartitions("x").withColumn("part", F.spark_partition_id())
    schema = pa.schema([("part", pa.int32()), ("x", pa.float64()), ("w", pa.int64()), ("s", pa.int64()), ("whole", pa.bool_())])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hull, w, s, part = Hull(), 0, 0, None
        for b in batches:
            for x_, w_, s_, part in zip(*(c.to_pylist() for c in b.columns)):
                w, s = w + w_, s + s_
                hull.add(x_, w, s)
        if part is not None:
            rows = [(part, *p, False) for p in hull.points[1:]] + [(part, None, w, s, True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    found = written(steps.mapInArrow(reduce, "part int, x double, w long, s long, whole boolean"), "hulls")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each task
    add = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0")
    sums = found.where("whole").select("part", add("w"), add("s"))
    return found.where("not whole").join(F.broadcast(sums), "part").select("x", (F.col("w") + F.col("w0")).alias("w"), (F.col("s") + F.col("s0")).alias("s"))


def level_corners(points: DataFrame, levels: list[int]) -> list[tuple[int, int]]:
    """The corners (w, s) of the whole hull that end the fits up to each level (in units of 1 / UNIT), without repeats; at most as many as levels."""
    schema = pa.schema([("level", pa.int64()), ("v", pa.decimal128(38, 0)), ("w", pa.int64()), ("s", pa.int64())])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = dict.fromkeys(levels, (0, 0, 0))  # before the first point
        for b in batches:
            w, s = (b.column(c).to_numpy() for c in ("w", "s"))
            if max(map(int, (w.max(), s.max()))) >= 1 << 42:
                w, s = w.astype(object), s.astype(object)  # as long as the products fit no long
            for t in levels:
                v = UNIT * s - t * w
                k = len(v) - 1 - int(v[::-1].argmin())
                best[t] = min(best[t], (int(v[k]), -int(w[k]), int(s[k])))
        rows = [(t, Decimal(v), -back, s) for t, (v, back, s) in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    found = points.mapInArrow(least, "level long, v decimal(38,0), w long, s long").groupBy("level").agg(F.min_by(F.struct("w", "s"), F.struct("v", -F.col("w"))).alias("c"))
    return sorted({(r.c.w, r.c.s) for r in found.collect()} - {(0, 0)})


def isotonic_fit(pairs: DataFrame, confidence: str, correct: str, piece: int = 100_000, most_levels: int = 1000) -> DataFrame:
    """(x, y): the knots of the isotonic fit of ``correct`` on ``confidence``, both ends of every level piece; empty without pairs.

    Equals pool-adjacent-violators over distinct confidences weighted by their pairs. ``piece`` is how many corners of ranges a task takes at about most; up to
    ``most_levels`` levels, at quantiles of the ranges' own slopes, cut them.
    """
    points = written(hull_points(pairs, F.col(confidence), F.col(correct)), "points")
    n = points.count()
    levels: list[int] = []
    if n > piece:
        slope = ratio(F.col("s") - F.lag("s", 1, 0).over(Window.partitionBy("range").orderBy("w")), F.col("w") - F.lag("w", 1, 0).over(Window.partitionBy("range").orderBy("w")))
        near = points.withColumn("range", F.spark_partition_id()).withColumn("slope", slope)
        shares = [k / min(most_levels, -(-n // piece) + 1) for k in range(1, min(most_levels, -(-n // piece) + 1))]
        levels = sorted({int(v * UNIT) for v in near.agg(F.percentile_approx("slope", shares).alias("q")).first().q})
    corners = level_corners(points, levels) if levels else []
    at, bounds = [(0, 0), *corners], np.array([w for w, _ in corners], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, b.column("w").to_numpy(), "left"), pa.int32()), *b.columns], schema=PIECE)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hull, now = None, None

        def out() -> pa.RecordBatch:
            p = hull.points
            return pa.RecordBatch.from_arrays([pa.array([q[0] for q in p[1:]]), pa.array([(b[2] - a[2]) / (b[1] - a[1]) for a, b in zip(p, p[1:])])], names=["x", "y"])

        for b in batches:
            for piece_, x, w, s in zip(*(c.to_pylist() for c in b.columns)):
                if piece_ != now:
                    if hull:
                        yield out()
                    hull, now = Hull(*at[piece_]), piece_
                hull.add(x, w, s)
        if hull:
            yield out()

    cut = points.select("x", "w", "s").mapInArrow(deal, "piece int, x double, w long, s long").repartition("piece").sortWithinPartitions("piece", "w")
    ends = cut.mapInArrow(finish, "x double, y double")
    # each piece begins at the first confidence after the end of the one before it: the least confidence that looks up to its own end
    first = as_of(pairs.select(F.col(confidence).cast("double").alias("x")).where("x is not null and not isnan(x)").distinct(), "x", written(ends, "ends"))
    return first.where("above is not null").groupBy(F.col("above.x").alias("hi")).agg(F.min("x").alias("lo"), F.first("above.y").alias("y")).select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), "y")


def as_of(rows: DataFrame, x: str, knots: DataFrame, parts: int = 64) -> DataFrame:
    """``rows`` with the knots (x, y) at or below (below) and at or above (above) their own x; null where there is none, or x is null.

    Both sides are cut into ranges at quantiles of the knots, and each range also gets the last knot before it and the first one after it, so it answers alone by
    windows over the union. Rows of equal x ask once, so a frequent x is no heavy range.
    """
    cuts = knots.agg(F.percentile_approx("x", [k / parts for k in range(1, parts)]).alias("q")).first().q or []
    bounds = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))).cast("array<double>")
    part = lambda c: F.size(F.filter(bounds, lambda b: b < c))
    n = len(set(cuts)) + 1
    k = knots.select(part(F.col("x")).alias("part"), F.struct("x", "y").alias("knot"))
    ends = k.groupBy("part").agg(F.min("knot").alias("first"), F.max("knot").alias("last"))
    whole = knots.sparkSession.range(n).select(F.col("id").cast("int").alias("part")).join(ends, "part", "left")  # a row for each range
    up, down = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    edges = whole.select("part", F.array(F.last("last", ignorenulls=True).over(up), F.first("first", ignorenulls=True).over(down)).alias("e")).select("part", F.explode("e").alias("knot")).where("knot is not null")
    asked = rows.select(F.col(x).cast("double").alias("x")).where("x is not null").distinct().select(part(F.col("x")).alias("part"), F.lit(None).cast(k.schema["knot"].dataType).alias("knot"), "x")
    both = k.union(edges).select("part", "knot", "knot.x").union(asked.select("part", "knot", "x"))
    w = Window.partitionBy("part").orderBy("x")
    found = both.withColumn("below", F.last("knot", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("above", F.first("knot", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    found = found.where("knot is null").select(F.col("x").alias("_x"), "below", "above")
    return rows.join(found, F.col(x).cast("double") == F.col("_x"), "left").drop("_x")


def calibrated(rows: DataFrame, confidence: str, knots: DataFrame, name: str = "calibrated") -> DataFrame:
    """``rows`` with the confidence mapped piecewise linearly between its knots, flat beyond the ends; null without one or without knots."""
    x = as_of(rows, confidence, knots)
    a, b, c = F.col("below"), F.col("above"), F.col(confidence).cast("double")
    between = F.when(a["x"] == b["x"], a["y"]).otherwise(a["y"] + (c - a["x"]) * ((b["y"] - a["y"]) / (b["x"] - a["x"])))
    return x.withColumn(name, F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(between)).drop("below", "above")
