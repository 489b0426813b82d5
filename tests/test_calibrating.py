"""Isotonic fits and as-of lookups against plain pool-adjacent-violators; ranks and resamples that add up."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docket.operators import calibrating, ranking, resampling


def plain_fit(pairs):
    """Pool-adjacent-violators over distinct confidences: {x: fitted value}."""
    sums = {}
    for x, hit in pairs:
        if x is not None and hit is not None:
            n, s = sums.get(x, (0, 0))
            sums[x] = (n + 1, s + hit)
    pools = []
    for x in sorted(sums):
        pools.append([*sums[x], [x]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, s, xs = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + s, pools[-1][2] + xs]
    return {x: s / n for n, s, xs in pools for x in xs}, sorted({(x, s / n) for n, s, xs in pools for x in (xs[0], xs[-1])})


def plain_lookup(x, knots):
    xs = [k for k, _ in knots]
    if x is None or not knots:
        return None
    k = bisect.bisect_left(xs, x)
    if k < len(xs) and xs[k] == x:
        return knots[k][1]
    if k in (0, len(xs)):
        return knots[min(k, len(xs) - 1)][1]
    (x0, y0), (x1, y1) = knots[k - 1], knots[k]
    return y0 + (x - x0) * (y1 - y0) / (x1 - x0)


@pytest.mark.parametrize("kind,piece", [("noise", 10), ("rising", 25), ("falling", 5), ("rising", 100_000), ("flat", 10)])
def test_isotonic_fit(spark, kind, piece):
    rng = random.Random(piece)
    x = [rng.choice([rng.random(), round(rng.random(), 2)]) for _ in range(3000)]
    chance = {"noise": lambda v: v * v, "rising": lambda v: v > 0.5, "falling": lambda v: 1 - v, "flat": lambda v: 0.3}[kind]
    pairs = [(v, rng.random() < chance(v)) for v in x] + [(None, True), (0.5, None)]
    if kind == "rising":  # rising shares at every x: no two pool, and every point is a corner
        pairs = [(k / 200, j < k) for k in range(200) for j in range(200)]
    df = spark.createDataFrame(pairs, "c double, ok boolean").repartition(7)
    want, knots = plain_fit([(a, b) for a, b in pairs])
    got = sorted(tuple(r) for r in calibrating.isotonic_fit(df, "c", "ok", piece=piece).collect())
    assert got == knots
    asked = [(i, v) for i, v in enumerate([None, -1.0, 2.0, *(rng.random() for _ in range(300)), *(v for v, _ in pairs[:300])])]
    out = calibrating.calibrated(spark.createDataFrame(asked, "i long, c double"), "c", spark.createDataFrame(got, "x double, y double"))
    assert out.columns == ["i", "c", "calibrated"]
    found = {r.i: r.calibrated for r in out.collect()}
    for i, v in asked:
        expected = plain_lookup(v, knots)
        assert found[i] == expected if expected is None else abs(found[i] - expected) < 1e-12


def test_isotonic_of_nothing(spark):
    none = spark.createDataFrame([(None, True)], "c double, ok boolean")
    assert calibrating.isotonic_fit(none, "c", "ok").collect() == []
    out = calibrating.calibrated(spark.createDataFrame([(0.5,), (None,)], "c double"), "c", spark.createDataFrame([], "x double, y double")).collect()
    assert sorted(r.calibrated is None for r in out) == [True, True]


def test_lookup_is_whole_under_one_frequent_value(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.col("id") / 20_000).alias("c"))
    knots = [(k / 100, (k / 100) ** 2) for k in range(101)]
    out = calibrating.calibrated(rows, "c", spark.createDataFrame(knots, "x double, y double"))
    assert out.count() == 20_000
    assert out.where(F.abs(F.col("calibrated") - F.col("c") ** 2) > 0.0001).count() == 0


def test_ranked(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *"abcdef"])) for i in range(2000)]
    got = ranking.ranked(spark.createDataFrame(rows, "i long, s string").repartition(6), "s", -F.col("i")).collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", -r[0]))
    assert [(r.i, r.s) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 2001))
    assert ranking.ranked(spark.createDataFrame([], "i long"), "i").collect() == []


def test_nested_sets(spark):
    rows = ranking.nested_sets(spark.range(300).withColumnRenamed("id", "k"), "k", 5, [10, 50, 1000]).collect()
    sets = {n: {r.k for r in rows if r["size"] == n} for n in (10, 50, 1000, None)}
    assert [len(sets[n]) for n in (10, 50, 1000, None)] == [10, 50, 300, 300]
    assert sets[10] < sets[50] < sets[1000] == sets[None]


def test_exact_resamples(spark):
    rng = random.Random(1)
    cells = [(i, rng.randint(0, 40)) for i in range(700)] + [(-1, 5000)]
    df = spark.createDataFrame(cells, "v long, n long")
    n = sum(c for _, c in cells)
    draws = resampling.exact_resamples(df, ["v"], 200, 3).toPandas()
    assert (draws.groupby("rep").w.sum() == n).all() and draws.rep.nunique() == 200
    again = resampling.exact_resamples(df.repartition(5), ["v"], 200, 3).toPandas()
    key = ["rep", "v"]
    assert draws.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    big = draws[draws.v == -1].w
    p = 5000 / n
    assert abs(big.mean() - 5000) < 4 * np.sqrt(n * p * (1 - p) / 200)
    assert 0.7 < big.std() / np.sqrt(n * p * (1 - p)) < 1.3  # as a multinomial's, not a Poisson's
    assert resampling.exact_resamples(df.where("n < 0"), ["v"], 10, 3).collect() == []


def test_drawn(spark):
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v"))
    got = resampling.drawn(df, "k", 30, 9).toPandas()
    assert (got.groupby("rep").w.sum() == 50).all() and got.rep.nunique() == 30
    assert resampling.drawn(df.where("k < 0"), "k", 3, 9).collect() == []
