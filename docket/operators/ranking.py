"""The place of every row in one order of all rows, without one task that sees them all; whole shuffles, prefixes and draws by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docket.sources.store import written

PER_TASK = (1 << 33) - 1  # monotonically_increasing_id() numbers a partition's rows from 0 in these bits


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with the place of each row, from 1, in the rising order of ``order``, columns or names; equal rows have different places.

    Rows are parted by ranges of the order, sorted within, and numbered there; only the sizes of the parts (one row a task) are summed in one place. The
    numbered rows are a table before the sizes are taken, so both see the same parts.
    """
    keys = [f"_k{i}_{name}" for i in range(len(order))]
    x = df.select("*", *(F.expr(o).alias(k) if isinstance(o, str) else o.alias(k) for o, k in zip(order, keys)))
    x = x.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    at = F.monotonically_increasing_id()
    x = written(x.withColumn("_part", F.shiftright(at, 33)).withColumn("_place", at.bitwiseAND(F.lit(PER_TASK))), "ranked")
    sizes = x.groupBy("_part").agg((F.max("_place") + 1).alias("size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each task
    sizes = sizes.select("_part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_before"))
    return x.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def seeded_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``rows`` with their place in the seeded shuffle of ``key``: the whole order, the same for every size of cluster."""
    return ranked(rows, F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), F.col(key))


def nested_sets(rows: DataFrame, key: str, seed: int, sizes: list[int]) -> DataFrame:
    """(key, size) for the first n rows of one seeded order, n in sizes, and for all rows under size null: each set holds the smaller ones."""
    sets = F.array(*(F.when(F.col("rank") <= n, F.lit(n)) for n in sizes))
    return seeded_order(rows.select(key), key, seed).withColumn("size", F.explode(F.concat(F.array_compact(sets), F.array(F.lit(None).cast("int"))))).select(key, "size")
