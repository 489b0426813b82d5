"""Bootstrap resamples of exactly as many records as there are.

Records with equal counts are one cell. A replicate deals its n draws down a binary tree of cells: at each node the left side gets a binomial number of them, by
its share of the records, and the right side the rest. Draws come from the seed and the node alone, so every task that needs a node draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docket.functions.columns import bucket
from docket.operators.ranking import ranked

GROUPS = 256


def _split(draws: np.ndarray, left: int, right: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many of each replicate's draws go left, by the numbers of records on both sides."""
    if left == 0 or right == 0:
        return draws if right == 0 else np.zeros_like(draws)
    return np.random.default_rng(seed).binomial(draws, left / (left + right))


def _dealt(draws: np.ndarray, sizes: np.ndarray, seed: int, level: int, begin: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, draws of each replicate) for every cell of ``sizes``."""
    if len(sizes) == 1:
        yield begin, draws
        return
    half = len(sizes) // 2
    left = _split(draws, int(sizes[:half].sum()), int(sizes[half:].sum()), (seed, level, begin, len(sizes)))
    yield from _dealt(left, sizes[:half], seed, level, begin)
    yield from _dealt(draws - left, sizes[half:], seed, level, begin + half)


def exact_resamples(cells: DataFrame, columns: list[str], replicates: int, seed: int) -> DataFrame:
    """Each cell (columns, n) with every replicate's number (rep) and its records in that resample (w); w adds up to all n in each replicate.

    Cells are dealt to GROUPS groups by hash. The upper tree parts the groups, whose sizes are all that every task knows; the lower
    one parts the cells of a group, which are sorted so that their order is no matter of chance. Columns are integers or texts.
    """
    group = F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in columns)), F.lit(GROUPS)).cast("int")
    x = cells.select(*columns, "n").where("n > 0").withColumn("group", group)
    sizes = np.zeros(GROUPS, np.int64)
    for r in x.groupBy("group").agg(F.sum("n").alias("n")).collect():  # at most GROUPS rows
        sizes[r.group] = r.n
    kinds = [f for f in x.schema.fields if f.name in columns]
    schema = StructType([*kinds, StructField("rep", LongType()), StructField("w", LongType())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, own, at = None, [], None

        def out() -> Iterator[pa.RecordBatch]:
            for place, w in _dealt(above[at], np.array([r["n"] for r in own]), seed, 1 + at, 0):
                row = own[place]
                yield pa.RecordBatch.from_arrays([*(pa.array([row[f.name]] * replicates, types[f.name]) for f in kinds), pa.array(np.arange(replicates)), pa.array(w)], names=schema.names)

        for batch in batches:
            types = {f.name: f.type for f in batch.schema}
            if above is None:
                above = dict(_dealt(np.full(replicates, sizes.sum()), sizes, seed, 0, 0))
            for row in batch.to_pylist():
                if row["group"] != at and own:
                    yield from out()
                    own = []
                at = row["group"]
                own.append(row)
        if own:
            yield from out()

    return x.repartition("group").sortWithinPartitions("group", *columns).mapInArrow(draw, schema)


PER_TASK = 4_000_000


def _draws(records: DataFrame, key: str, replicates: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(records with their place, a row for each draw with rep and the place that it hits), the latter dealt out by place."""
    placed = ranked(records, key, name="place")
    n = placed.count()
    spark, total = records.sparkSession, n * replicates
    at = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, -(-total // PER_TASK)))
    at = at.select(F.expr(f"id div {n or 1}").alias("rep"), (F.col("id") % (n or 1) + 1).alias("draw"))
    hits = at.select(F.col("rep").cast("int").alias("rep"), (bucket(n or 1, F.lit(seed), F.col("rep"), F.col("draw")) + 1).alias("place"))
    return placed, hits.repartition("place")


def drawn(records: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """Records with every replicate's number (rep) and how often it drew them (w > 0), draw by draw: n a replicate, told by hashes of seed, replicate and draw.

    It costs n times replicates rows, and is the form that SQL can repeat; exact_resamples() costs cells times replicates.
    """
    placed, hits = _draws(records, key, replicates, seed)
    w = hits.groupBy("place", "rep").agg(F.count("*").alias("w")).select(F.col("rep").cast("long").alias("rep"), "place", "w")
    return placed.hint("shuffle_hash").join(w, "place").drop("place")


def drawn_sums(records: DataFrame, key: str, columns: list[str], replicates: int, seed: int) -> DataFrame:
    """A row for each replicate of drawn(): rep, its number of draws (n), and each column's sum over them. Draws meet their records in one shuffle and stay uncounted.

    The planner takes a few replicates for a small table, though each has a draw for every record; the records, not the draws, are what a task holds.
    """
    placed, hits = _draws(records, key, replicates, seed)
    met = hits.join(placed.hint("shuffle_hash"), "place")
    return met.groupBy(F.col("rep").cast("long").alias("rep")).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in columns))
