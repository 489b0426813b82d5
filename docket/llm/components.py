"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import written


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Edges are longs, in any direction, repeats allowed. Each round is two group-bys over the edges, written to the
    shared folder, so a lost executor costs one round at most; only a count and a
    checksum reach the driver. The number of rounds grows with the logarithm of the longest path.
    """
    now = written(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        now = written(small.distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(now.select("b", "b")).groupBy("node").agg(F.min("component").alias("component"))
