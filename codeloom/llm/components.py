"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the least node that each node with an edge can reach.

    Every round is two joins on the edges' ends with minima that combine before the
    shuffle; a hub's rows are split by Spark's skewed joins. Rounds grow with the
    logarithm of the longest path. Edges may repeat; loops and nulls are ignored.
    """
    edges = common.saved(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "edges")
    before = None
    while (now := _signature(edges)) != before and now[0]:
        before, old = now, edges
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        large = common.saved(large, "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter(F.col("a") != F.col("b")).distinct()
        edges = common.saved(small, "small-star")
        common.discard(old, large)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = common.saved(roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
    common.discard(edges)
    return out
