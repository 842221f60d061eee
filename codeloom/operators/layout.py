"""Layouts (Y1-Y4, Y8). A layout in which every node pushes every other would hold a graph in one task, so there is none."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.operators import slim
from codeloom.operators.build import numbered, ordered
from codeloom.operators.subgraph import peel, peel_rounds
from codeloom.plans import loops
from codeloom.schema import Graph

#: Distances and constants of the layouts.
LAYER_GAP, NODE_GAP, SWEEPS = 150.0, 100.0, 4
SPIRAL_TURN, SPIRAL_STEP = 2.3999, 40.0
ROW_GAP = 200.0


def _inner_pairs(graph: Graph) -> DataFrame:
    ids = graph.nodes.select(F.col("id").alias("source"))
    edges = graph.edges.select("source", "target").filter(F.col("source") != F.col("target"))
    return edges.join(ids, "source", "left_semi").join(ids.withColumnRenamed("source", "target"), "target", "left_semi")


def layers(graph: Graph) -> DataFrame:
    """(id, ord, layer): longest path from nodes without edges in.

    Nodes that a cycle blocks lie one below their deepest unblocked predecessor; those
    without any lie one below the deepest layer (on layer 1 where there is none).
    """
    rounds = peel_rounds(graph.nodes, graph.edges.select("source", "target").filter(F.col("source") != F.col("target")))
    placed = _settled(rounds, lambda: loops.saved(_inner_pairs(graph), "pairs"))
    return placed.join(graph.nodes.select("id", "ord"), "id").select("id", "ord", "layer")


def _settled(rounds: DataFrame, inner: Callable[[], DataFrame]) -> DataFrame:
    """(id, layer) of rounds (id, round); inner gives the edges between these nodes, where a cycle blocks any."""
    if rounds.filter(F.col("round").isNull()).isEmpty():
        return rounds.select("id", F.col("round").alias("layer"))
    known = rounds.filter(F.col("round").isNotNull())
    touched = inner().join(known.select(F.col("id").alias("source"), "round"), "source").groupBy(F.col("target").alias("id")).agg((F.max("round") + 1).alias("_below"))
    placed = rounds.join(touched, "id", "left").withColumn("_layer", F.coalesce("round", "_below"))
    deepest = placed.agg(F.coalesce(F.max("_layer"), F.lit(0))).first()[0]
    return placed.select("id", F.coalesce("_layer", F.lit(deepest + 1)).alias("layer"))


def _by_number(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Tables (id, key, ord), where id is a number from 0 and key the node's id, and (source, target) of numbers: the edges between two nodes."""
    rows = graph.nodes.select(slim.key(F.col("id")).alias("key"), "ord").withColumn("_number", F.monotonically_increasing_id())
    nodes = numbered(loops.saved(rows.withColumnRenamed("ord", "_ord"), "nodes"), F.shiftright("_number", 33)).select(F.col("ord").alias("id"), "key", F.col("_ord").alias("ord"))
    parts = loops.buckets(nodes.sparkSession, nodes.count())

    def end(name: str) -> DataFrame:
        return nodes.select(F.col("key").alias(name), F.col("id").alias(f"_{name}")).repartition(parts, name).hint("shuffle_hash")

    edges = slim.slim(graph.edges.select("source", "target").filter(F.col("source") != F.col("target")))
    edges = edges.join(end("source"), "source").select("_source", "target").join(end("target"), "target")
    return nodes, loops.saved(edges.select(F.col("_source").alias("source"), F.col("_target").alias("target")), "pairs")


def layered(graph: Graph, sweeps: int = SWEEPS) -> DataFrame:
    """(id, ord, layer, x, y): layers below each other, each centred.

    Inside a layer nodes start in their order. A sweep goes layer after layer, down
    and in turn up: a layer's nodes move to the mean place of their neighbours in the
    layer before it, as they lie by now; nodes without any there stay at their place,
    and ties keep their order. A step reads one layer, the one before it and the edges
    between these two.

    Ids are turned into numbers once. Edges between adjacent layers lie in buckets
    twice, by their upper and by their lower ends, so a step moves no edge, only sums of places.
    """
    with loops.scope() as kept, contextlib.ExitStack() as tables:
        nodes, pairs = _by_number(graph)
        spark, total = nodes.sparkSession, pairs.count()
        with loops.bucketed(pairs.withColumn("w", F.lit(1).cast("long")), "source", rows=total) as by_source:
            loops.discard(pairs)
            done = peel(nodes.select("id", F.lit(0).cast("long").alias("base")), by_source)
            rounds = loops.saved(nodes.select("id").join(done, "id", "left"), "rounds")
            found = ordered(_settled(rounds, lambda: by_source).join(nodes.select("id", F.col("ord").alias("_ord")), "id"), "layer", "_ord")  # ord: through all layers
            # the edges' side of a join is not sorted, nor, by source, moved
            upper, lower = (found.select(F.col("id").alias(end), F.col("layer").alias(name)).hint("shuffle_hash") for end, name in (("source", "_a"), ("target", "lower")))
            near = by_source.join(upper, "source").select("source", "target", "_a").repartition(loops.buckets(spark, total), "target").join(lower, "target")
            near = near.filter(F.col("lower") == F.col("_a") + 1).select("source", "target", "lower")
            below = tables.enter_context(loops.bucketed(near, "target", rows=total, dealt=True, by="lower"))
        above = tables.enter_context(loops.bucketed(below, "source", rows=total, by="lower"))
        sizes = {r["layer"]: r["n"] for r in found.groupBy("layer").agg(F.count("*").alias("n")).orderBy("layer").collect()}  # as many as the longest path has nodes
        levels, by_layer, first = list(sizes), {}, 0
        for n, size in sizes.items():
            by_layer[n] = found.filter(F.col("layer") == n).select("id", (F.col("ord") - first).alias("place"))
            first += size
        for i in range(sweeps):
            down = i % 2 == 0
            near, far, edges = ("source", "target", above) if down else ("target", "source", below)
            for n in levels[1:] if down else levels[-2::-1]:
                beside = n - 1 if down else n + 1
                if beside not in by_layer:
                    continue
                places = by_layer[beside].select(F.col("id").alias(near), "place").hint("shuffle_hash")
                between = edges.filter(F.col("lower") == max(n, beside)).join(places, near)
                means = between.groupBy(F.col(far).alias("id")).agg((F.sum("place") / F.count("*")).alias("_mean"))
                own = by_layer[n].join(means, "id", "left").select("id", "place", F.coalesce("_mean", F.col("place").cast("double")).alias("_key"))
                by_layer[n] = ordered(own, "_key", "place").select("id", F.col("ord").alias("place"))
        out = None
        for n, placed in by_layer.items():
            x = (F.col("place") - (sizes[n] - 1) / 2.0) * NODE_GAP
            layer = placed.select("id", F.lit(n).cast("long").alias("layer"), x.cast("float").alias("x"), F.lit(n * LAYER_GAP).cast("float").alias("y"))
            out = layer if out is None else out.unionByName(layer)
        if out is None:
            out = found.select("id", "layer", F.lit(0.0).cast("float").alias("x"), F.lit(0.0).cast("float").alias("y"))
        out = out.join(nodes, "id").select(slim.text(F.col("key")).alias("id"), nodes["ord"].alias("ord"), "layer", "x", "y")
        return loops.result(out, kept, "layout")


def spiral(nodes: DataFrame) -> DataFrame:
    """Y4."""
    angle, radius = F.col("ord") * F.lit(SPIRAL_TURN), F.lit(SPIRAL_STEP) * F.sqrt(F.col("ord") + F.lit(1.0))
    return nodes.select("id", "ord", (radius * F.cos(angle)).cast("float").alias("x"), (radius * F.sin(angle)).cast("float").alias("y"))


def directory_rows(nodes: DataFrame) -> DataFrame:
    """A row per directory in order of names, its nodes side by side, centred."""
    placed = nodes.withColumn("_dir", scalars.directory(F.col("path")))
    names = ordered(placed.select("_dir").distinct(), "_dir").select("_dir", F.col("ord").alias("_row"))
    inside = Window.partitionBy("_dir")
    out = placed.join(names, "_dir").withColumn("_i", F.row_number().over(inside.orderBy("ord")) - 1).withColumn("_n", F.count("*").over(inside))
    return out.select("id", "ord", ((F.col("_i") - F.col("_n") / 2.0) * NODE_GAP).alias("x"), (F.col("_row") * ROW_GAP).alias("y"))
