"""Dependency cycles: strongly connected components of more than one node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from codeloom.operators import slim
from codeloom.operators.build import ordered
from codeloom.plans import loops
from codeloom.schema import Graph

#: Hops of a job; nodes of a cycle that is listed, at most.
HOPS, LISTED = 4, 10_000


def components(pairs: DataFrame) -> DataFrame:
    """(source, target) -> id, cycle_id (the least id) for all nodes in components of more than one node.

    Every node is a pivot, nodes with many edges in and out before others. The
    foremost pivot that reaches a node is its colour forward, the foremost that it
    reaches its colour backward, both found in one loop. Nodes whose two colours are
    one pivot are its component. Nodes of one component have the same colours, so
    only edges between nodes alike in both are left for the next pass; the foremost
    pivot of each such class is found in it. Passes know nodes by their numbers in the
    order of pivots, so that rounds move and compare eight bytes a node.
    """
    spark = pairs.sparkSession
    with loops.scope() as kept:
        pairs = pairs.filter(F.col("source") != F.col("target")).select(slim.key(F.col("source")).alias("source"), slim.key(F.col("target")).alias("target")).distinct()
        left, numbers = _numbered(loops.saved(_trimmed(loops.saved(pairs, "pairs")), "trimmed"))
        found = spark.createDataFrame([], "id long, pivot long")
        while not left.isEmpty():
            colors = _colors(left)
            one = colors.filter(F.col("forward") == F.col("backward"))
            found = found.unionByName(one.select("id", F.col("forward").alias("pivot")))
            open_ = colors.filter(F.col("forward") != F.col("backward")).select("id", F.struct("forward", "backward").alias("_c"))
            ends = open_.select(F.col("id").alias("source"), F.col("_c").alias("_a")), open_.select(F.col("id").alias("target"), F.col("_c").alias("_b"))
            left = loops.saved(left.join(ends[0], "source").join(ends[1], "target").filter("_a = _b").select("source", "target"), "pairs")
            left = loops.saved(_trimmed(left), "trimmed")
        named = loops.saved(found.join(numbers, "id").select("pivot", slim.text(F.col("key")).alias("id")), "found")
        sizes = named.groupBy("pivot").agg(F.count("*").alias("_n"), F.min("id").alias("cycle_id")).filter("_n > 1").select("pivot", "cycle_id")
        return loops.result(named.join(sizes, "pivot").select("id", "cycle_id"), kept, "components")


def _numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of keys -> the pairs of their numbers, and (id, key): numbers rise by the lesser of the edges out and in."""
    ends = pairs.select(F.col("source").alias("key"), F.lit(0).alias("way")).unionByName(pairs.select(F.col("target").alias("key"), F.lit(1).alias("way")))
    weighed = ends.groupBy("key").agg(F.least(F.count_if(F.col("way") == 0), F.count_if(F.col("way") == 1)).alias("weight"))
    numbers = ordered(weighed, "weight", "key").select(F.col("ord").alias("id"), "key")
    sources, targets = (numbers.select(F.col("key").alias(end), F.col("id").alias(f"_{end}")) for end in ("source", "target"))
    known = pairs.join(sources, "source").join(targets, "target").select(F.col("_source").alias("source"), F.col("_target").alias("target"))
    return loops.saved(known, "numbered"), numbers


def _trimmed(pairs: DataFrame, times: int = 2) -> DataFrame:
    """Pairs without those whose source has no edge in or whose target none out, taken off some times."""
    for _ in range(times):
        pairs = pairs.join(pairs.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        pairs = pairs.join(pairs.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
    return pairs


def _colors(pairs: DataFrame) -> DataFrame:
    """Table (id, forward, backward): the foremost pivot, which is the greatest number, that reaches each node and that it reaches.

    Edges are kept both ways in buckets by their start. A hop sends on the colours
    that have just moved; only these messages, one per node and way and task, are
    shuffled. A job makes several hops and writes the colours once.
    """
    ways = pairs.select(F.col("source").alias("id"), F.lit(0).alias("way"), F.col("target").alias("to")).unionByName(pairs.select(F.col("target").alias("id"), F.lit(1).alias("way"), F.col("source").alias("to")))
    with loops.bucketed(ways, "id", "way") as edges:
        state = edges.select("id").distinct().select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), F.col("id").alias("color"), F.lit(True).alias("moved"))
        while True:
            for _ in range(HOPS):
                sent = state.filter("moved").select("id", "way", "color").join(edges, ["id", "way"]).select(F.col("to").alias("id"), "way", "color")
                best = sent.groupBy("id", "way").agg(F.max("color").alias("_c"))
                better = F.col("_c").isNotNull() & (F.col("_c") > F.col("color"))
                state = state.drop("moved").join(best, ["id", "way"], "left").select("id", "way", F.when(better, F.col("_c")).otherwise(F.col("color")).alias("color"), better.alias("moved"))
            seen = Observation()
            state = loops.saved(state.observe(seen, F.count_if("moved").alias("moved")), "colors")
            if not seen.get["moved"]:
                break
        both = state.groupBy("id").agg(F.max(F.when(F.col("way") == 0, F.col("color"))).alias("forward"), F.max(F.when(F.col("way") == 1, F.col("color"))).alias("backward"))
        return loops.saved(both, "colors")


def _pairs(graph: Graph, resolved_only: bool) -> DataFrame:
    edges = graph.edges.filter("resolved") if resolved_only else graph.edges
    ids = graph.nodes.select(F.col("id").alias("source"))
    return edges.join(ids, "source", "left_semi").join(ids.withColumnRenamed("source", "target"), "target", "left_semi").select("source", "target")


def cycle_members(graph: Graph, resolved_only: bool = True) -> DataFrame:
    """G5 as rows, for cycles of any size: (cycle_id, id), cycle_id the least id of the cycle."""
    return components(_pairs(graph, resolved_only)).select("cycle_id", "id")


def detect_cycles(graph: Graph, resolved_only: bool = True, listed: int = LISTED) -> DataFrame:
    """cycle_id (least id), size, nodes (sorted; null for cycles of more than `listed` nodes), position by size, then id."""
    members = cycle_members(graph, resolved_only)
    sizes = members.groupBy("cycle_id").agg(F.count("*").alias("size"))
    lists = members.join(sizes.filter(F.col("size") <= listed), "cycle_id", "left_semi").groupBy("cycle_id").agg(F.array_sort(F.collect_list("id")).alias("nodes"))
    return ordered(sizes.join(lists, "cycle_id", "left"), "size", "cycle_id").withColumn("position", (F.col("ord") + 1).cast("int")).drop("ord")


def cycle_edges(graph: Graph) -> DataFrame:
    """Edges between members of one cycle."""
    members = components(_pairs(graph, False))
    ends = members.select(F.col("id").alias("source"), F.col("cycle_id").alias("_a")), members.select(F.col("id").alias("target"), "cycle_id")
    return graph.edges.join(ends[0], "source").join(ends[1], "target").filter((F.col("_a") == F.col("cycle_id")) & (F.col("source") != F.col("target"))).drop("_a")


def cycle_report(graph: Graph, listed: int = LISTED) -> DataFrame:
    """Position and line 'n. a -> b -> a'; of larger cycles the number of their nodes."""
    found = detect_cycles(graph, listed=listed)
    paths = found.filter("nodes is not null").select("position", F.posexplode("nodes").alias("_i", "id")).join(graph.nodes.select("id", "path"), "id")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_i", "path"))), lambda s: s["path"])
    lines = paths.groupBy("position").agg(in_order.alias("_p"))
    number = F.concat(F.col("position").cast("string"), F.lit(". "))
    short = lines.select("position", F.concat(number, F.array_join("_p", " -> "), F.lit(" -> "), F.col("_p")[0]).alias("line"))
    return short.unionByName(found.filter("nodes is null").select("position", F.concat(number, F.col("size").cast("string"), F.lit(" nodes")).alias("line")))
