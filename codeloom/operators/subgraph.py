"""Bounded subgraphs and topological order."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from codeloom.operators import slim
from codeloom.operators.build import ordered
from codeloom.plans import loops
from codeloom.schema import EDGE_SCHEMA, NODE_SCHEMA, Graph


#: Rounds of peeling before what is left is contracted.
PLAIN = 8


@dataclass(frozen=True)
class Subgraph:
    """Nodes and edges around a start."""

    root: str
    start: str
    depth: int
    direction: str
    entry: dict | None
    nodes: DataFrame
    edges: DataFrame

    @functools.cached_property
    def order(self) -> DataFrame:
        """(id, position), worked out when it is asked for."""
        return topological_order(self.nodes, self.edges)


def find_node(graph: Graph, wanted: str) -> DataFrame:
    """The node of this path; else the first whose path ends so or whose label is so. At most one row."""
    exact = F.col("path") == wanted
    near = F.col("path").endswith(wanted) | (F.col("label") == wanted)
    return graph.nodes.filter(exact | near).orderBy(exact.desc(), "ord").limit(1)


def bounded_walk(graph: Graph, start: str, depth: int, direction: str, most: int) -> DataFrame:
    """(id, rank): nodes within depth of start in the order of a breadth-first queue, cut at most.

    The queue pops in order of visit and takes neighbours forward, then back, in the
    order of edges: so per level a neighbour's place is its least (rank of the
    popped node, direction, edge order). The start is always kept.
    """
    spark = graph.edges.sparkSession
    ways = []
    if direction != "upstream":
        ways.append(graph.edges.select(F.col("source").alias("_at"), F.col("target").alias("id"), F.lit(0).alias("_way"), "ord"))
    if direction != "downstream":
        ways.append(graph.edges.select(F.col("target").alias("_at"), F.col("source").alias("id"), F.lit(1).alias("_way"), "ord"))
    with loops.scope() as kept, loops.bucketed(ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1]), "_at") as neighbours:
        seen = frontier = spark.createDataFrame([(start, 0)], "id string, rank long")
        known = 1
        for _ in range(depth):
            if known >= most:
                break
            met = neighbours.join(frontier.withColumnRenamed("id", "_at"), "_at")
            fresh = met.groupBy("id").agg(F.min(F.struct("rank", "_way", "ord")).alias("_place")).join(seen.select("id"), "id", "left_anti")
            placed = ordered(fresh, "_place")
            # at most `most` nodes in all pass
            frontier = loops.saved(placed.filter(F.col("ord") < most - known).select("id", (F.col("ord") + known).alias("rank")), "level")
            n = frontier.count()
            if not n:
                break
            known += n
            seen = seen.unionByName(frontier)
        return loops.result(seen, kept, "visited")


def peel_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, round): rounds of removing nodes without edges in; null for what a cycle keeps from removal.

    edges (source, target) may repeat; those to or from other nodes are ignored. A
    node's round is the length of the longest path to it.
    """
    with loops.scope() as kept:
        ids = loops.saved(nodes.select(slim.key(F.col("id")).alias("id")).distinct(), "ids")
        inside = slim.slim(edges.select("source", "target"))
        inside = inside.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
        pairs = inside.withColumn("w", F.lit(1).cast("long"))
        done = _longest(ids.withColumn("base", F.lit(0).cast("long")), pairs)
        return loops.result(ids.join(done, "id", "left").select(slim.text(F.col("id")).alias("id"), "round"), kept, "rounds")


def _longest(nodes: DataFrame, edges: DataFrame, plain: int | None = None) -> DataFrame:
    """(id, base), (source, target, w), pairs may repeat -> (id, round): the longest path to each node, from base on; none for what cycles block.

    A round pays the edges out of the nodes that were settled last, and settles those
    whose edges in are all paid; it writes the nodes that were paid to, no others.
    What is left after `plain` rounds is contracted: a node with one edge in follows
    its neighbour's round, so such nodes are pointed, by doubling, to the first node
    that isn't, and only those are peeled further.
    """
    with loops.bucketed(edges, "source") as by_source:
        return peel(nodes, by_source, plain)


def peel(nodes: DataFrame, by_source: DataFrame, plain: int | None = None) -> DataFrame:
    """_longest() of edges bucketed by source."""
    plain = PLAIN if plain is None else plain
    need = loops.saved(by_source.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("need")), "need")
    ready = loops.saved(nodes.join(need, "id", "left_anti").select("id", F.col("base").alias("round")), "ready")
    sent, pending, n = None, None, 0
    while not ready.isEmpty():
        if n == plain and (found := _contracted(nodes, by_source, sent, ready, pending)) is not None:
            done = found if sent is None else sent.unionByName(found)
            return loops.saved(done, "rounds")
        n += 1
        # edges are not sorted: the nodes of a bucket are hashed
        paid = by_source.join(ready.select(F.col("id").alias("source"), "round").hint("shuffle_hash"), "source").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("paid"), F.max(F.col("round") + F.col("w")).alias("best"))
        if pending is not None:
            paid = pending.unionByName(paid).groupBy("id").agg(F.sum("paid").alias("paid"), F.max("best").alias("best"))
        step = loops.saved(paid.join(need, "id").join(nodes, "id").select("id", "paid", F.greatest("best", "base").alias("best"), (F.col("paid") == F.col("need")).alias("full")), "paid")
        sent = ready if sent is None else sent.unionByName(ready)
        ready, pending = step.filter("full").select("id", F.col("best").alias("round")), step.filter("not full").select("id", "paid", "best")
    out = nodes.limit(0).select("id", F.col("base").alias("round")) if sent is None else sent
    return loops.saved(out, "rounds")


def _contracted(nodes: DataFrame, edges: DataFrame, sent: DataFrame | None, ready: DataFrame, pending: DataFrame | None) -> DataFrame | None:
    """Rounds of the nodes that are settled but not sent, and of all others that aren't blocked; None where no node has a single edge in."""
    bases = ready.select("id", F.col("round").alias("_b"))
    if pending is not None:
        bases = bases.unionByName(pending.select("id", F.col("best").alias("_b")))
    if sent is not None:
        nodes = nodes.join(sent.select("id"), "id", "left_anti")
        edges = edges.join(sent.select(F.col("id").alias("source")), "source", "left_anti")
    nodes = loops.saved(nodes.join(bases, "id", "left").select("id", F.coalesce("_b", "base").alias("base")), "left")
    edges = loops.saved(edges.groupBy("source", "target").agg(F.max("w").alias("w")), "left-edges")
    one = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("_n"), F.min("source").alias("to"), F.min("w").alias("dist")).filter("_n = 1")
    # a base that the one edge outdoes in any case doesn't matter
    point = loops.saved(one.join(nodes, "id").filter(F.col("base") <= F.col("dist")).select("id", "to", "dist"), "points")
    count = point.count()
    if not count:
        return None
    for _ in range(math.ceil(math.log2(count + 1)) + 1):
        ahead = point.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("dist").alias("_dist"))
        moved = Observation()
        step = point.join(ahead, "to", "left").select("id", F.coalesce("_to", "to").alias("to"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"), F.col("_to").isNotNull().alias("_moved"))
        step = loops.saved(step.observe(moved, F.count_if("_moved").alias("n")), "points")
        point = step.drop("_moved")
        if not moved.get["n"]:
            break
    # what still points at a pointing node runs in a circle
    heads = nodes.join(point.select("id"), "id", "left_anti")
    way = point.select(F.col("id").alias("source"), F.col("to").alias("_to"), "dist")
    rest = edges.join(heads.select(F.col("id").alias("target")), "target", "left_semi").join(way, "source", "left")
    rest = rest.select(F.coalesce("_to", "source").alias("source"), "target", (F.col("w") + F.coalesce("dist", F.lit(0))).alias("w")).groupBy("source", "target").agg(F.max("w").alias("w"))
    done = _longest(loops.saved(heads, "heads"), loops.saved(rest, "head-edges"))
    behind = point.join(done.select(F.col("id").alias("to"), "round"), "to").select("id", (F.col("round") + F.col("dist")).alias("round"))
    return done.unionByName(behind)


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, position): by round, then node order; what a cycle blocks comes last, in node order. Self-loops block."""
    rounds = peel_rounds(nodes, edges.select("source", "target")).join(nodes.select("id", F.col("ord").alias("_ord")), "id")
    placed = ordered(rounds.select("id", F.col("round").isNull().alias("_blocked"), F.coalesce("round", F.lit(0)).alias("_round"), "_ord"), "_blocked", "_round", "_ord")
    return placed.select("id", (F.col("ord") + 1).cast("int").alias("position"))


def extract(graph: Graph, wanted: str, depth: int = 2, direction: str = "both", most: int = 200) -> Subgraph:
    """The neighbourhood of a node. Ids that are no nodes count towards most; edges stay with both ends visited."""
    spark = graph.nodes.sparkSession
    entry = find_node(graph, wanted).first()
    root = str(graph.header.get("root", ""))
    if entry is None:
        return Subgraph(root, wanted, depth, direction, None, spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))
    visited = bounded_walk(graph, entry["id"], depth, direction, most).select("id")
    nodes = graph.nodes.join(visited, "id", "left_semi").select(graph.nodes.columns)
    edges = graph.edges.join(visited.withColumnRenamed("id", "source"), "source", "left_semi").join(visited.withColumnRenamed("id", "target"), "target", "left_semi").select(graph.edges.columns)
    return Subgraph(root, wanted, depth, direction, entry.asDict(recursive=True), nodes, edges)


def direct_dependencies(graph: Graph, node: str) -> DataFrame:
    """Path of each edge's target, one row an edge."""
    return graph.edges.filter(F.col("source") == node).join(graph.nodes.select(F.col("id").alias("target"), "path"), "target").select("ord", "path")


def direct_dependents(graph: Graph, node: str) -> DataFrame:
    return graph.edges.filter(F.col("target") == node).join(graph.nodes.select(F.col("id").alias("source"), "path"), "source").select("ord", "path")
