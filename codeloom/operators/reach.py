"""Reachability along edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from codeloom.plans import loops
from codeloom.schema import Graph

#: Hops of a job.
HOPS = 4


def _reach(pairs: DataFrame, start: str) -> DataFrame:
    """(source, target), which may repeat -> id: all that start reaches, itself apart.

    The edges are written once, in buckets by source, and stay where they are: a hop
    moves the frontier to them, and what it meets to what is known. A job makes
    several hops and writes the ids that it met; the last hop's are the next frontier.
    """
    spark = pairs.sparkSession
    with loops.scope() as kept, loops.bucketed(pairs.filter(F.col("source") != F.col("target")), "source") as edges:
        known = frontier = spark.createDataFrame([(start, 0)], "id string, hop int")
        while True:
            new, last = None, frontier
            for hop in range(1, HOPS + 1):
                # met again in the same job, a node is sent on again at worst
                fresh = edges.join(last.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
                last = fresh.join(known.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
                new = last if new is None else new.unionByName(last)
            seen = Observation()
            new = new.groupBy("id").agg(F.min("hop").alias("hop"))
            new = loops.saved(new.observe(seen, F.count_if(F.col("hop") == HOPS).alias("last")), "frontier")
            if not seen.get["last"]:
                return loops.result(known.unionByName(new).filter(F.col("id") != start).select("id"), kept)
            known, frontier = loops.saved(known.unionByName(new), "known"), new.filter(F.col("hop") == HOPS)


def blast_radius(graph: Graph, start: str, known_only: bool = False) -> DataFrame:
    """G1: ids that start reaches, unresolved ones too; G3 and G4 with known_only: between nodes only, from a node."""
    return _directed(graph, start, "source", "target", known_only)


def reverse_deps(graph: Graph, start: str, known_only: bool = False) -> DataFrame:
    """Ids from which start is reached."""
    return _directed(graph, start, "target", "source", known_only)


def _directed(graph: Graph, start: str, a: str, b: str, known_only: bool) -> DataFrame:
    edges = graph.edges
    if known_only:
        ids = graph.nodes.select(F.col("id").alias("source"))
        edges = edges.join(ids, "source", "left_semi").join(ids.withColumnRenamed("source", "target"), "target", "left_semi")
    return _reach(edges.select(F.col(a).alias("source"), F.col(b).alias("target")), start)


def reach_indices(graph: Graph, index: int, reverse: bool = False) -> DataFrame:
    """The same by position; none for a position that is no node."""
    at = graph.nodes.filter(F.col("ord") == index).select("id").first()
    spark = graph.nodes.sparkSession
    if at is None:
        return spark.createDataFrame([], "ord long")
    found = (reverse_deps if reverse else blast_radius)(graph, at["id"])
    return graph.nodes.join(found, "id", "left_semi").select("ord")
