"""Directory roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.schema import Graph


def directory_groups(graph: Graph) -> DataFrame:
    """Files per directory; first is the order of the first file met. Members are file_ids()."""
    files = graph.nodes.filter(F.col("kind") == "File").withColumn("directory", scalars.directory(F.col("path")))
    return files.groupBy("directory").agg(F.count("*").alias("files"), F.min("ord").alias("first")).orderBy(F.desc("files"), "first")


def file_ids(graph: Graph) -> DataFrame:
    """(directory, id) of the members, one row each: no group is gathered."""
    return graph.nodes.filter(F.col("kind") == "File").select(scalars.directory(F.col("path")).alias("directory"), "id", "ord")


def inter_module_edges(graph: Graph) -> DataFrame:
    """Distinct node pairs between directories, counted by pair of directories."""
    files = graph.nodes.filter(F.col("kind") == "File").select("id", scalars.directory(F.col("path")).alias("directory"))
    pairs = graph.edges.select("source", "target").distinct()
    ends = pairs.join(files.select(F.col("id").alias("source"), F.col("directory").alias("from")), "source").join(files.select(F.col("id").alias("target"), F.col("directory").alias("to")), "target")
    return ends.filter(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.count("*").alias("edges"))


def outgoing(graph: Graph) -> DataFrame:
    """Edges from each directory to others, 0 where there are none."""
    sums = inter_module_edges(graph).groupBy(F.col("from").alias("directory")).agg(F.sum("edges").alias("outgoing"))
    return directory_groups(graph).join(sums, "directory", "left").select("directory", "files", F.coalesce("outgoing", F.lit(0)).alias("outgoing"))
