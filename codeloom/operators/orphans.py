"""Files that nothing imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.schema import IMPORTING, Graph


def detect_orphans(graph: Graph) -> DataFrame:
    """Files without a resolved import, dynamic import or re-export that points at them; by path."""
    imported = graph.edges.filter(F.col("resolved") & F.col("kind").isin(*IMPORTING)).select(F.col("target").alias("id"))
    files = graph.nodes.filter(F.col("kind") == "File")
    return files.join(imported, "id", "left_anti").select("id", "path", "language", F.col("metadata.is_entry_point").alias("is_entry_point")).orderBy("path")


def orphans_any_edge(graph: Graph, added: DataFrame | None = None) -> DataFrame:
    """Nodes without any edge in, but those of `added` (id), which were put in later."""
    out = graph.nodes.join(graph.edges.select(F.col("target").alias("id")), "id", "left_anti")
    if added is not None:
        out = out.join(added.select("id"), "id", "left_anti")
    return out.select("id", "path").orderBy("path")


def split(orphans: DataFrame) -> DataFrame:
    """Orphans with whether they are dead code or entry points, which are expected to have no importers."""
    return orphans.withColumn("status", F.when(F.col("is_entry_point"), "entry_point").otherwise("dead"))
