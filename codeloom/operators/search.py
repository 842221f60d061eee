"""Indexed search in a stored graph (G11, G18): trigrams for substrings, reversed paths for suffixes.

The index is three tables beside each other. `grams` holds, for each run of three
signs of a node's label and path in lower case, the nodes that have it, in slots by
hash and sorted, so a query reads the slots of its own grams and in them the row
groups that can hold these. `suffixes` holds nodes sorted by their reversed path, in
which paths with one ending lie side by side, `labels` nodes sorted by label. What the
index finds is then tested as a scan would test it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.schema import Graph

#: Signs of a run; slots of the runs; runs of a query that are looked up, at most; bytes of a row group, about.
GRAM, SLOTS, LOOKED, ROW_GROUP = 3, 64, 12, 4 << 20


def grams_of(text: Column) -> Column:
    """All runs of GRAM signs of a text, once each."""
    n = F.length(text)
    runs = F.transform(F.sequence(F.lit(1), n - (GRAM - 1)), lambda i: F.substr(text, i, F.lit(GRAM)))
    return F.when(n >= GRAM, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


class SearchIndex:
    """The index at a path, of the graph that it was written from."""

    def __init__(self, path: str):
        self.path = path

    def write(self, graph: Graph, row_group: int = ROW_GROUP) -> None:
        nodes = graph.nodes

        def put(df: DataFrame, table: str, *order: str, by: str | None = None) -> None:
            out = (df.repartition(by) if by else df.repartitionByRange(*order)).sortWithinPartitions(*([by] if by else []), *order).write.mode("overwrite").option("parquet.block.size", row_group)
            (out.partitionBy(by) if by else out).parquet(f"{self.path}/{table}")

        both = F.array_union(grams_of(F.lower("label")), grams_of(F.lower("path")))
        put(nodes.select(F.explode(both).alias("gram"), "ord").withColumn("slot", _slot(F.col("gram"))), "grams", "gram", "ord", by="slot")
        put(nodes.withColumn("reversed", F.reverse("path")), "suffixes", "reversed", "ord")
        put(nodes.select("label", "ord"), "labels", "label", "ord")
        put(nodes, "nodes", "ord")

    def _read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{table}")

    def candidates(self, spark: SparkSession, query: str) -> DataFrame | None:
        """(ord) of the nodes that have all runs of the query; None for queries without any, which only a scan can answer."""
        low = query.lower()
        runs = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})[:LOOKED]
        if not runs:
            return None
        slots = [r[0] for r in spark.createDataFrame([(g,) for g in runs], "gram string").select(_slot(F.col("gram"))).distinct().collect()]
        met = self._read(spark, "grams").filter(F.col("slot").isin(slots) & F.col("gram").isin(runs))
        return met.groupBy("ord").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(runs)).select("ord")

    def search(self, spark: SparkSession, query: str) -> DataFrame:
        """Nodes with query in label or path, in any case."""
        nodes, found = self._read(spark, "nodes"), self.candidates(spark, query)
        return (nodes if found is None else nodes.join(found, "ord", "left_semi")).filter(scalars.matches(F.col("label"), F.col("path"), query))

    def find(self, spark: SparkSession, wanted: str) -> DataFrame:
        """The node of this path; else the first whose path ends so or whose label is so. At most one row."""
        suffixes = self._read(spark, "suffixes")
        ends = suffixes.filter(F.col("reversed").startswith(wanted[::-1])).select("ord", (F.col("path") == wanted).alias("exact"))
        named = self._read(spark, "labels").filter(F.col("label") == wanted).select("ord", F.lit(False).alias("exact"))
        first = ends.unionByName(named).orderBy(F.desc("exact"), "ord").limit(1).first()
        nodes = self._read(spark, "nodes")
        return nodes.filter(F.col("ord") == first["ord"]) if first else nodes.limit(0)
