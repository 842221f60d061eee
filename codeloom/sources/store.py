"""Stored tables: parse cache, graphs, annotations, JSON graphs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.plans import loops
from codeloom.schema import EDGE_SCHEMA, NODE_SCHEMA, Graph

ANNOTATION_SCHEMA = "path string, team string, domain string, status string, tags array<string>"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, None where there is none."""
    return spark.read.parquet(path) if _exists(spark, path) else None


def latest(rows: DataFrame, keys: list[str], at: str = "parsed_at") -> DataFrame:
    """Of rows with equal keys the one written last."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at)))
    return rows.withColumn("_n", number).filter("_n = 1").drop("_n")


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], at: str = "parsed_at") -> DataFrame:
    """Merge rows into the table at path, newest per key; the old table is read in full before it is replaced."""
    old = read_table(spark, path)
    merged = loops.saved(latest(rows if old is None else old.unionByName(rows, allowMissingColumns=True), keys, at), "merged")
    merged.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: What a parse depends on.
CACHE_KEY = ["content_hash", "language", "body_spans"]


def cache_rows(asts: DataFrame, parsed_at: int, body_spans: bool = False) -> DataFrame:
    """Rows for the parse cache; the key is content, language and whether spans cover bodies."""
    return asts.select("content_hash", "language", F.lit(body_spans).alias("body_spans"), "path", "imports", "exports", "functions", "classes", F.lit(parsed_at).cast("long").alias("parsed_at"))


def hit_count(asts: DataFrame) -> DataFrame:
    """B11."""
    return asts.agg(F.count_if("hit").alias("cache_hits"))


def save_graph(graph: Graph, path: str) -> None:
    """K11."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    header = [(k, str(v)) for k, v in graph.header.items()]
    graph.nodes.sparkSession.createDataFrame(header, "key string, value string").write.mode("overwrite").parquet(f"{path}/header")


def load_graph(spark: SparkSession, path: str) -> Graph | None:
    """S10; None where there is none."""
    if not _exists(spark, f"{path}/nodes"):
        return None
    header = {r["key"]: int(r["value"]) if r["key"] in ("cache_hits", "parse_duration_ms") else r["value"] for r in spark.read.parquet(f"{path}/header").collect()}
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), header)


def graph_from_json(texts: DataFrame) -> Graph:
    """(value) with one JSON graph -> Graph, in the order of its arrays."""

    def array_of(schema) -> str:
        return "array<struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema if f.name != "ord") + ">>"

    parsed = texts.select(F.from_json("value", f"root string, scanned_at string, nodes {array_of(NODE_SCHEMA)}, edges {array_of(EDGE_SCHEMA)}").alias("g"))

    def rows(name: str, schema) -> DataFrame:
        return parsed.select(F.posexplode(f"g.{name}").alias("_i", "_r")).select(F.col("_i").cast("long").alias("ord"), "_r.*").select(*[f.name for f in schema])

    head = parsed.select("g.root", "g.scanned_at").first()
    return Graph(rows("nodes", NODE_SCHEMA), rows("edges", EDGE_SCHEMA), {"root": head["root"], "scanned_at": head["scanned_at"]})


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """A YAML map of path -> fields; a missing file gives no rows, a broken one raises."""
    rows = []
    if os.path.exists(path):
        import yaml

        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
        rows = [(p, v.get("team"), v.get("domain"), v.get("status"), list(v.get("tags") or [])) for p, v in (data.get("annotations", data) or {}).items()]
    return spark.createDataFrame(rows, ANNOTATION_SCHEMA)


def save_annotations(annotations: DataFrame, path: str) -> None:
    """Replace the file. Annotations are written by hand, one row a file."""
    import yaml

    data = {}
    for r in annotations.orderBy("path").toLocalIterator():
        data[r["path"]] = {k: r[k] for k in ("team", "domain", "status") if r[k] is not None} | ({"tags": list(r["tags"])} if r["tags"] else {})
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(data, f, sort_keys=True, allow_unicode=True)


def list_annotations(annotations: DataFrame) -> DataFrame:
    """By path, with the display line."""
    line = scalars.annotation_line(F.col("team"), F.col("domain"), F.col("status"), F.col("tags"))
    return annotations.select("path", line.alias("line")).orderBy("path")


def remove_annotation(annotations: DataFrame, path: str) -> tuple[DataFrame, bool]:
    """The others, and whether there was one."""
    return annotations.filter(F.col("path") != path), not annotations.filter(F.col("path") == path).isEmpty()


def upsert_annotations(annotations: DataFrame, changes: DataFrame) -> DataFrame:
    """Given fields overwrite, absent (null) ones stay; tags are replaced as a whole."""
    new = changes.select("path", *[F.col(c).alias(f"_{c}") for c in ("team", "domain", "status", "tags")])
    out = annotations.join(new, "path", "full")
    return out.select("path", *[F.coalesce(f"_{c}", c).alias(c) for c in ("team", "domain", "status", "tags")])


def set_annotation(annotations: DataFrame, path: str, team: str | None = None, domain: str | None = None, status: str | None = None, tags: list[str] | None = None) -> DataFrame:
    if team is domain is status is tags is None:
        raise ValueError("nothing to set: give a team, domain, status or tags")
    return upsert_annotations(annotations, annotations.sparkSession.createDataFrame([(path, team, domain, status, tags)], ANNOTATION_SCHEMA))


def annotate_nodes(graph: Graph, annotations: DataFrame) -> DataFrame:
    """Nodes with team, domain, status, and the tags of both."""
    own = F.coalesce("metadata.tags", F.array().cast("array<string>"))
    joined = graph.nodes.join(annotations.withColumnRenamed("tags", "_tags"), "path", "left")
    return joined.withColumn("display_tags", F.concat(own, F.coalesce("_tags", F.array().cast("array<string>")))).drop("_tags")
