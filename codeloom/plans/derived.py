"""Graphs made from relational tables, as DataFrames and as SQL over the same tables.

All read whole tables. fk: files for rows, imports for foreign keys; acyclic,
several languages, some imports unresolved. seq: each part and the parts that follow
it in the first and in the last order in which any does; sparse and cyclic. links:
pages and their hrefs; nearly all unresolved, with repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.operators.build import ordered
from codeloom.plans import loops
from codeloom.schema import Graph

_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_FILES = {"nation": ("n_nationkey", "java"), "customer": ("c_custkey", "ts"), "supplier": ("s_suppkey", "go"), "part": ("p_partkey", "rs"), "orders": ("o_orderkey", "py")}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(table: str, key: Column) -> Column:
    if table == "region":
        return F.concat(F.lit("region/"), key.cast("string"), F.lit("/index.ts"))
    return F.concat(F.lit(f"{table}/"), F.pmod(key, F.lit(16)).cast("string"), F.lit("/"), key.cast("string"), F.lit(f".{_FILES[table][1]}"))


def _distinct(table: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys, by as many tasks as keep what one holds small however large the table is."""
    most = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.select(*keys).repartition(max(most, -(-table.count() // loops.BUCKET_MOST)), *keys).distinct()


def _nodes(paths: DataFrame, keep_order: bool = True) -> DataFrame:
    null = F.lit(None).cast("int")
    none = F.array().cast("array<string>")
    rows = ordered(paths, "path") if keep_order else paths.withColumn("ord", F.lit(0).cast("long"))
    return rows.select("ord", scalars.node_id(F.col("path")).alias("id"), F.lit("File").alias("kind"), scalars.basename(F.col("path")).alias("label"), "path", F.coalesce(scalars.detect_language(F.col("path")), F.lit("html")).alias("language"), null.alias("line_start"), null.alias("line_end"), null.alias("loc"), F.struct(none.alias("exports"), scalars.is_entry_point(F.col("path")).alias("is_entry_point"), none.alias("tags")).alias("metadata"))


def _edges(rows: DataFrame, keep_order: bool = True) -> DataFrame:
    """(from_path, to_path, specifier, kind) -> edges; a null to_path is unresolved."""
    if keep_order:  # of the other end's two columns one counts, so one is moved
        rows = ordered(rows.select("from_path", "kind", F.coalesce("to_path", "specifier").alias("_to"), F.col("to_path").isNotNull().alias("_known")), "from_path", "kind", "_to")
        rows = rows.withColumn("to_path", F.when(F.col("_known"), F.col("_to"))).withColumn("specifier", F.when(~F.col("_known"), F.col("_to")))
    else:
        rows = rows.withColumn("ord", F.lit(0).cast("long"))
    source = scalars.node_id(F.col("from_path"))
    target = F.coalesce(scalars.node_id(F.col("to_path")), scalars.unresolved(F.col("specifier")))
    return rows.select("ord", scalars.edge_id(source, F.coalesce(scalars.node_id(F.col("to_path")), F.col("specifier")), F.col("kind")).alias("id"), source.alias("source"), target.alias("target"), "kind", F.lit(None).cast("string").alias("symbol"), F.col("to_path").isNotNull().alias("resolved"))


def fk(spark: SparkSession, sf_dir: str, keep_order: bool = False, edge_order: bool | None = None) -> Graph:
    """keep_order: whether nodes and edges get their order; edge_order: whether edges do, where that differs."""
    t = {n: _table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    paths = t["region"].select(_path("region", F.col("r_regionkey")).alias("path"))
    for name, (key, _) in _FILES.items():
        paths = paths.unionByName(t[name].select(_path(name, F.col(key)).alias("path")))

    def edge(df: DataFrame, a: Column, b: Column | None, kind: str, specifier: Column | None = None) -> DataFrame:
        return df.select(a.alias("from_path"), (F.lit(None).cast("string") if b is None else b).alias("to_path"), (F.lit(None).cast("string") if specifier is None else specifier).alias("specifier"), F.lit(kind).alias("kind"))

    c = F.col
    big = t["lineitem"]
    edges = edge(t["nation"], _path("nation", c("n_nationkey")), _path("region", c("n_regionkey")), "Import")
    for part in (
        edge(t["customer"], _path("customer", c("c_custkey")), _path("nation", c("c_nationkey")), "Import"),
        edge(t["supplier"], _path("supplier", c("s_suppkey")), _path("nation", c("s_nationkey")), "Import"),
        edge(t["orders"], _path("orders", c("o_orderkey")), _path("customer", c("o_custkey")), "Import"),
        edge(_distinct(big, "l_orderkey", "l_partkey"), _path("orders", c("l_orderkey")), _path("part", c("l_partkey")), "DynamicImport"),
        edge(_distinct(big, "l_partkey", "l_suppkey"), _path("part", c("l_partkey")), _path("supplier", c("l_suppkey")), "ReExport"),
        edge(t["customer"], _path("customer", c("c_custkey")), None, "Import", c("c_mktsegment")),
    ):
        edges = edges.unionByName(part)
    return Graph(_nodes(paths, keep_order), _edges(edges, keep_order if edge_order is None else edge_order), {"root": "fk"})


def fk_most(spark: SparkSession, sf_dir: str) -> int:
    """A bound of the number of fk's edges, from the tables' row counts alone."""
    n = {t: _table(spark, sf_dir, t).count() for t in ("nation", "customer", "supplier", "orders", "lineitem")}
    return n["nation"] + 2 * n["customer"] + n["supplier"] + n["orders"] + 2 * n["lineitem"]


def seq(spark: SparkSession, sf_dir: str, keep_order: bool = False) -> Graph:
    line = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE_ORDER).withColumn("_next", F.lead("l_partkey").over(line))
    rows = rows.filter(F.col("_next").isNotNull() & (F.col("_next") != F.col("l_partkey")))
    place = F.struct("l_orderkey", "l_linenumber", "_next")
    ends = rows.groupBy("l_partkey").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    ends = ends.select("l_partkey", F.explode(F.array("_first._next", "_last._next")).alias("_next"))
    pairs = ends.select(_path("part", F.col("l_partkey")).alias("from_path"), _path("part", F.col("_next")).alias("to_path")).distinct()
    pairs = loops.saved(pairs, "seq")  # nodes and edges are made of it alone, lineitem is sorted once
    edges = pairs.withColumn("specifier", F.lit(None).cast("string")).withColumn("kind", F.lit("Import"))
    paths = pairs.select(F.col("from_path").alias("path")).unionByName(pairs.select(F.col("to_path").alias("path"))).distinct()
    return Graph(_nodes(paths, keep_order), _edges(edges, keep_order), {"root": "seq"})


def links(spark: SparkSession, sf_dir: str) -> Graph:
    pages = _table(spark, sf_dir, "pages").filter(F.col("url").isNotNull())
    paths = pages.select(F.col("url").alias("path")).distinct()
    hrefs = pages.select(F.col("url").alias("from_path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("specifier"))
    known = paths.select(F.col("path").alias("to_path"))
    rows = hrefs.join(known, F.col("specifier") == F.col("to_path"), "left").select("from_path", "to_path", "specifier", F.lit("Import").alias("kind"))
    return Graph(_nodes(paths, False), _edges(rows, False), {"root": "links"})


# ---- the same graphs in SQL: common table expressions `n` (nodes) and `e` (edges)


def _sql_path(table: str, key: str) -> str:
    return f"'region/' || {key} || '/index.ts'" if table == "region" else f"'{table}/' || ({key} % 16) || '/' || {key} || '.{_FILES[table][1]}'"


def _sql_id(path: str) -> str:
    return f"substr(sha256({path}), 1, 16)"


_LANGUAGE_SQL = "CASE regexp_extract(path, '\\.([^./]+)$', 1) WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' ELSE 'html' END"
_NODE_SQL = f"SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS ord, {_sql_id('path')} AS id, path, split_part(path, '/', -1) AS label, {_LANGUAGE_SQL} AS language, split_part(path, '/', -1) = 'index.ts' AS is_entry FROM paths"
_EDGE_SQL = f"SELECT CAST(row_number() OVER (ORDER BY f, kind, coalesce(t, spec)) - 1 AS BIGINT) AS ord, {_sql_id('f')} || '→' || coalesce({_sql_id('t')}, spec) || ':' || kind AS id, {_sql_id('f')} AS source, coalesce({_sql_id('t')}, 'unresolved:' || spec) AS target, kind, t IS NOT NULL AS resolved FROM rows"

_FK_EDGES = [
    ("nation", "n_nationkey", "nation", "region", "n_regionkey", "Import", "true"),
    ("customer", "c_custkey", "customer", "nation", "c_nationkey", "Import", "true"),
    ("supplier", "s_suppkey", "supplier", "nation", "s_nationkey", "Import", "true"),
    ("orders", "o_orderkey", "orders", "customer", "o_custkey", "Import", "true"),
    ("orders", "l_orderkey", "lineitem", "part", "l_partkey", "DynamicImport", "true"),
    ("part", "l_partkey", "lineitem", "supplier", "l_suppkey", "ReExport", "true"),
]
FK_SQL = (
    "paths AS ("
    + " UNION ALL ".join([f"SELECT {_sql_path('region', 'r_regionkey')} AS path FROM region"] + [f"SELECT {_sql_path(n, k)} FROM {n}" for n, (k, _) in _FILES.items()])
    + "), rows AS ("
    + " UNION ALL ".join(f"SELECT DISTINCT {_sql_path(a, ka)} AS f, {_sql_path(b, kb)} AS t, CAST(NULL AS VARCHAR) AS spec, '{kind}' AS kind FROM {frm} WHERE {cond}" for a, ka, frm, b, kb, kind, cond in _FK_EDGES)
    + f" UNION ALL SELECT {_sql_path('customer', 'c_custkey')}, NULL, c_mktsegment, 'Import' FROM customer), n AS ({_NODE_SQL}), e AS ({_EDGE_SQL})"
)
SEQ_SQL = (
    f"l AS (SELECT l_orderkey AS o, l_linenumber AS i, l_partkey AS p, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) AS q FROM lineitem), "
    "m AS (SELECT p, q, row_number() OVER (PARTITION BY p ORDER BY o, i, q) AS a, row_number() OVER (PARTITION BY p ORDER BY o DESC, i DESC, q DESC) AS z FROM l WHERE q IS NOT NULL AND q <> p), "
    f"rows AS (SELECT DISTINCT {_sql_path('part', 'p')} AS f, {_sql_path('part', 'q')} AS t, CAST(NULL AS VARCHAR) AS spec, 'Import' AS kind FROM m WHERE a = 1 OR z = 1), "
    f"paths AS (SELECT f AS path FROM rows UNION SELECT t FROM rows), n AS ({_NODE_SQL}), e AS ({_EDGE_SQL})"
)
