"""Building a graph from parsed files."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.schema import Graph


def ordered(df: DataFrame, *by: str) -> DataFrame:
    """ord from 0 in the order of by: rows are sorted inside ranges and numbered as they are written, then shifted, so no task sees all rows and each moves once."""
    from codeloom.plans import loops

    parts = df.repartitionByRange(*[F.col(b) for b in by]).sortWithinPartitions(*by)
    return numbered(loops.saved(parts.withColumn("_number", F.monotonically_increasing_id()), "ordered"), F.shiftright("_number", 33))


def numbered(rows: DataFrame, part: Column) -> DataFrame:
    """A saved table whose _number rises by one inside each part -> ord from 0, through the parts in their order, in place of _number."""
    rows = rows.withColumn("_part", part)
    shifts, before = [], 0
    for p, n, first in sorted(rows.groupBy("_part").agg(F.count("*"), F.min("_number")).collect()):  # a row per part
        shifts.append((p, before - first))
        before += n
    found = rows.sparkSession.createDataFrame(shifts, "_part long, _shift long")
    return rows.join(F.broadcast(found), "_part").withColumn("ord", F.col("_number") + F.col("_shift")).drop("_part", "_number", "_shift")


#: What nodes and edges are numbered by.
NODE_ORDER, EDGE_ORDER = ("path", "_group", "_i", "id"), ("path", "_copy", "_group", "_i")
NODE_COLUMNS = ("id", "kind", "label", "path", "language", "line_start", "line_end", "loc", "metadata")
EDGE_COLUMNS = ("id", "source", "target", "kind", "symbol", "resolved")


def file_rows(asts: DataFrame, level: str = "file", also: tuple[str, ...] = (), once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of files, with the columns they are ordered by; each file's hang on its own row of asts alone.

    also: columns of asts that its nodes and edges keep; once: asts is a table with a row per path. Edges have the specifier of their import, and no id yet; a null target is unknown.
    """
    from codeloom.plans import loops

    asts = asts.select("path", "language", "imports", "exports", "functions", "classes", *also)
    if once:
        asts = asts.withColumn("_copy", F.lit(1))
    else:
        asts = asts.withColumn("_copy", F.row_number().over(Window.partitionBy("path").orderBy(F.to_json(F.struct("imports", "functions", "classes")))))
        asts = loops.saved(asts, "files")  # each kind of row reads the table
    asts = asts.withColumn("_file", scalars.node_id(F.col("path")))
    tags = F.array().cast("array<string>")
    null = F.lit(None).cast("int")
    exports = F.transform(F.coalesce("exports", F.array()), lambda e: e["symbol"]).cast("array<string>")
    about = F.struct(exports.alias("exports"), scalars.is_entry_point(F.col("path")).alias("is_entry_point"), tags.alias("tags"))
    nodes = asts.select(
        "path", F.lit(0).alias("_group"), F.lit(0).alias("_i"), "_copy", F.col("_file").alias("id"), F.lit("File").alias("kind"), scalars.basename(F.col("path")).alias("label"),
        "language", null.alias("line_start"), null.alias("line_end"), null.alias("loc"), about.alias("metadata"), *also,
    )
    contains = None
    if level == "function":
        for group, (column, kind, key) in enumerate((("functions", "Function", scalars.function_key), ("classes", "Class", scalars.class_key)), 1):
            each = asts.select("path", "language", "_copy", "_file", *also, F.posexplode(column).alias("_i", "_d"))
            ident = scalars.node_id(key(F.col("path"), F.col("_d.name")))
            inner = F.struct(tags.alias("exports"), F.lit(False).alias("is_entry_point"), tags.alias("tags"))
            nodes = nodes.unionByName(each.select(
                "path", F.lit(group).alias("_group"), "_i", "_copy", ident.alias("id"), F.lit(kind).alias("kind"), F.col("_d.name").alias("label"), "language",
                F.col("_d.line_start").alias("line_start"), F.col("_d.line_end").alias("line_end"), scalars.declared_loc(F.col("_d.line_start"), F.col("_d.line_end")).alias("loc"), inner.alias("metadata"), *also,
            ))
            none = F.lit(None).cast("string")
            part = each.select("path", F.lit(group).alias("_group"), "_i", "_copy", F.col("_file").alias("source"), ident.alias("target"), F.lit("Contains").alias("kind"), none.alias("symbol"), none.alias("specifier"), *also)
            contains = part if contains is None else contains.unionByName(part)
    first = F.row_number().over(Window.partitionBy("id").orderBy("path", "_copy", "_group", "_i"))
    nodes = nodes.withColumn("_n", first).filter("_n = 1").drop("_n")
    kind = F.when(F.col("_m.kind") == "dynamic", "DynamicImport").when(F.col("_m.kind") == "reexport", "ReExport").otherwise("Import")
    imports = asts.select("path", F.lit(0).alias("_group"), "_copy", F.col("_file").alias("source"), *also, F.posexplode("imports").alias("_i", "_m"))
    imports = imports.select("path", "_group", "_i", "_copy", "source", scalars.node_id(F.col("_m.resolved_path")).alias("target"), kind.alias("kind"), F.get(F.col("_m.symbols"), 0).alias("symbol"), F.col("_m.specifier").alias("specifier"), *also)
    return nodes, imports if contains is None else imports.unionByName(contains)


def named_edges(edges: DataFrame) -> DataFrame:
    """Edges of file_rows() with their ids, and open targets for unknown ones."""
    dangling = F.col("target").isNull()
    end = F.when(dangling, F.col("specifier")).otherwise(F.col("target"))
    return edges.withColumn("id", scalars.edge_id(F.col("source"), end, F.col("kind"))).withColumn("target", F.when(dangling, scalars.unresolved(F.col("specifier"))).otherwise(F.col("target")))


def build(asts: DataFrame, level: str = "file", root: str = "", cache_hits: int = 0, parse_ms: int = 0, scanned_at: str | None = None) -> Graph:
    """asts (path, language, imports with resolved_path, exports, functions, classes) -> Graph.

    Nodes: files by path, each followed by its functions and classes (level
    "function"); the first of equal ids stays. Edges: per file the imports in source
    order, then what the file contains; none is merged. A repeated row of asts adds
    its edges again. A file without a known target points at unresolved:<specifier>.
    """
    nodes, edges = file_rows(asts, level)
    nodes = ordered(nodes, *NODE_ORDER).select("ord", *NODE_COLUMNS)
    known = nodes.select(F.col("id").alias("target"), F.lit(True).alias("_known"))
    edges = edges.join(known, "target", "left").withColumn("resolved", F.coalesce("_known", F.lit(False)))
    edges = ordered(named_edges(edges), *EDGE_ORDER).select("ord", *EDGE_COLUMNS)
    at = scanned_at or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return Graph(nodes, edges, {"root": root, "scanned_at": at, "cache_hits": cache_hits, "parse_duration_ms": parse_ms})


def languages(nodes: DataFrame) -> DataFrame:
    """Distinct languages, sorted."""
    return nodes.select("language").distinct().orderBy("language")


def stats(graph: Graph) -> DataFrame:
    """One row; edges are counted as often as they occur."""
    counts = graph.nodes.agg(F.count_if(F.col("kind") == "File").alias("file_count"), F.count_if(F.col("kind").isin("Function", "Class")).alias("function_count"))
    edges = graph.edges.agg(F.count("*").alias("edge_count"))
    # two tables of one row each
    return counts.join(F.broadcast(edges)).select("file_count", "function_count", "edge_count", F.lit(int(graph.header.get("parse_duration_ms", 0))).cast("long").alias("parse_duration_ms"), F.lit(int(graph.header.get("cache_hits", 0))).cast("long").alias("cache_hits"))


def manual(nodes: DataFrame, edges: DataFrame, root: str = "") -> Graph:
    """A graph from tables."""
    return Graph(nodes, edges, {"root": root, "cache_hits": 0, "parse_duration_ms": 0, "scanned_at": ""})


def functions_by_file(asts: DataFrame) -> DataFrame:
    """Functions and classes of each file, one row each; filter by file_path for one file's."""
    fn = asts.select(F.col("path").alias("file_path"), F.explode("functions").alias("_d")).select("file_path", F.col("_d.name").alias("name"), F.concat(F.col("_d.name"), F.lit("()")).alias("signature"), F.lit("function").alias("kind"), scalars.declared_loc(F.col("_d.line_start"), F.col("_d.line_end")).alias("lines"), F.transform("_d.calls", lambda c: c["callee"]).alias("calls"))
    cl = asts.select(F.col("path").alias("file_path"), F.explode("classes").alias("_d")).select("file_path", F.col("_d.name").alias("name"), F.col("_d.name").alias("signature"), F.lit("class").alias("kind"), scalars.declared_loc(F.col("_d.line_start"), F.col("_d.line_end")).alias("lines"), F.array().cast("array<string>").alias("calls"))
    return fn.unionByName(cl).withColumn("id", F.concat(scalars.node_id(F.col("file_path")), F.lit("::"), F.col("name")))
