"""What a viewer asks of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.operators import slim
from codeloom.operators.build import ordered
from codeloom.plans import loops
from codeloom.schema import Graph

#: Most nodes shown when zoomed far out; zooms at which functions, and then samples, come in.
FAR_MOST, FULL_ZOOM, FAR_ZOOM = 500, 0.5, 0.1
#: Display colours.
DIM, SELECTED, DEPENDENCY, DEPENDENT, CYCLE, ORPHAN, DIRECTORY = "#1e2130", "#fbbf24", "#22c55e", "#ef4444", "#ef4444", "#f59e0b", "#06b6d4"
DEPRECATED, DEPRECATED_DIM = "#4a5068", "#3d4255"


def search(graph: Graph, query: str, empty_matches: bool = True) -> DataFrame:
    """Nodes with query in label or path. The empty query matches all, or none if told so."""
    if not query and not empty_matches:
        return graph.nodes.limit(0)
    return graph.nodes.filter(scalars.matches(F.col("label"), F.col("path"), query))


def visible_nodes(nodes: DataFrame, positions: DataFrame | None, viewport: list[float]) -> DataFrame:
    """(ord, place) of the nodes to draw in a viewport [x, y, width, height, zoom].

    Near: all in the box; farther: no functions; far, beyond FAR_MOST: entry points,
    then every step-th node in the box, entry points taking up steps but no places.
    """

    def numbered(df: DataFrame, *by: str) -> DataFrame:
        places = ordered(df.withColumnRenamed("ord", "_ord"), *["_ord" if b == "ord" else b for b in by])
        return places.select(F.col("_ord").alias("ord"), (F.col("ord") + 1).cast("int").alias("place"))

    if len(viewport) < 5 or positions is None or positions.isEmpty():
        return numbered(nodes.select("ord"), "ord")
    x, y, width, height, zoom = viewport[:5]
    inside = nodes.join(positions.select("ord", "x", "y"), "ord").filter(F.col("x").between(x, x + width) & F.col("y").between(y, y + height))
    if FAR_ZOOM <= zoom < FULL_ZOOM:
        inside = inside.filter(F.col("kind") != "Function")
    if zoom >= FAR_ZOOM:
        return numbered(inside.select("ord"), "ord")
    entry = F.coalesce(F.col("metadata.is_entry_point"), F.lit(False))
    n, entries = inside.agg(F.count("*"), F.count(F.when(entry, 1))).first()
    if n <= FAR_MOST:
        return numbered(inside.select("ord"), "ord")
    room = FAR_MOST - entries
    first = inside.filter(entry).select("ord", F.lit(0).alias("_kind"))
    if room > 0:
        step = max(1, n // room)
        steps = ordered(inside.select(F.col("ord").alias("_ord"), entry.alias("_entry")), "_ord").select(F.col("_ord").alias("ord"), "_entry", F.col("ord").alias("_at"))
        rest = steps.filter(~F.col("_entry") & (F.col("_at") % step == 0)).select("ord", F.lit(1).alias("_kind")).orderBy("ord").limit(room)
        first = first.unionByName(rest)
    return numbered(first, "_kind", "ord")


def edge_indices(graph: Graph) -> DataFrame:
    """Positions of each edge's ends; 0 for an end that is no node."""
    at = graph.nodes.select(slim.key(F.col("id")).alias("_k"), "ord")
    out = slim.slim(graph.edges.select(F.col("ord").alias("edge"), "source", "target"))
    out = out.join(at.select(F.col("_k").alias("source"), F.col("ord").alias("_s")), "source", "left").join(at.select(F.col("_k").alias("target"), F.col("ord").alias("_t")), "target", "left")
    return out.select("edge", F.coalesce("_s", F.lit(0)).alias("source_index"), F.coalesce("_t", F.lit(0)).alias("target_index"))


def node(graph: Graph, node_id: str) -> DataFrame:
    """G21."""
    return graph.nodes.filter(F.col("id") == node_id)


def neighbours(graph: Graph, node_id: str) -> DataFrame:
    """Ids joined to a node by an edge either way."""
    ahead = graph.edges.filter(F.col("source") == node_id).select(F.col("target").alias("id"))
    return ahead.unionByName(graph.edges.filter(F.col("target") == node_id).select(F.col("source").alias("id"))).distinct()


def simple(graph: Graph, by: tuple[str, ...] = ("ord",), most: int | None = None) -> Graph:
    """Edges between nodes only, the first for each pair of ends.

    by: columns that put edges of the same ends in their order. most: a bound of the number of edges, where one is cheap to read; else they are counted.
    """
    parts = loops.buckets(graph.edges.sparkSession, graph.edges.count() if most is None else most)
    edges = slim.between(slim.slim(graph.edges), graph.nodes, parts)
    first = F.row_number().over(Window.partitionBy("source", "target").orderBy(*by))
    return Graph(graph.nodes, slim.whole(edges.withColumn("_n", first).filter("_n = 1")).select(graph.edges.columns), graph.header)


def expand(graph: Graph, functions: DataFrame, file_id: str) -> Graph:
    """Add a file's functions (id, name, kind, file_path, lines, calls) as nodes, with edges to known ends only."""
    parent = graph.nodes.filter(F.col("id") == file_id).select(F.col("language").alias("_language"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("name"))
    new = functions.withColumn("_n", first).filter("_n = 1").join(graph.nodes.select("id"), "id", "left_anti").crossJoin(F.broadcast(parent.limit(1)))  # one parent
    top = graph.nodes.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    order = F.row_number().over(Window.orderBy("id")) + top
    metadata = F.struct(F.array().cast("array<string>").alias("exports"), F.lit(False).alias("is_entry_point"), F.array().cast("array<string>").alias("tags"))
    null = F.lit(None).cast("int")
    added = new.select(order.cast("long").alias("ord"), "id", F.initcap("kind").alias("kind"), F.col("name").alias("label"), F.col("file_path").alias("path"), F.col("_language").alias("language"), null.alias("line_start"), null.alias("line_end"), F.col("lines").cast("int").alias("loc"), metadata.alias("metadata"))
    nodes = graph.nodes.unionByName(added)
    contains = new.select(F.lit(file_id).alias("source"), F.col("id").alias("target"), F.lit("Contains").alias("kind"))
    calls = new.select(F.col("id").alias("source"), F.explode("calls").alias("target"), F.lit("Call").alias("kind")).join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "kind")
    both = contains.unionByName(calls).distinct().join(graph.edges.select("source", "target"), ["source", "target"], "left_anti")
    last = graph.edges.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    edges = both.select((F.row_number().over(Window.orderBy("source", "target")) + last).cast("long").alias("ord"), scalars.edge_id(F.col("source"), F.col("target"), F.col("kind")).alias("id"), "source", "target", "kind", F.lit(None).cast("string").alias("symbol"), F.lit(True).alias("resolved"))
    return Graph(nodes, graph.edges.unionByName(edges), graph.header)


def collapse(graph: Graph, ids: DataFrame) -> Graph:
    """Without the nodes in ids (id), and without their edges."""
    gone = ids.select("id")
    edges = graph.edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return Graph(graph.nodes.join(gone, "id", "left_anti").select(graph.nodes.columns), edges.select(graph.edges.columns), graph.header)


def _active(flags: dict[str, str | None]) -> str | None:
    return next((mode for mode in ("selected", "search", "cycle", "orphan", "directory") if flags.get(mode)), None)


def highlight(nodes: DataFrame, flags: dict[str, str | None], color: str = "color", deprecated: str | None = None) -> DataFrame:
    """nodes with shown_color and dimmed. flags: mode -> its boolean column.

    Only the first active mode counts: selected (with columns `dep` and `dependent`
    beside), search, cycle, orphan, directory. Deprecated nodes are greyed.
    """
    mode = _active(flags)
    own = F.col(color)
    if mode is None:
        return nodes.withColumn("shown_color", own).withColumn("dimmed", F.lit(False))
    on = F.coalesce(F.col(flags[mode]), F.lit(False))
    if mode == "selected":
        dep, dependent = (F.coalesce(F.col(flags[k]), F.lit(False)) if flags.get(k) else F.lit(False) for k in ("dep", "dependent"))
        shown: Column = F.when(on, SELECTED).when(dep, DEPENDENCY).when(dependent, DEPENDENT).otherwise(DIM)
        dimmed = ~(on | dep | dependent)
    else:
        bright = {"search": own, "cycle": F.lit(CYCLE), "orphan": F.lit(ORPHAN), "directory": F.lit(DIRECTORY)}[mode]
        shown, dimmed = F.when(on, bright).otherwise(DIM), ~on
    if deprecated:
        old = F.coalesce(F.col(deprecated), F.lit(False))
        shown = F.when(old & dimmed, DEPRECATED_DIM).when(old, DEPRECATED).otherwise(shown)
    return nodes.withColumn("shown_color", shown).withColumn("dimmed", dimmed)


def visible_edges(edges: DataFrame, cycle: DataFrame | None = None, lit: DataFrame | None = None) -> DataFrame:
    """with cycle (id of edges) these only; else with lit (id of nodes) edges with both ends lit; else all."""
    if cycle is not None:
        return edges.join(cycle.select("id"), "id", "left_semi")
    if lit is not None:
        return slim.whole(slim.between(slim.slim(edges), lit)).select(edges.columns)
    return edges
