"""Exports of graphs and subgraphs."""

from __future__ import annotations

import gzip
import json
import math
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.operators import cycles as cycle_ops
from codeloom.operators import orphans as orphan_ops
from codeloom.operators import slim
from codeloom.operators.build import numbered
from codeloom.operators.build import stats as graph_stats
from codeloom.operators.subgraph import Subgraph
from codeloom.plans import fs, loops
from codeloom.schema import EDGE_SCHEMA, NODE_SCHEMA, VERSION, Graph

#: Files of a compressed document, in their order: texts, and folders of parts.
_HEAD, _NODES, _EDGES = "0-head.json.gz", "1-nodes", "3-edges"


def _plain(df: DataFrame) -> list[dict]:
    return [{k: v for k, v in r.asDict(recursive=True).items() if k != "ord"} for r in df.orderBy("ord").toLocalIterator()]


def to_json(graph: Graph, pretty: bool = False) -> str:
    """One document. It is one string, so it is written by the driver, row by row."""
    doc = {
        "version": VERSION,
        "root": graph.header.get("root", ""),
        "scanned_at": graph.header.get("scanned_at", ""),
        "languages": [r[0] for r in graph.nodes.select("language").distinct().orderBy("language").collect()],
        "nodes": _plain(graph.nodes),
        "edges": _plain(graph.edges),
        "stats": graph_stats(graph).first().asDict(),
    }
    return json.dumps(doc, indent=2, ensure_ascii=False) if pretty else json.dumps(doc, separators=(",", ":"), ensure_ascii=False)


def json_lines(graph: Graph) -> DataFrame:
    """K1 for graphs of any size: one JSON row per node and edge, to be written as text."""
    whole = {"ignoreNullFields": "false"}
    nodes = graph.nodes.select(F.lit(0).alias("part"), "ord", F.to_json(F.struct(*[c for c in graph.nodes.columns if c != "ord"]), whole).alias("line"))
    edges = graph.edges.select(F.lit(1).alias("part"), "ord", F.to_json(F.struct(*[c for c in graph.edges.columns if c != "ord"]), whole).alias("line"))
    return nodes.unionByName(edges)


def write_json(graph: Graph, path: str, compressed: bool = False) -> None:
    """K1, K16 for graphs of any size: one JSON document, an element a line.

    Tasks write the lines of their range as a part; the parts, in order, are then
    moved into one file, piece by piece. The driver holds none of them, and the disk
    holds the document once and one part. compressed: path becomes a folder instead,
    in which the parts stay where tasks wrote them, compressed; the bytes of its files
    named [0-9]* and part-*, in order of their paths, are the document in gzip's format.
    """
    spark = graph.nodes.sparkSession
    head = {"version": VERSION, "root": graph.header.get("root", ""), "scanned_at": graph.header.get("scanned_at", ""), "languages": [r[0] for r in graph.nodes.select("language").distinct().orderBy("language").collect()]}
    tail = json.dumps(graph_stats(graph).first().asDict())
    parts = path if compressed else f"{path}.parts"
    for place, df in ((_NODES, graph.nodes), (_EDGES, graph.edges)):
        first, count = df.agg(F.min("ord"), F.count("*")).first()
        opens = F.col("ord").eqNullSafe(F.lit(first).cast("long"))
        # rows are moved as columns, and become lines where they are written
        line = F.to_json(F.struct(*[c for c in df.columns if c != "ord"]), {"ignoreNullFields": "false"})
        moved = slim.slim(df) if place == _EDGES else df
        rows = moved.repartitionByRange(loops.buckets(spark, count), "ord").sortWithinPartitions("ord")
        rows = (slim.whole(rows) if place == _EDGES else rows).select(F.concat(F.when(opens, " ").otherwise(","), line).alias("line"))
        rows.write.mode("overwrite").option("compression", "gzip" if compressed else "none").text(f"{parts}/{place}")
    begin, between, end = json.dumps(head, ensure_ascii=False)[:-1] + ', "nodes": [\n', '], "edges": [\n', f'], "stats": {tail}}}\n'
    if compressed:
        for name, text in ((_HEAD, begin), ("2-between.json.gz", between), ("4-tail.json.gz", end)):
            fs.write_bytes(spark, f"{path}/{name}", gzip.compress(text.encode("utf-8")))
        return
    fs.joined(spark, [begin, (f"{parts}/{_NODES}",), between, (f"{parts}/{_EDGES}",), end], path)
    fs.delete(spark, parts)


def read_json(spark: SparkSession, path: str) -> Graph:
    """S12 for documents of write_json(), of either form: lines are parsed by tasks, in the order of their places in the document.

    Lines of a block of the file, or of a part, are read one after the other, so they are
    numbered as they are parsed and shifted by the elements of the blocks before; none is moved.
    """
    folder = fs.is_folder(spark, path)

    def fields(schema) -> str:
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema if f.name != "ord")

    def lines(place: str) -> DataFrame:
        block = F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1).cast("long") if folder else F.col("_metadata.file_block_start")
        return spark.read.text(f"{path}/{place}" if folder else path).select("value", block.alias("_block"))

    def rows(place: str, schema, own: str, other: str) -> DataFrame:
        opened = F.substring("value", 1, 2).isin(" {", ",{")
        mine = lines(place).filter(opened & F.contains("value", F.lit(f'"{own}":')))  # inside strings quotes are escaped
        # as rows of a generator lines are parsed once, whatever is asked of their fields
        parsed = mine.select("_block", F.inline(F.array(F.from_json(F.substring("value", 2, 2**30), f"{fields(schema)}, {other} string"))))
        kept = parsed.filter(F.col(other).isNull() & F.col(own).isNotNull()).drop(other)
        table = loops.saved(kept.withColumn("_number", F.monotonically_increasing_id()), "elements")
        return numbered(table, F.col("_block")).select([f.name for f in schema])

    head = json.loads(lines(_HEAD).filter(F.col("value").startswith('{"version"')).select("value").first()[0] + "]}")
    return Graph(rows(_NODES, NODE_SCHEMA, "label", "source"), rows(_EDGES, EDGE_SCHEMA, "source", "label"), {"root": head["root"], "scanned_at": head["scanned_at"]})


def dot_lines(graph: Graph) -> DataFrame:
    """K2: (part, ord, line) of the body of a DOT document, nodes before edges; nothing is escaped or merged."""
    nodes = graph.nodes.select(F.lit(0).alias("part"), "ord", F.format_string('  "%s" [label="%s"];', "id", "label").alias("line"))
    edges = graph.edges.select(F.lit(1).alias("part"), "ord", F.format_string('  "%s" -> "%s";', "source", "target").alias("line"))
    return nodes.unionByName(edges)


def to_dot(graph: Graph, name: str = "dependencies") -> str:
    body = [r["line"] for r in dot_lines(graph).orderBy("part", "ord").toLocalIterator()]
    return "\n".join([f"digraph {name} {{", "  rankdir=LR;", "  node [shape=box];", *body, "}"])


def _subgraph_parts(sub: Subgraph) -> tuple[list[dict], list[dict], list[str], list[str]]:
    """A subgraph's rows; it is bounded by its own limit of nodes."""
    nodes, edges = _plain(sub.nodes), _plain(sub.edges)
    return nodes, edges, sorted({n["language"] for n in nodes}), [r["id"] for r in sub.order.orderBy("position").collect()]


def to_ai_json(sub: Subgraph, exported_at: str) -> str:
    """K3."""
    nodes, edges, languages, order = _subgraph_parts(sub)
    entry = sub.entry
    doc = {
        "export_version": 1,
        "exported_at": exported_at,
        "root": sub.root,
        "query": {"from": sub.start, "depth": sub.depth, "direction": sub.direction},
        "summary": {
            "node_count": len(nodes),
            "edge_count": len(edges),
            "languages": languages,
            "entry_node": {"id": entry["id"] if entry else "", "path": entry["path"] if entry else "", "exports": list((entry["metadata"] or {}).get("exports") or []) if entry else []},
        },
        "nodes": nodes,
        "edges": edges,
        "dependency_order": order,
    }
    return json.dumps(doc, indent=2, ensure_ascii=False)


def dependency_tree(start: str, nodes: list[dict], edges: list[dict]) -> str:
    """K5: depth first; each node is shown wherever it is met and expanded where first met."""
    paths = {n["id"]: n["path"] for n in reversed(nodes)}
    if start not in paths:
        return ""
    children: dict[str, list[str]] = {}
    for e in edges:
        if e["target"] in paths:
            children.setdefault(e["source"], []).append(e["target"])
    lines, expanded = [paths[start]], {start}
    work = [(0, iter(enumerate(children.get(start, []))), len(children.get(start, [])))]
    while work:
        depth, rest, count = work[-1]
        step = next(rest, None)
        if step is None:
            work.pop()
            continue
        i, child = step
        lines.append("│   " * depth + ("└── " if i == count - 1 else "├── ") + paths[child])
        if child not in expanded:
            expanded.add(child)
            below = children.get(child, [])
            work.append((depth + 1, iter(enumerate(below)), len(below)))
    return "\n".join(lines) + "\n"


def _capital(s: str) -> str:
    return s[:1].upper() + s[1:] if "a" <= s[:1] <= "z" else s


def to_ai_markdown(sub: Subgraph, exported_at: str, title: str = "Context Export") -> str:
    """K4: header, summary, the entry with its tree, all files, all edges."""
    nodes, edges, languages, _ = _subgraph_parts(sub)
    paths = {n["id"]: n["path"] for n in reversed(nodes)}
    names = f" ({', '.join(map(_capital, languages))})" if languages else ""
    out = [f"# {title}", "", f"**Repository:** {sub.root}", f"**Exported:** {exported_at}", f"**Starting node:** {sub.start} (depth {sub.depth}, {sub.direction} directions)", ""]
    out += ["## Architecture Summary", "", f"{len(nodes)} files, {len(edges)} dependencies across {len(languages)} language{'' if len(languages) == 1 else 's'}{names}.", ""]
    if sub.entry:
        ident = sub.entry["id"]
        out += [f"## Entry Node: {sub.entry['path']}", ""]
        lists = (
            ("Exports", list((sub.entry["metadata"] or {}).get("exports") or [])),
            ("Direct dependencies", [paths[e["target"]] for e in edges if e["source"] == ident and e["target"] in paths]),
            ("Direct dependents", [paths[e["source"]] for e in edges if e["target"] == ident and e["source"] in paths]),
        )
        out += [f"- **{name}:** {', '.join(items)}" for name, items in lists if items]
        out += ["", "## Dependency Tree", "", "```", dependency_tree(ident, nodes, edges) + "```", ""]
    out += ["## File Index", "", "| File | Language | Exports |", "|---|---|---|"]
    out += [f"| {n['path']} | {_capital(n['language'])} | {', '.join((n['metadata'] or {}).get('exports') or [])} |" for n in nodes]
    out += ["", "## Dependency Matrix", "", "| From | To | Kind |", "|---|---|---|"]
    out += [f"| {paths.get(e['source'], e['source'])} | {paths.get(e['target'], e['target'])} | {e['kind']} |" for e in edges]
    return "\n".join(out) + "\n"


def _escape(text: str) -> str:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = text.replace(plain, entity)
    return text


_PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title>
<style>body{{margin:0;font:14px sans-serif;background:#11131c;color:#dde}}#info{{position:fixed;left:8px;top:8px}}</style></head>
<body><div id="info">{title}: {nodes} files, {edges} dependencies</div><svg id="g" width="100%" height="100%" viewBox="{box}"></svg>
<script type="application/json" id="data">{data}</script>
<script>
const data = JSON.parse(document.getElementById("data").textContent), svg = document.getElementById("g");
const put = (tag, at, text) => {{ const e = document.createElementNS("http://www.w3.org/2000/svg", tag); for (const k in at) e.setAttribute(k, at[k]); if (text) e.textContent = text; svg.append(e); return e; }};
const by = Object.fromEntries(data.nodes.map(n => [n.id, n]));
for (const [s, t] of data.edges) put("line", {{x1: by[s].x, y1: by[s].y, x2: by[t].x, y2: by[t].y, stroke: "#2a2d3e"}});
for (const n of data.nodes) put("circle", {{cx: n.x, cy: n.y, r: n.size, fill: n.color}}).append(Object.assign(document.createElementNS("http://www.w3.org/2000/svg", "title"), {{textContent: n.path}}));
</script></body></html>
"""


def snapshot_rows(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """K6: nodes with lattice places, sizes and colours; edges between nodes, once per pair of ends."""
    total = graph.nodes.agg(F.count("*").alias("_count"))  # one row
    x, y = scalars.lattice(F.col("ord").cast("double"), F.col("_count").cast("double"))
    nodes = graph.nodes.join(F.broadcast(total)).select("ord", "id", "path", x.alias("x"), y.alias("y"), scalars.snapshot_size(F.col("metadata.exports")).alias("size"), scalars.language_color(F.col("language")).alias("color"))
    ids = graph.nodes.select(F.col("id").alias("source"))
    edges = graph.edges.join(ids, "source", "left_semi").join(ids.withColumnRenamed("source", "target"), "target", "left_semi").select("source", "target").distinct()
    return nodes, edges


def render_snapshot(title: str, nodes: list[dict], edges: list[tuple[str, str]]) -> str:
    data = json.dumps({"nodes": nodes, "edges": edges}, ensure_ascii=False).replace("</", "<\\/")
    reach = max([1.0, *(max(abs(n["x"]), abs(n["y"])) + 12 for n in nodes)])
    return _PAGE.format(title=_escape(title), nodes=len(nodes), edges=len(edges), data=data, box=f"{-reach:.0f} {-reach:.0f} {2 * reach:.0f} {2 * reach:.0f}")


def shown_rows(graph: Graph, positions: DataFrame | None = None, shown: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """K7: the same with places (ord, x, y) and colours (id, shown_color) in force; nodes without either keep their own."""
    nodes, edges = snapshot_rows(graph)
    columns = nodes.columns
    if positions is not None:
        nodes = nodes.join(positions.select("ord", F.col("x").alias("_x"), F.col("y").alias("_y")), "ord", "left").withColumn("x", F.coalesce("_x", "x")).withColumn("y", F.coalesce("_y", "y"))
    if shown is not None:
        nodes = nodes.join(shown.select("id", "shown_color"), "id", "left").withColumn("color", F.coalesce("shown_color", "color"))
    return nodes.select(columns), edges


def to_html(graph: Graph, title: str, positions: DataFrame | None = None, shown: DataFrame | None = None) -> str:
    """K6; K7 with places and colours in force. A page for people: as many nodes as a browser can show."""
    nodes, edges = shown_rows(graph, positions, shown)
    rows = [{k: v if not isinstance(v, float) or math.isfinite(v) else 0.0 for k, v in r.asDict().items() if k != "ord"} for r in nodes.orderBy("ord").toLocalIterator()]
    return render_snapshot(title, rows, [(r["source"], r["target"]) for r in edges.orderBy("source", "target").toLocalIterator()])


def write_text(text: str, path: str | None = None) -> None:
    """K8: to a file, or standard output."""
    if path is None:
        print(text)
        return
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def report(graph: Graph, cycles: bool = False, orphans: bool = False, stats: bool = False) -> list[str]:
    """Lines for a person to read."""
    out = []
    if cycles:
        lines = [r["line"] for r in cycle_ops.cycle_report(graph).orderBy("position").collect()]
        out += [f"cycles: {len(lines) or 'none'}", *[f"  {x}" for x in lines]]
    if orphans:
        rows = orphan_ops.split(orphan_ops.detect_orphans(graph)).orderBy("path").collect()
        dead, entries = ([r["path"] for r in rows if r["status"] == s] for s in ("dead", "entry_point"))
        out += [f"files nobody imports: {len(dead) or 'none'}", *[f"  {p}" for p in dead]]
        out += [f"  {p} (starts something)" for p in entries]
    if stats:
        s = graph_stats(graph).first()
        out.append(f"stats: file_count={s['file_count']} edge_count={s['edge_count']} parse_duration_ms={s['parse_duration_ms']} cache_hits={s['cache_hits']}")
    return out
