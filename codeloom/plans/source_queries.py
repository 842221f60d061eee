"""Registered queries of the main path: source texts made from a table are parsed, resolved and built, with SQL.

Each part is a file in one of five languages, with an import of the part 80 places on
(in the same directory and language; unresolved where there is none), an import of a
library, a function and a class.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import export, scalars
from codeloom.operators import build, cycles, resolve, rules, search, subgraph, view, viewport
from codeloom.plans import derived, fs, loops
from codeloom.plans.queries import _SCC, FK, ORACLE_SQL, SEQ, _id, query
from codeloom.schema import Graph
from codeloom.sources import files, store
from codeloom.streaming import maintained

#: Per language: extension, file name's first letter, text (k: own key, t: the other's, b: directory).
_TEXTS = {
    "typescript": ("ts", "m", "import {{ f{t} }} from './m{t}';\nimport _ from 'lodash';\nexport function f{k}(a) {{\n  return f{t}(a);\n}}\nexport class C{k} {{\n}}\n"),
    "python": ("py", "m", "import os\nfrom .m{t} import f{t}\n\nclass C{k}:\n    pass\n\ndef f{k}(a):\n    return a\n"),
    "rust": ("rs", "m", "use std::fmt;\nmod m{t};\npub struct C{k} {{}}\npub fn f{k}(a: i32) -> i32 {{\n    a\n}}\n"),
    "go": ("go", "m", 'package p\n\nimport (\n\t"fmt"\n\t"./m{t}"\n)\n\ntype C{k} struct {{\n}}\n\nfunc F{k}(a int) int {{\n\treturn a\n}}\n'),
    "java": ("java", "M", "package src.b{b};\n\nimport java.util.List;\nimport src.b{b}.M{t};\n\npublic class C{k} {{\n    public int f{k}(int a) {{\n        return a;\n    }}\n}}\n"),
}
#: Per language: library and its place, specifier of the other and its place, lines of both, of the function and its end, of the class.
_FACTS = {
    "typescript": ("lodash", 1, "'./m' || t", 0, 1, 0, 2, 4, 5),
    "python": ("os", 0, "'.m' || t", 1, 0, 1, 6, 7, 3),
    "rust": ("std::fmt", 0, "'./m' || t", 1, 0, 1, 3, 5, 2),
    "go": ("fmt", 0, "'./m' || t", 1, 3, 4, 10, 12, 7),
    "java": ("java.util.List", 0, "'src.b' || b || '.M' || t", 1, 2, 3, 6, 8, 5),
}


def sources(spark, sf: str) -> DataFrame:
    """path, language, content of every part's file."""
    part = derived._table(spark, sf, "part")
    k = F.col("p_partkey")
    values = {"k": k.cast("string"), "t": (k + 80).cast("string"), "b": (k % 16).cast("string")}

    def text(template: str) -> Column:
        pieces, at = [], 0
        plain = template.replace("{{", "\x01").replace("}}", "\x02")
        while (start := plain.find("{", at)) >= 0:
            pieces += [F.lit(plain[at:start].replace("\x01", "{").replace("\x02", "}")), values[plain[start + 1]]]
            at = start + 3
        return F.concat(*pieces, F.lit(plain[at:].replace("\x01", "{").replace("\x02", "}")))

    path = content = language = F.lit(None).cast("string")
    for i, (name, (extension, letter, template)) in enumerate(_TEXTS.items()):
        mine = k % 5 == i
        path = F.when(mine, F.concat(F.lit("src/b"), values["b"], F.lit(f"/{letter}"), values["k"], F.lit(f".{extension}"))).otherwise(path)
        content = F.when(mine, text(template)).otherwise(content)
        language = F.when(mine, name).otherwise(language)
    return part.select(path.alias("path"), language.alias("language"), content.cast("binary").alias("content"))


def asts(spark, sf: str) -> DataFrame:
    return resolve.resolve_asts(files.parse_files(sources(spark, sf)))


def built(spark, sf: str, level: str = "function") -> Graph:
    return build.build(asts(spark, sf), level)


def _by_language(value) -> str:
    return "CASE k % 5 " + " ".join(f"WHEN {i} THEN {value(name)}" for i, name in enumerate(_TEXTS)) + " END"


_PATH = _by_language(lambda n: f"'src/b' || b || '/{_TEXTS[n][1]}' || k || '.{_TEXTS[n][0]}'")
_OTHER = _by_language(lambda n: f"'src/b' || b || '/{_TEXTS[n][1]}' || t || '.{_TEXTS[n][0]}'")


def _fact(i: int) -> str:
    return _by_language(lambda n: _FACTS[n][i] if isinstance(_FACTS[n][i], int) or i == 2 else f"'{_FACTS[n][i]}'")


_SOURCES = (
    "p AS (SELECT p_partkey AS k, p_partkey + 80 AS t, p_partkey % 16 AS b FROM part), "
    f"s AS (SELECT k, t, b, {_PATH} AS path, {_OTHER} AS other, {_by_language(lambda n: chr(39) + n + chr(39))} AS language, t IN (SELECT k FROM p) AS known, CASE WHEN k % 5 = 3 THEN 'F' ELSE 'f' END || k AS fn, 'C' || k AS cl FROM p), "
    f"i AS (SELECT path, {_fact(1)} AS position, {_fact(0)} AS specifier, {_fact(4)} AS line, CAST(NULL AS VARCHAR) AS resolved_path FROM s "
    f"UNION ALL SELECT path, {_fact(3)}, {_fact(2)}, {_fact(5)}, CASE WHEN known THEN other END FROM s)"
)
_NODES = (
    f"{_SOURCES}, u AS (SELECT path, 0 AS g, substr(sha256(path), 1, 16) AS id, 'File' AS kind, split_part(path, '/', -1) AS label, language, CAST(NULL AS INTEGER) AS line FROM s "
    f"UNION ALL SELECT path, 1, substr(sha256(path || '::fn::' || fn), 1, 16), 'Function', fn, language, {_fact(6)} FROM s "
    f"UNION ALL SELECT path, 2, substr(sha256(path || '::class::' || cl), 1, 16), 'Class', cl, language, {_fact(8)} FROM s), "
    "n AS (SELECT CAST(row_number() OVER (ORDER BY path, g) - 1 AS BIGINT) AS ord, * FROM u)"
)
_FILE_EDGES = "SELECT path, 0 AS g, position AS i, substr(sha256(path), 1, 16) AS source, substr(sha256(resolved_path), 1, 16) AS target, specifier, 'Import' AS kind FROM i"
_EDGES = (
    f"{_NODES}, v AS ({_FILE_EDGES} UNION ALL SELECT path, g, 0, substr(sha256(path), 1, 16), id, NULL, 'Contains' FROM n WHERE g > 0), "
    "e AS (SELECT CAST(row_number() OVER (ORDER BY path, g, i) - 1 AS BIGINT) AS ord, source || '→' || coalesce(target, specifier) || ':' || kind AS id, source, coalesce(target, 'unresolved:' || specifier) AS target, kind, target IS NOT NULL AS resolved FROM v)"
)
_FILE_GRAPH = f"{_SOURCES}, v AS ({_FILE_EDGES}), e AS (SELECT source || '→' || coalesce(target, specifier) || ':' || kind AS id, source, target FROM v), n AS (SELECT substr(sha256(path), 1, 16) AS id, language FROM s)"


@query("parsed_imports", f"WITH {_SOURCES} SELECT path, position, specifier, line, 'static' AS kind FROM i")
def parsed_imports(spark, sf):
    return files.parse_files(sources(spark, sf)).select("path", F.posexplode("imports").alias("position", "_i")).select("path", "position", "_i.specifier", "_i.line", "_i.kind")


@query("parsed_declarations", f"WITH {_NODES} SELECT path, kind, label AS name, line AS line_start FROM n WHERE kind <> 'File'")
def parsed_declarations(spark, sf):
    parsed = files.parse_files(sources(spark, sf))
    each = [parsed.select("path", F.lit(kind).alias("kind"), F.explode(column).alias("_d")).select("path", "kind", "_d.name", "_d.line_start") for kind, column in (("Function", "functions"), ("Class", "classes"))]
    return each[0].unionByName(each[1])


@query("parsed_body_spans", f"WITH {_SOURCES} SELECT path, fn AS name, {_fact(6)} AS line_start, {_fact(7)} AS line_end FROM s")
def parsed_body_spans(spark, sf):
    parsed = files.parse_files(sources(spark, sf), body_spans=True)
    return parsed.select("path", F.explode("functions").alias("_d")).select("path", "_d.name", "_d.line_start", "_d.line_end")


@query("parsed_content_hash", f"WITH {_SOURCES} SELECT path, language FROM s")
def parsed_content_hash(spark, sf):
    """Files whose hash is that of their content: all of them."""
    made = sources(spark, sf)
    same = files.parse_files(made).join(made.select("path", F.sha2("content", 256).alias("content_hash")), ["path", "content_hash"], "left_semi")
    return same.select("path", "language")


@query("narrow_scan", f"WITH {_SOURCES} SELECT path, CAST(2 AS INTEGER) AS imports, CAST(0 AS INTEGER) AS others FROM s")
def narrow_scan(spark, sf):
    kept = files.compatible(files.parse_files(sources(spark, sf)))
    return kept.select("path", F.size("imports").alias("imports"), (F.size("exports") + F.size("functions") + F.size("classes")).alias("others"))


@query("resolved_imports", f"WITH {_SOURCES} SELECT path, specifier, resolved_path FROM i")
def resolved_imports(spark, sf):
    return asts(spark, sf).select("path", F.explode("imports").alias("_i")).select("path", "_i.specifier", "_i.resolved_path")


@query("built_nodes", f"WITH {_NODES} SELECT ord, id, kind, label, path, language, line AS line_start, line AS line_end, CASE WHEN line IS NOT NULL THEN 1 END AS loc FROM n")
def built_nodes(spark, sf):
    return built(spark, sf).nodes.select("ord", "id", "kind", "label", "path", "language", "line_start", "line_end", "loc")


@query("built_edges", f"WITH {_EDGES} SELECT ord, id, source, target, kind, resolved FROM e")
def built_edges(spark, sf):
    return built(spark, sf).edges.select("ord", "id", "source", "target", "kind", "resolved")


@query("built_exports", f"WITH {_SOURCES} SELECT path, CASE WHEN k % 5 = 0 THEN fn || ',' || cl ELSE '' END AS exports, false AS is_entry_point FROM s")
def built_exports(spark, sf):
    return built(spark, sf, "file").nodes.select("path", F.array_join("metadata.exports", ",").alias("exports"), "metadata.is_entry_point")


@query("built_stats", f"WITH {_EDGES} SELECT count(*) FILTER (kind = 'File') AS file_count, count(*) FILTER (kind <> 'File') AS function_count, (SELECT count(*) FROM e) AS edge_count, CAST(7 AS BIGINT) AS parse_duration_ms, CAST(3 AS BIGINT) AS cache_hits FROM n")
def built_stats(spark, sf):
    return build.stats(build.build(asts(spark, sf), "function", cache_hits=3, parse_ms=7))


@query("manual_graph_stats", f"WITH {FK} SELECT (SELECT count(*) FROM n) AS file_count, CAST(0 AS BIGINT) AS function_count, (SELECT count(*) FROM e) AS edge_count, CAST(0 AS BIGINT) AS parse_duration_ms, CAST(0 AS BIGINT) AS cache_hits")
def manual_graph_stats(spark, sf):
    g = derived.fk(spark, sf)
    return build.stats(build.manual(g.nodes, g.edges, "made"))


@query("functions_by_file", f"WITH {_NODES} SELECT path AS file_path, substr(sha256(path), 1, 16) || '::' || label AS id, label AS name, label || CASE WHEN kind = 'Function' THEN '()' ELSE '' END AS signature, lower(kind) AS kind, 1 AS lines FROM n WHERE kind <> 'File'")
def functions_by_file(spark, sf):
    return build.functions_by_file(files.parse_files(sources(spark, sf))).select("file_path", "id", "name", "signature", "kind", "lines")


_ONE = "src/b1/m1.py"


@query("expanded_file", f"WITH {_FILE_GRAPH} SELECT 'node' AS part, id FROM n UNION ALL SELECT 'edge', id FROM e UNION ALL SELECT 'node', '{_id(_ONE)}::' || c FROM (VALUES ('f1'), ('C1')) x(c) UNION ALL SELECT 'edge', '{_id(_ONE)}→{_id(_ONE)}::' || c || ':Contains' FROM (VALUES ('f1'), ('C1')) x(c)")
def expanded_file(spark, sf):
    parsed = loops.saved(asts(spark, sf), "asts")
    inside = build.functions_by_file(parsed).filter(F.col("file_path") == _ONE)
    g = view.expand(build.build(parsed), inside, _id(_ONE))
    return g.nodes.select(F.lit("node").alias("part"), "id").unionByName(g.edges.select(F.lit("edge").alias("part"), "id"))


@query("collapsed_language", f"WITH {_FILE_GRAPH} SELECT 'node' AS part, id FROM n WHERE language <> 'python' UNION ALL SELECT 'edge', id FROM e WHERE source NOT IN (SELECT id FROM n WHERE language = 'python')")
def collapsed_language(spark, sf):
    g = built(spark, sf, "file")
    g = view.collapse(g, g.nodes.filter(F.col("language") == "python"))
    return g.nodes.select(F.lit("node").alias("part"), "id").unionByName(g.edges.select(F.lit("edge").alias("part"), "id"))


@query("lod_visible_middle", f"WITH {_NODES} SELECT ord, CAST(row_number() OVER (ORDER BY ord) AS BIGINT) AS place FROM n WHERE kind <> 'Function' AND ord % 100 BETWEEN 10 AND 90")
def lod_visible_middle(spark, sf):
    nodes = built(spark, sf).nodes
    places = nodes.select("ord", (F.col("ord") % 100).cast("float").alias("x"), F.floor(F.col("ord") / 100).cast("float").alias("y"))
    return view.visible_nodes(nodes, places, [10.0, 0.0, 80.0, 1e6, 0.3]).withColumn("place", F.col("place").cast("long"))


@query("json_round_trip", "SELECT 'node' AS part, CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS ord, path AS name FROM (SELECT 'region/' || r_regionkey || '/index.ts' AS path FROM region UNION ALL SELECT 'nation/' || (n_nationkey % 16) || '/' || n_nationkey || '.java' FROM nation) UNION ALL SELECT 'edge', CAST(n_nationkey AS BIGINT), substr(sha256('region/' || n_regionkey || '/index.ts'), 1, 16) FROM nation")
def json_round_trip(spark, sf):
    """A graph of regions and nations, as one JSON document and back."""
    region, nation = derived._table(spark, sf, "region"), derived._table(spark, sf, "nation")
    paths = region.select(derived._path("region", F.col("r_regionkey")).alias("path")).unionByName(nation.select(derived._path("nation", F.col("n_nationkey")).alias("path")))
    imports = nation.select(F.col("n_nationkey").cast("long").alias("ord"), derived._path("nation", F.col("n_nationkey")).alias("from_path"), derived._path("region", F.col("n_regionkey")).alias("to_path"))
    source, target = scalars.node_id(F.col("from_path")), scalars.node_id(F.col("to_path"))
    edges = imports.select("ord", scalars.edge_id(source, target, F.lit("Import")).alias("id"), source.alias("source"), target.alias("target"), F.lit("Import").alias("kind"), F.lit(None).cast("string").alias("symbol"), F.lit(True).alias("resolved"))
    text = export.to_json(Graph(derived._nodes(paths), edges, {"root": "r", "scanned_at": "2024-01-01T00:00:00Z"}))
    again = store.graph_from_json(spark.createDataFrame([(text,)], "value string"))
    return again.nodes.select(F.lit("node").alias("part"), "ord", F.col("path").alias("name")).unionByName(again.edges.select(F.lit("edge").alias("part"), "ord", F.col("target").alias("name")))


@query("graph_json_lines", f"WITH {FK} SELECT CAST(0 AS INTEGER) AS part, ord, id FROM n UNION ALL SELECT 1, ord, id FROM e")
def graph_json_lines(spark, sf):
    lines = export.json_lines(derived.fk(spark, sf, keep_order=True))
    return lines.select("part", "ord", F.get_json_object("line", "$.id").alias("id"))


@query("annotation_remove", "SELECT s_name AS path, 't' || s_nationkey AS team FROM supplier WHERE s_name <> (SELECT min(s_name) FROM supplier)")
def annotation_remove(spark, sf):
    s, text = derived._table(spark, sf, "supplier"), F.lit(None).cast("string")
    notes = s.select(F.col("s_name").alias("path"), F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("team"), text.alias("domain"), text.alias("status"), F.array().cast("array<string>").alias("tags"))
    first = s.agg(F.min("s_name")).first()[0]
    return store.remove_annotation(notes, first)[0].select("path", "team")


def _rust(name: str, spec: str, target: str):
    """A file of a crate imports a nation's module by a path from itself; every other nation's is known."""

    def run(spark, sf):
        n, c = derived._table(spark, sf, "nation"), derived._table(spark, sf, "customer")
        known = n.filter(F.col("n_nationkey") % 2 == 0).select(F.format_string(target, "n_nationkey").alias("path"))
        imports = c.select(F.lit("app/src/graph/f.rs").alias("path"), F.lit("rust").alias("language"), F.col("c_custkey").alias("position"), F.format_string(spec, "c_nationkey").alias("specifier"), F.lit(None).cast("string").alias("resolved_path"))
        return resolve.resolve_imports(imports, known).select("position", "resolved_path")

    before, after = target.split("%d")
    query(name, f"SELECT c_custkey AS position, CASE WHEN c_nationkey % 2 = 0 THEN '{before}' || c_nationkey || '{after}' END AS resolved_path FROM customer")(run)


_rust("resolve_rust_super", "super::pkg::n%d::Thing", "app/src/pkg/n%d.rs")
_rust("resolve_rust_self", "self::n%d", "app/src/graph/n%d/mod.rs")
_rust("resolve_rust_module", "./n%d", "app/src/graph/n%d.rs")

_COLORS = "CASE language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scalars.LANGUAGE_COLORS.items()) + f" ELSE '{scalars.DEFAULT_COLOR}' END"


def _lighter(color: str, factor: float) -> str:
    return "#" + "".join(f"{int(v + (255 - v) * factor + 0.5):02x}" for v in (int(color[i : i + 2], 16) for i in (1, 3, 5)))


_LIGHTER = "CASE language " + " ".join(f"WHEN '{k}' THEN '{_lighter(v, 0.3)}'" for k, v in scalars.LANGUAGE_COLORS.items()) + f" ELSE '{_lighter(scalars.DEFAULT_COLOR, 0.3)}' END"


@query("node_colors", f"WITH {FK} SELECT id, {_COLORS} AS color, {_LIGHTER} AS lighter FROM n")
def node_colors(spark, sf):
    color = scalars.language_color(F.col("language"))
    return derived.fk(spark, sf).nodes.select("id", color.alias("color"), scalars.lighten(color, 0.3).alias("lighter"))


@query("edge_colors", f"WITH {FK} SELECT id, CASE kind {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in scalars.EDGE_COLORS.items())} END AS color FROM e")
def edge_colors(spark, sf):
    return derived.fk(spark, sf).edges.select("id", scalars.edge_color(F.col("kind")).alias("color"))


@query("relative_paths", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'src/' || p_partkey ELSE '/other/src/' || p_partkey END AS path FROM part")
def relative_paths(spark, sf):
    k = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/home/me/src/"), k)).otherwise(F.concat(F.lit("/other/src/"), k))
    return derived._table(spark, sf, "part").select("p_partkey", scalars.relative_path(path, "/home/me/").alias("path"))


@query("ring_places", "SELECT p_partkey, round(10 + 80 * cos(p_partkey / 40.0 * 2 * pi() - pi() / 2), 6) + 0 AS x, round(20 + 80 * sin(p_partkey / 40.0 * 2 * pi() - pi() / 2), 6) + 0 AS y, CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 7 END AS size FROM part")
def ring_places(spark, sf):
    k = F.col("p_partkey")
    x, y = scalars.ring(k.cast("double"), F.lit(40.0), F.lit(10.0), F.lit(20.0))
    kind = F.when(k % 2 == 0, "Class").otherwise("Function")
    return derived._table(spark, sf, "part").select("p_partkey", (F.round(x, 6) + 0).alias("x"), (F.round(y, 6) + 0).alias("y"), scalars.child_size(kind).alias("size"))


_HERE = "nation/3/3.java"


@query("highlight_selected", f"WITH {FK}, d AS (SELECT target AS id FROM e WHERE source = '{_id(_HERE)}'), u AS (SELECT source AS id FROM e WHERE target = '{_id(_HERE)}') SELECT id, CASE WHEN id = '{_id(_HERE)}' THEN '{view.SELECTED}' WHEN id IN (FROM d) THEN '{view.DEPENDENCY}' WHEN id IN (FROM u) THEN '{view.DEPENDENT}' ELSE '{view.DIM}' END AS shown_color, NOT (id = '{_id(_HERE)}' OR id IN (FROM d) OR id IN (FROM u)) AS dimmed FROM n")
def highlight_selected(spark, sf):
    g = derived.fk(spark, sf)
    down = g.edges.filter(F.col("source") == _id(_HERE)).select(F.col("target").alias("id"), F.lit(True).alias("dep")).distinct()
    up = g.edges.filter(F.col("target") == _id(_HERE)).select(F.col("source").alias("id"), F.lit(True).alias("dependent")).distinct()
    marked = g.nodes.join(down, "id", "left").join(up, "id", "left").withColumn("here", F.col("id") == _id(_HERE)).withColumn("color", scalars.language_color(F.col("language")))
    return view.highlight(marked, {"selected": "here", "dep": "dep", "dependent": "dependent"}).select("id", "shown_color", "dimmed")


@query("highlight_search", f"WITH {FK} SELECT id, CASE WHEN contains(lower(path), 'r/1') THEN {_COLORS} ELSE '{view.DIM}' END AS shown_color, NOT contains(lower(path), 'r/1') AS dimmed FROM n")
def highlight_search(spark, sf):
    nodes = derived.fk(spark, sf).nodes
    marked = nodes.withColumn("found", scalars.matches(F.col("label"), F.col("path"), "R/1")).withColumn("color", scalars.language_color(F.col("language")))
    return view.highlight(marked, {"search": "found"}).select("id", "shown_color", "dimmed")


@query("highlight_directory", f"WITH {FK} SELECT id, CASE WHEN path LIKE 'orders/1/%' THEN '{view.DIRECTORY}' ELSE '{view.DIM}' END AS shown_color, path NOT LIKE 'orders/1/%' AS dimmed FROM n")
def highlight_directory(spark, sf):
    nodes = derived.fk(spark, sf).nodes
    marked = nodes.withColumn("inside", scalars.parent_dir(F.col("path")) == "orders/1").withColumn("color", scalars.language_color(F.col("language")))
    return view.highlight(marked, {"directory": "inside"}).select("id", "shown_color", "dimmed")


@query("highlight_cycles", f"WITH RECURSIVE {SEQ}, {_SCC} SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN '{view.CYCLE}' ELSE '{view.DIM}' END AS shown_color, id NOT IN (SELECT id FROM c) AS dimmed FROM n")
def highlight_cycles(spark, sf):
    g = derived.seq(spark, sf)
    members = cycles.components(g.edges.select("source", "target")).select("id", F.lit(True).alias("cyclic"))
    marked = g.nodes.join(members, "id", "left").withColumn("color", scalars.language_color(F.col("language")))
    return view.highlight(marked, {"cycle": "cyclic"}).select("id", "shown_color", "dimmed")


@query("visible_edges_cycle", f"WITH RECURSIVE {SEQ}, {_SCC} SELECT e.id FROM e JOIN c ON c.id = e.source JOIN c d ON d.id = e.target AND d.cycle_id = c.cycle_id WHERE e.source <> e.target")
def visible_edges_cycle(spark, sf):
    g = derived.seq(spark, sf)
    return view.visible_edges(g.edges, cycle=cycles.cycle_edges(g)).select("id")


_CYCLIC_ROUNDS = (
    f"{SEQ}, {_SCC}, b AS (SELECT id FROM c UNION SELECT r.b FROM c JOIN r ON r.a = c.id), "
    "w AS (SELECT id, 0 AS k FROM n WHERE id NOT IN (SELECT id FROM b) UNION SELECT e.target, w.k + 1 FROM w JOIN e ON e.source = w.id WHERE e.target NOT IN (SELECT id FROM b)), "
    "x AS (SELECT id, max(k) AS k FROM w GROUP BY id)"
)


@query("topo_rounds_cyclic", f"WITH RECURSIVE {_CYCLIC_ROUNDS} SELECT n.id, CAST(x.k AS BIGINT) AS round FROM n LEFT JOIN x ON x.id = n.id")
def topo_rounds_cyclic(spark, sf):
    g = derived.seq(spark, sf)
    return subgraph.peel_rounds(g.nodes, g.edges.select("source", "target"))


@query("topo_order_cyclic", f"WITH RECURSIVE {_CYCLIC_ROUNDS} SELECT n.id, row_number() OVER (ORDER BY x.k NULLS LAST, n.ord) AS position FROM n LEFT JOIN x ON x.id = n.id")
def topo_order_cyclic(spark, sf):
    g = derived.seq(spark, sf, keep_order=True)
    return subgraph.topological_order(g.nodes, g.edges).withColumn("position", F.col("position").cast("long"))


# ---- graphs that are kept up to date


def _files(spark, sf: str) -> DataFrame:
    """Parsed files as a store takes them."""
    now = F.lit(0).cast("long")
    return files.parse_files(sources(spark, sf)).withColumn("size", now).withColumn("mtime", now)


def _maintained(spark, sf: str) -> maintained.Maintained:
    """A store of the sources that came to be by changes: at first some files lack, some are others, some are too many."""
    kept = maintained.Maintained(f"{loops.shared_dir(spark)}/store-{uuid.uuid4().hex}", bucket=500)
    whole = loops.saved(_files(spark, sf), "whole")
    number = F.regexp_extract("path", "([0-9]+)[.][a-z]+$", 1).cast("long")
    older = F.when(number % 11 == 0, F.array().cast(whole.schema["imports"].dataType)).otherwise(F.col("imports"))
    more = whole.filter(number % 13 == 0).withColumn("path", F.concat(F.lit("old/"), "path"))
    kept.full(whole.filter(number % 7 != 0).withColumn("imports", older).withColumn("content_hash", F.sha2(F.concat("content_hash", F.to_json("imports")), 256)).unionByName(more))
    kept.apply(whole.filter((number % 7 == 0) | (number % 11 == 0)), more.select("path"))
    return kept


@query("maintained_nodes", ORACLE_SQL["built_nodes"])
def maintained_nodes(spark, sf):
    return _maintained(spark, sf).current(spark).nodes.select("ord", "id", "kind", "label", "path", "language", "line_start", "line_end", "loc")


@query("maintained_edges", ORACLE_SQL["built_edges"])
def maintained_edges(spark, sf):
    return _maintained(spark, sf).current(spark).edges.select("ord", "id", "source", "target", "kind", "resolved")


@query("cache_reads", f"WITH {_SOURCES} SELECT path, CASE WHEN k % 3 = 0 THEN 2 END AS imports, CASE WHEN k % 3 = 0 THEN 1 END AS functions FROM s")
def cache_reads(spark, sf):
    """Parses of every third file are put into a cache by slots, and all files are looked up."""
    kept = maintained.Maintained(f"{loops.shared_dir(spark)}/store-{uuid.uuid4().hex}")
    whole = loops.saved(_files(spark, sf), "whole")
    kept.full(whole.filter(F.regexp_extract("path", "([0-9]+)[.][a-z]+$", 1).cast("long") % 3 == 0))
    hits = kept.cached(whole.select("content_hash", "language")).select("content_hash", "language", F.size("imports").alias("imports"), F.size("functions").alias("functions"))
    return whole.select("path", "content_hash", "language").join(hits, ["content_hash", "language"], "left").select("path", "imports", "functions")


@query("cycle_members", f"WITH RECURSIVE {SEQ}, {_SCC} SELECT cycle_id, id FROM c")
def cycle_members(spark, sf):
    return cycles.cycle_members(derived.seq(spark, sf))


@query("dependency_violations", f"""WITH {FK}, r AS (SELECT 'nation' || n_nationkey AS rule, 'customer/' || (n_nationkey % 16) || '/' AS a, 'nation/' || (n_nationkey % 16) || '/' AS b FROM nation UNION ALL SELECT 'any', 'orders/', 'part/3/')
SELECT r.rule, e.id FROM e JOIN n s ON s.id = e.source JOIN n t ON t.id = e.target JOIN r ON starts_with(s.path, r.a) AND starts_with(t.path, r.b) WHERE r.rule <> 'any' OR s.path LIKE '%7.py'""")
def dependency_violations(spark, sf):
    """Customers of a directory must not import nations of the same; orders whose key ends in 7 no parts of directory 3."""
    k = (F.col("n_nationkey") % 16).cast("string")
    made = derived._table(spark, sf, "nation").select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("rule"), F.concat(F.lit("customer/"), k, F.lit("/**")).alias("source_glob"), F.concat(F.lit("nation/"), k, F.lit("/*")).alias("target_glob"))
    made = made.unionByName(spark.createDataFrame([("any", "orders/**/*7.py", "part/3/*.rs")], "rule string, source_glob string, target_glob string"))
    return rules.violations(derived.fk(spark, sf), made).select("rule", "id")


@query("json_document", f"WITH {FK} SELECT CAST(0 AS INTEGER) AS part, ord, id FROM n UNION ALL SELECT 1, ord, id FROM e")
def json_document(spark, sf):
    """A graph written as one document by tasks, in compressed parts, and read again."""
    path = f"{loops.shared_dir(spark)}/graph-{uuid.uuid4().hex}.json"
    with loops.scope():
        export.write_json(derived.fk(spark, sf, keep_order=True), path, compressed=True)
    again = export.read_json(spark, path)
    fs.delete(spark, path)  # the rows are in tables
    return again.nodes.select(F.lit(0).alias("part"), "ord", "id").unionByName(again.edges.select(F.lit(1).alias("part"), "ord", "id"))


def _index(spark, sf: str) -> search.SearchIndex:
    made = search.SearchIndex(f"{loops.shared_dir(spark)}/index-{uuid.uuid4().hex}")
    made.write(derived.fk(spark, sf, keep_order=True))
    return made


@query("search_indexed", ORACLE_SQL["search_nodes"])
def search_indexed(spark, sf):
    return _index(spark, sf).search(spark, "R/1").select("id", "path")


@query("find_indexed", ORACLE_SQL["find_node"])
def find_indexed(spark, sf):
    return _index(spark, sf).find(spark, "/7.ts").select("id", "path")


@query("snapshot_as_shown", f"WITH {FK} SELECT id, CAST(ord % 100 AS DOUBLE) AS x, CAST(ord // 100 AS DOUBLE) AS y, CASE WHEN contains(lower(path), 'r/1') THEN {_COLORS} ELSE '{view.DIM}' END AS color FROM n")
def snapshot_as_shown(spark, sf):
    """A snapshot's nodes at places of their own, in the colours of a search."""
    g = derived.fk(spark, sf, keep_order=True)
    places = g.nodes.select("ord", (F.col("ord") % 100).cast("double").alias("x"), F.floor(F.col("ord") / 100).cast("double").alias("y"))
    marked = g.nodes.withColumn("found", scalars.matches(F.col("label"), F.col("path"), "R/1")).withColumn("color", scalars.language_color(F.col("language")))
    return export.shown_rows(g, places, view.highlight(marked, {"search": "found"}))[0].select("id", "x", "y", "color")


def _place_index(spark, sf: str) -> viewport.PlaceIndex:
    """The nodes of fk at the places that the unindexed queries give them."""
    made = viewport.PlaceIndex(f"{loops.shared_dir(spark)}/places-{uuid.uuid4().hex}")
    nodes = derived.fk(spark, sf, keep_order=True).nodes
    made.write(nodes, nodes.select("ord", (F.col("ord") % 100).cast("float").alias("x"), F.floor(F.col("ord") / 100).cast("float").alias("y")), block=4096)
    return made


@query("lod_indexed_near", ORACLE_SQL["lod_visible_near"])
def lod_indexed_near(spark, sf):
    return _place_index(spark, sf).visible(spark, [10.0, 0.0, 80.0, 1e6, 0.7]).withColumn("place", F.col("place").cast("long"))


@query("lod_indexed_far", ORACLE_SQL["lod_visible_far"])
def lod_indexed_far(spark, sf):
    return _place_index(spark, sf).visible(spark, [10.0, 0.0, 80.0, 1e6, 0.05]).withColumn("place", F.col("place").cast("long"))
