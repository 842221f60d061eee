"""Parsing, scanning, resolving, building, storing and exporting."""

import json
import os

import pytest
from codeloom.functions import export, scalars
from codeloom.operators import build, resolve, subgraph
from codeloom.schema import AST_SCHEMA
from codeloom.sources import files, lexers, store
from pyspark.sql import functions as F

TS = """import fs, { readFile } from 'fs';
// import x from './no'
import type { T } from "../types";
import './side';
export { a } from './again';
export async function load(p: string) { return import("./lazy"); }
export const VERSION = "1", text = "import y from './no'";
const arrow = async (a: number, b = (1)) => a;
export class Service { method() {} }
function load2() {}
export default load2;
"""
PY = '''import os, sys
import numpy as np
from pathlib import Path
from . import utils
from ..config import x
"""
import no
"""
async def main():
    def inner(): pass

class Scanner:
    def run(self): pass
'''
RS = """use std::{fs, io};
use crate::graph::types::Node;
mod utils;
mod inline { fn deep() {} }
pub struct S; enum E { A } trait T {}
impl S { pub fn new() -> S { S } }
pub async fn parse() {}
// fn no() {}
"""
GO = """package main
import (
\t"fmt"
\tm "math/rand"
)
import "fmt"
type P struct { A int }
func Greet(n string) string { return "func no(" }
func (p *P) hide() {}
"""
JAVA = """package a.b;
import java.util.List;
import java.util.List;
import java.io.*;
public class Simple {
  public Simple(int a) { x(); }
  @Override public List<String> names(int n) throws Exception { return null; }
  private static int count() { return new Foo(1).bar(); }
}
interface I { void go(); }
"""


def names(items, key="name"):
    return [i[key] for i in items]


def test_typescript():
    r = lexers.parse("typescript", TS)
    assert [(i["specifier"], i["kind"], i["line"]) for i in r["imports"]] == [("fs", "static", 0), ("../types", "static", 2), ("./side", "static", 3), ("./lazy", "dynamic", 5)]
    assert [(e["symbol"], e["kind"]) for e in r["exports"]] == [("./again", "star"), ("load", "named"), ("VERSION", "named"), ("Service", "named")]
    assert names(r["functions"]) == ["load", "arrow", "load2"] and r["functions"][0]["is_async"] and r["functions"][0]["line_start"] == r["functions"][0]["line_end"] == 5
    assert names(r["classes"]) == ["Service"]


def test_python():
    r = lexers.parse("python", PY)
    assert names(r["imports"], "specifier") == ["os", "sys", "pathlib", ".", "..config"]
    assert names(r["functions"]) == ["main", "inner", "run"] and names(r["classes"]) == ["Scanner"] and r["exports"] == []
    assert lexers.parse("python", PY, body_spans=True)["functions"][0]["line_end"] == 9


def test_rust():
    r = lexers.parse("rust", RS)
    assert names(r["imports"], "specifier") == ["std::{fs, io}", "crate::graph::types::Node", "./utils", "./inline"]
    assert names(r["functions"]) == ["deep", "new", "parse"] and names(r["classes"]) == ["S", "E", "T"]


def test_go():
    r = lexers.parse("go", GO)
    assert names(r["imports"], "specifier") == ["fmt", "math/rand"]
    assert [(f["name"], f["is_exported"]) for f in r["functions"]] == [("Greet", True), ("hide", False)] and names(r["classes"]) == ["P"]


def test_java():
    r = lexers.parse("java", JAVA)
    assert names(r["imports"], "specifier") == ["java.util.List", "java.io"]
    assert names(r["functions"]) == ["names", "count", "go"] and names(r["classes"]) == ["Simple", "I"]


@pytest.mark.parametrize("language", ["typescript", "python", "rust", "go", "java", "cobol", None])
def test_empty_and_odd(language):
    empty = {k: [] for k in lexers.EMPTY}
    assert lexers.parse(language, "") == empty and lexers.parse(language, None) == empty
    lexers.parse(language, "﻿'\"`\\{{{(\r\n" * 50)


RESOLVE = [
    ("typescript", "src/a.ts", "./components", ["src/components/index.ts"], "src/components/index.ts"),
    ("typescript", "src/a.ts", "./b", ["src/b.jsx", "src/b.ts"], "src/b.ts"),
    ("typescript", "src/a.ts", "../x.js", ["x.js"], "x.js"),
    ("typescript", "src/a.ts", "react", ["react.ts"], None),
    ("python", "pkg/sub/a.py", "..utils", ["pkg/utils.py"], "pkg/utils.py"),
    ("python", "pkg/a.py", ".", ["pkg/__init__.py", "pkg/utils.py"], "pkg/__init__.py"),
    ("python", "pkg/a.py", ".x.y", ["pkg/x/y/__init__.py"], "pkg/x/y/__init__.py"),
    ("python", "pkg/a.py", "os/path", ["os/path.py"], None),
    ("rust", "c/src/lib.rs", "./m", ["c/src/m/mod.rs"], "c/src/m/mod.rs"),
    ("rust", "c/src/graph/t.rs", "crate::scanner::FileAst", ["c/src/lib.rs", "c/src/scanner/mod.rs"], "c/src/scanner/mod.rs"),
    ("rust", "c/src/graph/t.rs", "super::x::{A, B}", ["c/src/x.rs"], "c/src/x.rs"),
    ("rust", "c/src/graph/t.rs", "self::y", ["c/src/graph/y.rs"], "c/src/graph/y.rs"),
    ("rust", "c/src/graph/t.rs", "std::fs", ["std.rs"], None),
    ("go", "a/m.go", "./util", ["a/util.go"], "a/util.go"),
    ("go", "a/m.go", "fmt", ["fmt.go"], None),
    ("java", "A.java", "com.ex.B", ["com/ex/B.java"], "com/ex/B.java"),
    ("java", "A.java", "com.ex.*", ["com/ex.java"], None),
]


def test_resolution(spark):
    rows = [(f"{i}/{path}", lang, i, spec, None) for i, (lang, path, spec, _, _) in enumerate(RESOLVE)]
    rows.append(("9999/x.ts", "typescript", 9999, "./b", "kept.ts"))
    known = [(f"{i}/{k}" if lang != "java" else k,) for i, (lang, _, _, ks, _) in enumerate(RESOLVE) for k in ks]
    imports = spark.createDataFrame(rows, "path string, language string, position int, specifier string, resolved_path string")
    got = {r["position"]: r["resolved_path"] for r in resolve.resolve_imports(imports, spark.createDataFrame(known, "path string")).collect()}
    for i, (lang, _, _, _, want) in enumerate(RESOLVE):
        assert got[i] == (want if want is None or lang == "java" else f"{i}/{want}"), RESOLVE[i]
    assert got[9999] == "kept.ts"


@pytest.fixture
def tree(tmp_path):
    for path, text in {
        "src/index.ts": "import { a } from './a';\nimport { a } from './a';\nimport r from 'react';\n",
        "src/a.ts": "export function a() {}\nexport class K {}\nfunction a() {}\n",
        "src/deep/er/b.py": "import os\n",
        "pkg/__init__.py": "",
        "build/out.js": "x\n",
        ".hidden/h.ts": "x\n",
        "README.md": "no\n",
        ".gitignore": "/build/\n*.gen.ts\n!keep.gen.ts\n",
        "x.gen.ts": "",
        "keep.gen.ts": "",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return str(tmp_path)


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


def test_scan_filters(spark, tree):
    assert paths(files.list_files(spark, tree)) == ["keep.gen.ts", "pkg/__init__.py", "src/a.ts", "src/deep/er/b.py", "src/index.ts"]
    assert paths(files.list_files(spark, tree, files.ScanOptions(include=("python",)))) == ["pkg/__init__.py", "src/deep/er/b.py"]
    assert paths(files.list_files(spark, tree, files.ScanOptions(exclude=("deep", "*.gen.ts")))) == ["pkg/__init__.py", "src/a.ts", "src/index.ts"]
    assert paths(files.list_files(spark, tree, files.ScanOptions(depth=2))) == ["keep.gen.ts", "pkg/__init__.py", "src/a.ts", "src/index.ts"]
    assert ".hidden/h.ts" in paths(files.list_files(spark, tree, files.ScanOptions(hidden=True)))


def test_build_store_export(spark, tree, tmp_path):
    asts = files.scan(spark, tree).filter(F.col("path").startswith("src/"))
    g = build.build(resolve.resolve_asts(asts.drop("content_hash", "hit")), "function", "repo", scanned_at="2024-01-01T00:00:00Z")
    nodes = {r["path"] + "#" + r["label"]: r for r in g.nodes.collect()}
    assert sorted(nodes) == ["src/a.ts#K", "src/a.ts#a", "src/a.ts#a.ts", "src/deep/er/b.py#b.py", "src/index.ts#index.ts"]
    assert nodes["src/a.ts#a"]["loc"] == 1 and nodes["src/index.ts#index.ts"]["metadata"]["is_entry_point"]
    assert [r["ord"] for r in g.nodes.orderBy("ord").collect()] == list(range(5))
    edges = g.edges.orderBy("ord").collect()
    assert [(e["kind"], e["resolved"]) for e in edges] == [("Contains", True)] * 3 + [("Import", False), ("Import", True), ("Import", True), ("Import", False)]
    assert edges[-1]["target"] == "unresolved:react" and edges[4]["id"] == edges[5]["id"]
    assert build.stats(g).first()["function_count"] == 2
    store.save_graph(g, str(tmp_path / "g"))
    again = store.load_graph(spark, str(tmp_path / "g"))
    assert again.nodes.count() == 5 and again.header["root"] == "repo" and store.load_graph(spark, str(tmp_path / "none")) is None
    doc = json.loads(export.to_json(g))
    assert doc["version"] == 1 and len(doc["edges"]) == 7 and json.loads(export.to_json(g, pretty=True)) == doc
    back = store.graph_from_json(spark.createDataFrame([(export.to_json(g),)], "value string"))
    assert [tuple(r) for r in back.nodes.orderBy("ord").collect()] == [tuple(r) for r in g.nodes.orderBy("ord").collect()]
    dot = export.to_dot(g)
    assert dot.startswith("digraph") and dot.endswith("}") and dot.count("->") == 7
    sub = subgraph.extract(g, "src/index.ts", 1, "downstream")
    text = export.to_ai_markdown(sub, "now")
    assert "## Entry Node: src/index.ts" in text and "- **Direct dependencies:** src/a.ts, src/a.ts" in text and "| src/index.ts | unresolved:react | Import |" in text
    assert json.loads(export.to_ai_json(sub, "now"))["summary"]["entry_node"]["path"] == "src/index.ts"
    html = export.to_html(g, "<T>")
    assert "&lt;T&gt;" in html and html.count('"path"') == 5
    said = export.report(g, True, True, True)
    assert any(line.startswith("files nobody imports:") for line in said) and any("edge_count=" in line for line in said)


def test_cache_parses_only_what_changed(spark, tree, tmp_path):
    first = files.scan(spark, tree)
    path = str(tmp_path / "cache")
    cache = store.upsert(spark, path, store.cache_rows(first, 1), ["content_hash", "language"])
    assert store.hit_count(files.scan(spark, tree, cache=cache)).first()[0] == first.count()
    with open(os.path.join(tree, "src/a.ts"), "a") as f:
        f.write("export const z = () => 1;\n")
    second = files.scan(spark, tree, cache=cache)
    assert paths(second.filter("not hit")) == ["src/a.ts"]
    spans = files.ScanOptions(body_spans=True)
    assert store.hit_count(files.scan(spark, tree, spans, cache=cache)).first()[0] == 0
    both = store.upsert(spark, path, store.cache_rows(files.scan(spark, tree, spans), 2, True), store.CACHE_KEY)
    assert store.hit_count(files.scan(spark, tree, spans, cache=both)).first()[0] == first.count()


def test_tree_shows_repeats_once_expanded():
    nodes = [{"id": i, "path": i + ".ts"} for i in "abc"]
    edges = [{"source": s, "target": t} for s, t in ("ab", "ac", "bc", "cb")]
    assert export.dependency_tree("a", nodes, edges) == "a.ts\n├── b.ts\n│   └── c.ts\n│   │   └── b.ts\n└── c.ts\n"


def test_annotations(spark, tmp_path):
    path = str(tmp_path / "x/a.yaml")
    notes = store.load_annotations(spark, path)
    assert notes.count() == 0
    notes = store.set_annotation(notes, "b.ts", team="core", tags=["x", "y"])
    notes = store.set_annotation(notes, "a.ts", status="deprecated")
    notes = store.set_annotation(notes, "b.ts", domain="d")
    store.save_annotations(notes, path)
    read = store.load_annotations(spark, path)
    assert [tuple(r) for r in store.list_annotations(read).collect()] == [("a.ts", "status=deprecated"), ("b.ts", "team=core  domain=d  tags=x,y")]
    left, there = store.remove_annotation(read, "a.ts")
    assert there and left.count() == 1 and not store.remove_annotation(left, "a.ts")[1]
    with pytest.raises(ValueError):
        store.set_annotation(notes, "a.ts")


def test_scalars(spark):
    df = spark.createDataFrame([("a/./b/../../../c.d.ts", "'q'", "éa")], "p string, q string, s string")
    r = df.select(scalars.normalize_path(F.col("p")).alias("n"), scalars.extension(F.col("p")).alias("e"), scalars.strip_quotes(F.col("q")).alias("q"), scalars.capitalize(F.col("s")).alias("c"), scalars.lighten(F.lit("#000000"), 0.5).alias("l"), scalars.directory(F.lit("x")).alias("d"), scalars.join_path(F.lit(""), F.lit("n")).alias("j"), scalars.detect_language(F.lit(".ts")).alias("h")).first()
    assert tuple(r) == ("c.d.ts", "ts", "q", "éa", "#808080", ".", "n", None)


def test_graph_from_ast_rows(spark):
    rows = [("m/main.py", "python", [("x", None, "reexport", ["s"], 0)], [("E", "named", 1)], [], [])] * 2
    g = build.build(spark.createDataFrame(rows, AST_SCHEMA))
    node = g.nodes.first()
    assert g.nodes.count() == 1 and node["metadata"]["exports"] == ["E"] and node["metadata"]["is_entry_point"]
    assert [(e["kind"], e["symbol"]) for e in g.edges.collect()] == [("ReExport", "s")] * 2
