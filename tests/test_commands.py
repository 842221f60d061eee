"""Commands, dependency rules, documents of any size."""

import json

from codeloom import api
from codeloom.functions import export
from codeloom.operators import rules
from codeloom.operators.build import build
from codeloom.operators.resolve import resolve_asts
from codeloom.sources import files
from pyspark.sql import functions as F


def made(tmp_path):
    root = tmp_path / "src"
    (root / "ui").mkdir(parents=True)
    (root / "db").mkdir()
    (root / "ui/page.ts").write_text("import '../db/store';\nimport './part';\nexport function show() {}\nexport class Page {}\n")
    (root / "ui/part.ts").write_text("import './page';\n")
    (root / "db/store.ts").write_text("import 'lib';\n")
    (root / "index.ts").write_text("import './ui/page';\n")
    return root


def test_commands(spark, tmp_path, capsys):
    root, out = made(tmp_path), tmp_path / "out"
    assert api.main(["scan", str(root), "--output", str(out), "--cycles", "--orphans", "--stats"]) == 0
    graph = json.loads(out.read_text())
    assert len(graph["nodes"]) == 4 and len(graph["edges"]) == 5 and graph["version"] == 1
    said = capsys.readouterr().err
    assert "cycles: 1" in said and "page.ts -> " in said and "index.ts" in said and "edge_count=5" in said
    assert api.main(["scan", str(root), "--output", str(out), "--format", "dot", "--level", "function"]) == 0 and out.read_text().startswith("digraph")
    assert api.main(["export", str(root), "--from", "ui/page.ts", "--output", str(out)]) == 0 and "ui/page.ts" in out.read_text()
    assert api.main(["export", str(root), "--from", "ui/page.ts", "--format", "json", "--depth", "1", "--direction", "downstream", "--output", str(out)]) == 0
    assert {n["path"] for n in json.loads(out.read_text())["nodes"] if n["kind"] == "File"} == {"ui/page.ts", "db/store.ts", "ui/part.ts"}
    assert api.main(["functions", str(root), "--file", "ui/page.ts", "--output", str(out)]) == 0
    assert [(f["name"], f["kind"]) for f in json.loads(out.read_text())] == [("Page", "class"), ("show", "function")]
    assert api.main(["functions", str(root), "--file", "no.ts", "--output", str(out)]) == 0 and json.loads(out.read_text()) == []
    assert api.main(["snapshot", str(root), "--title", "<T>", "--output", str(out)]) == 0 and "&lt;T&gt;" in out.read_text()
    assert api.main(["view", str(root), "--output", str(out)]) == 0 and "<html" in out.read_text().lower()
    assert api.main(["annotate", str(root), "--file", "ui/page.ts", "--team", "web", "--tag", "a"]) == 0
    assert api.main(["annotate", str(root), "--list"]) == 0 and "team=web" in capsys.readouterr().out
    assert api.main(["annotate", str(root), "--file", "ui/page.ts", "--remove"]) == 0 and "removed" in capsys.readouterr().out


def test_rules(spark, tmp_path):
    root = made(tmp_path)
    graph = build(resolve_asts(files.scan(spark, str(root)).drop("content_hash", "hit")))
    wanted = spark.createDataFrame([("layers", "ui/**", "db/*.ts"), ("no-loops", "**/p?rt.ts", "ui/page.ts"), ("top", "*.ts", "ui/*"), ("none", "db/**", "ui/**")], "rule string, source_glob string, target_glob string")
    found = rules.violations(graph, wanted)
    assert {(r["rule"], r["source_path"], r["target_path"]) for r in found.collect()} == {("layers", "ui/page.ts", "db/store.ts"), ("no-loops", "ui/part.ts", "ui/page.ts"), ("top", "index.ts", "ui/page.ts")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert [rules.stem(g) for g in ("a/b/*.ts", "**/x", "a/b.ts", "*.ts", "a/*/c/d")] == ["a/b", "", "a", "", "a"]


def test_one_document_by_tasks(spark, tmp_path):
    root = made(tmp_path)
    graph = build(resolve_asts(files.scan(spark, str(root)).drop("content_hash", "hit")), "function")
    for g in (graph, type(graph)(graph.nodes.limit(0), graph.edges.limit(0), graph.header)):
        export.write_json(g, str(tmp_path / "g.json"))
        doc = json.loads((tmp_path / "g.json").read_text())
        assert doc == json.loads(export.to_json(g))
        again = export.read_json(spark, str(tmp_path / "g.json"))
        for a, b in ((g.nodes, again.nodes), (g.edges, again.edges)):
            assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    big = spark.range(20_000).select(F.col("id").alias("ord"), *[F.col("id").cast("string").alias(c) for c in ("id", "kind", "label", "path", "language")], *[F.lit(None).cast("int").alias(c) for c in ("line_start", "line_end", "loc")], F.lit(None).cast(graph.nodes.schema["metadata"].dataType).alias("metadata"))
    export.write_json(type(graph)(big, graph.edges, {}), str(tmp_path / "big.json"))
    assert [n["id"] for n in json.loads((tmp_path / "big.json").read_text())["nodes"]] == [str(i) for i in range(20_000)]
