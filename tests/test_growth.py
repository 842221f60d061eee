"""What queries cost as tables grow: rows that move, tasks that share the work."""

from codeloom.functions import export
from codeloom.operators.build import ordered
from codeloom.plans import derived
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().toString()


def test_ordered_moves_rows_once(spark):
    """rows are numbered as they are written, without a window over them; ranges of any size."""
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("v"))
    out = ordered(df, "k")
    assert "row_number" not in plan(out)
    assert out.filter("k <> ord").count() == 0 and out.count() == 5000 and out.columns == ["k", "v", "ord"]
    assert ordered(df.limit(0), "k").count() == 0


def test_json_document_is_read_without_moving_rows(spark, sf_dir, tmp_path):
    """elements of a document of several blocks are numbered where they are parsed; the parts are gone."""
    g = derived.fk(spark, sf_dir, keep_order=True)
    export.write_json(g, str(tmp_path / "g.json"))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["g.json"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        again = export.read_json(spark, str(tmp_path / "g.json"))
        for own, read in ((g.nodes, again.nodes), (g.edges, again.edges)):
            assert "row_number" not in plan(read)
            assert sorted(own.select("ord", "id").collect()) == sorted(read.select("ord", "id").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parsing_is_shared_by_tasks_and_done_once(spark, sf_dir):
    """A table of one row group is parsed by several tasks; resolving reads the parses from a table."""
    from codeloom.operators import resolve
    from codeloom.plans import source_queries
    from codeloom.sources import files

    made = source_queries.sources(spark, sf_dir).coalesce(1)
    parsed = files.parse_files(made)
    assert parsed.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert parsed.count() == made.count()
    assert "MapInPandas" not in plan(resolve.resolve_asts(parsed))


def test_edges_are_moved_slim(spark):
    """Joins on ends move eight bytes an end and no id that follows from them; odd ids come back as they were."""
    from codeloom.operators import slim, view

    a, b, odd = "0123456789abcdef", "fedcba9876543210", ["", "01234567", "0123456789ABCDEF", "0123456789abcdef\n", "é", "x" * 40, "\x00" * 9]
    rows = [(a, b, "Import", f"{a}→{b}:Import"), (a, "unresolved:os", "Import", f"{a}→os:Import"), (a, b, "Import", "other"), (b, a, "Import", None)]
    rows += [(o, a, "Call", f"{o}→{a}:Call") for o in odd]
    edges = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "source string, target string, kind string, id string, ord long")
    moved = slim.slim(edges)
    assert slim.whole(moved).select(edges.columns).collect() == edges.collect()
    assert [r["id"] for r in moved.orderBy("ord").collect()] == [None, None, "other", *[None] * (len(odd) + 1)]
    assert moved.select("source").distinct().count() == 2 + len(odd) and moved.filter(F.length("target") == 8).count() == len(rows) - 1
    lit = spark.createDataFrame([(x,) for x in (a, b, "\x00" * 9)], "id string")
    shown = view.visible_edges(edges, lit=lit)
    assert shown.columns == edges.columns and sorted(r["ord"] for r in shown.collect()) == [0, 2, 3, 10]
    assert "unhex" in plan(shown)


def test_buckets_stay_small(spark, monkeypatch):
    """however few partitions are set, a bucket holds no more rows than one task sorts; repeated edges change no rounds."""
    from codeloom.operators import subgraph
    from codeloom.plans import loops

    monkeypatch.setattr(loops, "BUCKET_MOST", 50)
    with loops.bucketed(spark.range(1000).select(F.col("id").alias("k")), "k"):
        (name,) = [x.name for x in spark.catalog.listTables() if x.name.startswith("codeloom_")]
        assert spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").first()["data_type"] == "20"
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("a", "c"), ("a", "gone")], "source string, target string")
    for plain in (subgraph.PLAIN, 1):
        monkeypatch.setattr(subgraph, "PLAIN", plain)
        assert {r["id"]: r["round"] for r in subgraph.peel_rounds(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2}


def test_layers_join_edges_once(spark, monkeypatch):
    """where no cycle blocks a node, layers come from the rounds alone, and edges out of the graph don't matter to the layout."""
    from codeloom.operators import layout
    from codeloom.schema import Graph

    monkeypatch.setattr(layout, "_inner_pairs", lambda graph: 1 / 0)
    nodes = spark.createDataFrame([("a", 0), ("0123456789abcdef", 1), ("c", 2)], "id string, ord long")
    edges = spark.createDataFrame([("a", "0123456789abcdef"), ("a", "c"), ("c", "gone"), ("c", "c")], "source string, target string")
    got = {r["id"]: (r["ord"], r["layer"], r["x"], r["y"]) for r in layout.layered(Graph(nodes, edges.filter("source <> target"), {}), 1).collect()}
    assert got == {"a": (0, 0, 0.0, 0.0), "0123456789abcdef": (1, 1, -50.0, 150.0), "c": (2, 1, 50.0, 150.0)}


def test_store_keeps_few_files_and_moves_rows_once(spark, tmp_path, monkeypatch):
    """files of a store follow from its size, not from the number of its buckets; a change rewrites its buckets alone; stores laid out otherwise are built anew."""
    import json

    from codeloom.operators.build import build
    from codeloom.operators.resolve import resolve_asts
    from codeloom.plans import fs
    from codeloom.sources import files
    from codeloom.streaming import maintained

    monkeypatch.setattr(maintained, "GROUP", 50)
    made = [(f"d/m{i:03}.ts", "typescript", f"import './m{(i + 1) % 200:03}';\nexport function f{i}() {{}}\n".encode()) for i in range(200)]
    parsed = files.parse_files(spark.createDataFrame(made, "path string, language string, content binary"))
    parsed = parsed.withColumns({"size": F.lit(0).cast("long"), "mtime": F.lit(0).cast("long")})
    store = maintained.Maintained(str(tmp_path / "store"), bucket=2)
    store.full(parsed)

    def parts(version):
        return {t: len(list((tmp_path / "store" / t / f"version={version}").rglob("*.parquet"))) for t in maintained.TABLES}

    def same():
        want, got = build(resolve_asts(parsed), "function"), store.current(spark)
        for a, b in ((want.nodes, got.nodes), (want.edges, got.edges)):
            assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))

    before = store._state(spark)
    assert len(before["buckets"]) >= 100 and all(3 <= n <= 4 for n in parts(1).values())
    same()
    two = parsed.filter(F.col("path").isin("d/m007.ts", "d/m150.ts"))
    store.apply(two, spark.createDataFrame([], "path string"))
    after = store._state(spark)
    assert sum(a != b for a, b in zip(before["buckets"], after["buckets"], strict=True)) == 2 and all(n <= 2 for n in parts(2).values())
    assert {t: len({b for name, b in store.read if name == t}) for t in ("nodes", "edges")} == {"nodes": 2, "edges": 2}
    same()
    fs.write_text(spark, str(tmp_path / "store/v2"), json.dumps({k: v for k, v in after.items() if k != "layout"}))
    assert store.current(spark) is None
    store.apply(parsed, spark.createDataFrame([], "path string"))
    assert store.version == 3
    same()


def test_cycles_are_found_by_numbers(spark, sf_dir, monkeypatch):
    """lineitem is sorted once for a graph's nodes and edges; rounds know nodes by numbers, and odd ids come back as they were."""
    from codeloom.operators import cycles

    g = derived.seq(spark, sf_dir)
    assert "Window" not in plan(g.nodes) and "Window" not in plan(g.edges)
    plain, types = cycles._colors, []
    monkeypatch.setattr(cycles, "_colors", lambda pairs: types.append(dict(pairs.dtypes)) or plain(pairs))
    a, b, odd = "0123456789abcdef", "fedcba9876543210", "0123456789ABCDEF"
    rows = [(a, b), (b, odd), (odd, a), (a, a), (a, b), ("", "é"), ("é", ""), ("x", "x"), ("", "x"), (a, None)]
    got = cycles.components(spark.createDataFrame(rows, "source string, target string")).collect()
    assert types and all(t == {"source": "bigint", "target": "bigint"} for t in types)
    assert {r["id"]: r["cycle_id"] for r in got} == {a: odd, b: odd, odd: odd, "": "", "é": ""} and len(got) == 5


def test_layout_steps_move_no_edges(spark, monkeypatch):
    """Round 4, F1: a layout knows nodes by numbers, and a step reads edges from buckets of the ends that it joins on."""
    from codeloom.operators import layout
    from codeloom.schema import Graph

    plain, seen = layout.ordered, []
    monkeypatch.setattr(layout, "ordered", lambda df, *by: seen.append((by, dict(df.dtypes)["id"], plan(df))) or plain(df, *by))
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate(["a", "0123456789abcdef", "c", "", "é", "x", "y"])], "id string, ord long")
    edges = [("a", "c"), ("a", "c"), ("0123456789abcdef", ""), ("", "é"), ("c", "é"), ("x", "y"), ("y", "x"), ("é", "gone"), ("gone", "a"), ("a", "a"), ("a", None)]
    got = {r["id"]: (r["ord"], r["layer"], r["x"]) for r in layout.layered(Graph(nodes, spark.createDataFrame(edges, "source string, target string"), {}), 2).collect()}
    assert got == {"a": (0, 0, -50.0), "0123456789abcdef": (1, 0, 50.0), "c": (2, 1, -50.0), "": (3, 1, 50.0), "é": (4, 2, 0.0), "x": (5, 3, -50.0), "y": (6, 3, 50.0)}
    steps = [(kind, text) for by, kind, text in seen if by == ("_key", "place")]
    assert len(steps) == 6 and all(kind == "bigint" and "SelectedBucketsCount" in text for kind, text in steps)
    none = Graph(nodes.limit(0), spark.createDataFrame(edges, "source string, target string"), {})
    assert layout.layered(none).count() == 0 and layout.layered(none).columns == ["id", "ord", "layer", "x", "y"]


def test_json_document_stays_in_compressed_parts(spark, sf_dir, tmp_path):
    """Round 4, F2: compressed parts are one document in gzip's format, a fraction of its size, and are read part by part; lines are parsed once."""
    import gzip
    import json

    g = derived.fk(spark, sf_dir, keep_order=True)
    for graph, name in ((g, "g"), (type(g)(g.nodes.limit(0), g.edges.limit(0), {"root": "é"}), "none")):
        export.write_json(graph, str(tmp_path / f"{name}.json"))
        export.write_json(graph, str(tmp_path / name), compressed=True)
        packed = b"".join(p.read_bytes() for p in sorted(tmp_path.glob(f"{name}/**/*")) if p.is_file() and p.name[0] in "0123456789p")
        assert gzip.decompress(packed).decode() == (tmp_path / f"{name}.json").read_text()
        again = export.read_json(spark, str(tmp_path / name))
        assert json.loads(export.to_json(again)) == json.loads((tmp_path / f"{name}.json").read_text())
        assert again.edges.columns == graph.edges.columns and again.header["root"] == graph.header["root"]
        for own, read in ((graph.nodes, again.nodes), (graph.edges, again.edges)):
            assert sorted(own.select("ord", "id").collect()) == sorted(read.select("ord", "id").collect())
        if name == "g":
            assert len(packed) < (tmp_path / "g.json").stat().st_size / 5 and len(list(tmp_path.glob("g/3-edges/part-*"))) == 4


def test_simple_graph_sorts_edges_once(spark, sf_dir, monkeypatch):
    """Round 4, F3: edges stream past hashed nodes, in as many tasks as their number asks for, and are sorted only where the first is picked."""
    from codeloom.operators import view
    from codeloom.plans import loops
    from codeloom.schema import Graph

    monkeypatch.setattr(loops, "BUCKET_MOST", 2)
    a, b = "0123456789abcdef", "fedcba9876543210"
    nodes = spark.createDataFrame([(a,), (b,), (b,), ("",)], "id string")
    rows = [(a, b, "ReExport"), (a, b, "Import"), (a, "unresolved:os", "Import"), ("gone", a, "Import"), (b, a, "Import"), ("", "", "Call"), (a, None, "Import"), (a, b, "Import")]
    edges = spark.createDataFrame([(i, f"{s}→{t}:{k}", s, t, k) for i, (s, t, k) in enumerate(rows)], "ord long, id string, source string, target string, kind string")
    for by, most, tasks, want in ((("ord",), None, 4, {(a, b): 0, (b, a): 4, ("", ""): 5}), (("kind", "ord"), 18, 9, {(a, b): 1, (b, a): 4, ("", ""): 5})):
        made = view.simple(Graph(nodes, edges, {}), by, most).edges
        assert {(r["source"], r["target"]): r["ord"] for r in made.collect()} == want and made.columns == edges.columns
        text = plan(made)
        assert text.count("ShuffledHashJoin") >= 2 and "SortMergeJoin" not in text and "LeftSemi" not in text and f", {tasks}), REPARTITION_BY_NUM" in text
    assert derived.fk_most(spark, sf_dir) >= derived.fk(spark, sf_dir).edges.count()
