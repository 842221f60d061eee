"""Graph operators on hand-made graphs, and against plain Python on random ones."""

import random

import pytest
from codeloom.operators import cycles, directories, layout, orphans, reach, subgraph, view
from codeloom.plans import loops
from codeloom.schema import EDGE_SCHEMA, NODE_SCHEMA, Graph
from pyspark.sql import functions as F


def graph(spark, nodes, edges):
    """nodes: ids, or (id, path, kind, entry); edges: (source, target[, kind[, resolved]])."""
    full = [n if isinstance(n, tuple) else (n, n, "File", False) for n in nodes]
    node_rows = [(i, n, kind, path.split("/")[-1], path, "typescript", None, None, None, ([], entry, [])) for i, (n, path, kind, entry) in enumerate(full)]
    edge_rows = []
    for i, e in enumerate(edges):
        s, t, kind, resolved = (*e, *("Import", True)[len(e) - 2 :])
        edge_rows.append((i, f"{s}→{t}:{kind}", s, t, kind, None, resolved))
    return Graph(spark.createDataFrame(node_rows, NODE_SCHEMA), spark.createDataFrame(edge_rows, EDGE_SCHEMA), {"root": "r"})


def ids(df, column="id"):
    return {r[column] for r in df.collect()}


#: Two services that share a core, one of which goes round through its store.
SERVICES = (["api", "web", "core", "store", "jobs"], [("api", "core"), ("web", "core"), ("core", "store"), ("store", "jobs"), ("jobs", "core")])


def test_reachability(spark):
    g = graph(spark, *SERVICES)
    assert ids(reach.blast_radius(g, "web")) == {"core", "store", "jobs"}
    assert ids(reach.blast_radius(g, "store")) == {"jobs", "core"}
    assert ids(reach.reverse_deps(g, "jobs")) == {"api", "web", "core", "store"}
    assert ids(reach.blast_radius(g, "zz")) == set()
    phantom = graph(spark, ["a"], [("a", "unresolved:x", "Import", False)])
    assert ids(reach.blast_radius(phantom, "a")) == {"unresolved:x"}
    assert ids(reach.blast_radius(phantom, "a", known_only=True)) == set()
    assert ids(reach.reach_indices(g, 3), "ord") == {2, 4}
    assert reach.reach_indices(g, 9).count() == 0


def test_rounds_of_a_walk_leave_the_edges_where_they_are(spark):
    """A hop's join of the frontier with the edges has no exchange above the scan of the edges."""
    pairs = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(50)], "source string, target string")
    with loops.bucketed(pairs, "source") as edges:
        met = edges.join(spark.createDataFrame([("n3",)], "source string").hint("merge"), "source", "left_semi")
        plan = met._jdf.queryExecution().executedPlan().toString()
        edges_side = plan.split("codeloom_")[0].splitlines()[-1]
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in edges_side
        assert met.count() == 1
    assert not spark.catalog.listTables("default") or not any(t.name.startswith("codeloom_") for t in spark.catalog.listTables("default"))


def test_cycles(spark):
    """A ring with a chord, two rings joined one way, a file that imports itself, and a ring with an edge that isn't resolved."""
    ring = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("r2", "r5")]
    joined = [("p0", "p1"), ("p1", "p0"), ("p1", "q0"), ("q0", "q1"), ("q1", "q2"), ("q2", "q0")]
    other = [("me", "me"), ("u0", "u1", "Import", False), ("u1", "u0")]
    nodes = sorted({n for e in ring + joined + other for n in e[:2]})
    g = graph(spark, nodes, ring + joined + other)
    found = cycles.detect_cycles(g, listed=5).orderBy("position").collect()
    assert [(r["cycle_id"], r["size"], r["nodes"]) for r in found] == [("p0", 2, ["p0", "p1"]), ("q0", 3, ["q0", "q1", "q2"]), ("r0", 7, None)]
    assert {(r["cycle_id"], r["id"]) for r in cycles.cycle_members(g).collect()} == {(n[0] + "0", n) for n in nodes if n[0] in "pqr"}
    assert [r["line"] for r in cycles.cycle_report(g, listed=5).orderBy("position").collect()] == ["1. p0 -> p1 -> p0", "2. q0 -> q1 -> q2 -> q0", "3. 7 nodes"]


def test_long_chains_peel_in_few_rounds(spark, monkeypatch):
    n = 100_000
    nodes = spark.range(n).select(F.format_string("c%06d", "id").alias("id"))
    chain = spark.range(n - 1).select(F.format_string("c%06d", "id").alias("source"), F.format_string("c%06d", F.col("id") + 1).alias("target"))
    rounds = []
    plain = loops.saved
    monkeypatch.setattr(loops, "saved", lambda df, name="round": rounds.append(name) or plain(df, name))
    found = subgraph.peel_rounds(nodes, chain)
    assert found.filter(F.col("round") == F.substring("id", 2, 6).cast("long")).count() == n
    assert sum(name in ("paid", "points") for name in rounds) <= 40


@pytest.mark.parametrize("seed", range(2))
def test_contraction_equals_plain_peeling(spark, monkeypatch, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(60)]
    pairs = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(59) if rng.random() < 0.8]
    pairs += [(a, b) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(12)) if a < b or rng.random() < 0.15]
    g = graph(spark, nodes, pairs)
    edges = g.edges.select("source", "target")
    monkeypatch.setattr(subgraph, "PLAIN", 10_000)
    want = {r["id"]: r["round"] for r in subgraph.peel_rounds(g.nodes, edges).collect()}
    for plain in (0, 2):
        monkeypatch.setattr(subgraph, "PLAIN", plain)
        assert {r["id"]: r["round"] for r in subgraph.peel_rounds(g.nodes, edges).collect()} == want


def test_queries_leave_what_their_result_reads(spark):
    """Tables of rounds are gone when a result is there."""
    import os

    root = loops.shared_dir(spark).replace("file:", "")
    base = root
    g = graph(spark, *SERVICES)
    before = set(os.listdir(base))
    for run in (lambda: reach.blast_radius(g, "api"), lambda: cycles.components(g.edges.select("source", "target")), lambda: subgraph.peel_rounds(g.nodes, g.edges.select("source", "target")), lambda: subgraph.bounded_walk(g, "api", 3, "both", 100)):
        df = run()
        left = set(os.listdir(base)) - before
        assert len(left) == 1 and df.count()
        before |= left


def test_cycle_edges_and_report(spark):
    g = graph(spark, list("abc"), [("a", "b"), ("b", "a"), ("b", "c")])
    assert ids(cycles.cycle_edges(g)) == {"a→b:Import", "b→a:Import"}
    assert cycles.cycle_report(g).first()["line"] == "1. a -> b -> a"


def reached(pairs, start):
    """Ids that start reaches, itself apart, in plain Python."""
    seen, queue = {start}, [start]
    for node in queue:
        fresh = {t for s, t in pairs if s == node} - seen
        seen |= fresh
        queue += sorted(fresh)
    return seen - {start}


@pytest.mark.parametrize("seed, edges", [(1, 12), (2, 26), (3, 34)])
def test_loops_against_plain_python(spark, seed, edges):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(20)]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(edges)]
    g = graph(spark, nodes, pairs)
    start = pairs[0][0]
    assert ids(reach.blast_radius(g, start)) == reached(pairs, start)
    assert ids(reach.reverse_deps(g, start)) == reached([(t, s) for s, t in pairs], start)
    to = {n: reached(pairs, n) for n in nodes}
    want = {n: frozenset({n} | {m for m in to[n] if n in to[m]}) for n in nodes}
    found = cycles.components(g.edges.select("source", "target")).collect()
    assert {(r["id"], r["cycle_id"]) for r in found} == {(n, min(c)) for n, c in want.items() if len(c) > 1}
    need = {n: sum(t == n for _, t in pairs) for n in nodes}
    rounds, left, k = {}, set(nodes), 0
    while now := {n for n in left if not need[n]}:
        rounds.update(dict.fromkeys(now, k))
        left -= now
        for s, t in pairs:
            need[t] -= s in now
        k += 1
    assert {r["id"]: r["round"] for r in subgraph.peel_rounds(g.nodes, g.edges.select("source", "target")).collect()} == rounds | dict.fromkeys(left)
    order = [r["id"] for r in subgraph.topological_order(g.nodes, g.edges).orderBy("position").collect()]
    assert order == sorted(nodes, key=lambda n: (rounds.get(n, 10**9), n))


def test_orphans(spark):
    diamond = graph(spark, ["root", "a", "b", "leaf"], [("root", "a"), ("root", "b"), ("a", "leaf"), ("b", "leaf")])
    assert ids(orphans.detect_orphans(diamond)) == {"root"}
    g = graph(spark, [("z", "z.ts", "File", False), ("m", "src/index.ts", "File", True), ("f", "m.ts::fn", "Function", False)], [("m", "f", "Contains"), ("z", "z")])
    assert [r["path"] for r in orphans.detect_orphans(g).collect()] == ["src/index.ts"]
    assert orphans.split(orphans.detect_orphans(g)).first()["status"] == "entry_point"
    unresolved = graph(spark, ["a", "b"], [("a", "b", "Import", False)])
    assert ids(orphans.detect_orphans(unresolved)) == {"a", "b"}
    assert ids(orphans.orphans_any_edge(unresolved)) == {"a"}


def walk(nodes, edges, start, depth, direction, most):
    """The breadth-first queue in plain Python."""
    seen, queue = [start], [(start, 0)]
    for node, d in queue:
        if d >= depth:
            continue
        near = [t for s, t in edges if s == node] if direction != "upstream" else []
        near += [s for s, t in edges if t == node] if direction != "downstream" else []
        for other in near:
            if other not in seen and len(seen) < most:
                seen.append(other)
                queue.append((other, d + 1))
    return seen


def test_bounded_walk_against_queue(spark):
    rng = random.Random(2)
    for direction, most, depth in (("both", 6, 3), ("downstream", 50, 2), ("upstream", 1, 3), ("both", 0, 2), ("both", 9, 0)):
        nodes = [f"n{i}" for i in range(9)]
        edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(14)]
        got = [r["id"] for r in subgraph.bounded_walk(graph(spark, nodes, edges), "n0", depth, direction, most).orderBy("rank").collect()]
        assert got == walk(nodes, edges, "n0", depth, direction, most)


def test_extract_and_find(spark):
    g = graph(spark, [("a", "src/auth/index.ts", "File", True), ("b", "src/b.ts", "File", False), ("c", "c.ts", "File", False)], [("a", "b"), ("b", "c")])
    assert subgraph.find_node(g, "auth/index.ts").first()["id"] == "a"
    assert subgraph.find_node(g, "c.ts").first()["id"] == "c"
    assert subgraph.find_node(g, "nope").first() is None
    assert subgraph.find_node(g, "").first()["id"] == "a"
    found = subgraph.extract(g, "src/b.ts", 1, "both")
    assert ids(found.nodes) == {"a", "b", "c"} and [r["id"] for r in found.order.orderBy("position").collect()] == ["a", "b", "c"]
    missing = subgraph.extract(g, "nope")
    assert missing.entry is None and missing.nodes.count() == 0
    assert [r["path"] for r in subgraph.direct_dependencies(g, "a").collect()] == ["src/b.ts"]
    assert [r["path"] for r in subgraph.direct_dependents(g, "b").collect()] == ["src/auth/index.ts"]


def test_topological_order_with_cycle_and_loop(spark):
    g = graph(spark, list("abcd"), [("c", "c"), ("a", "b"), ("a", "b"), ("c", "d")])
    assert [r["id"] for r in subgraph.topological_order(g.nodes, g.edges).orderBy("position").collect()] == ["a", "b", "c", "d"]


def test_directories(spark):
    g = graph(spark, [("a", "x/a.ts", "File", False), ("b", "x/b.ts", "File", False), ("c", "y/c.ts", "File", False), ("d", "d.ts", "File", False)], [("a", "c"), ("a", "c"), ("b", "c"), ("a", "b"), ("d", "a")])
    assert [(r["directory"], r["files"]) for r in directories.directory_groups(g).collect()] == [("x", 2), ("y", 1), (".", 1)]
    assert {tuple(r) for r in directories.inter_module_edges(g).collect()} == {("x", "y", 2), (".", "x", 1)}
    assert {r["directory"]: r["outgoing"] for r in directories.outgoing(g).collect()} == {"x": 2, "y": 0, ".": 1}


def test_viewer_queries(spark):
    g = graph(spark, [("a", "src/Alpha.ts", "File", False), ("b", "src/b.ts", "File", False)], [("a", "b"), ("a", "b"), ("a", "unresolved:x", "Import", False)])
    assert ids(view.search(g, "ALPHA")) == {"a"} and view.search(g, "").count() == 2 and view.search(g, "", empty_matches=False).count() == 0
    assert [(r["source_index"], r["target_index"]) for r in view.edge_indices(g).orderBy("edge").collect()] == [(0, 1), (0, 1), (0, 0)]
    assert view.simple(g).edges.count() == 1
    assert ids(view.neighbours(g, "b")) == {"a"}
    functions = spark.createDataFrame([("a::f", "f", "function", "src/Alpha.ts", 3, ["b", "nope"]), ("a::f", "f", "function", "src/Alpha.ts", 3, [])], "id string, name string, kind string, file_path string, lines int, calls array<string>")
    more = view.expand(g, functions, "a")
    assert more.nodes.count() == 3 and {(r["source"], r["target"], r["kind"]) for r in more.edges.filter("ord > 2").collect()} == {("a", "a::f", "Contains"), ("a::f", "b", "Call")}
    less = view.collapse(more, functions)
    assert less.nodes.count() == 2 and less.edges.count() == 3


def test_visible_nodes_samples_like_a_counter(spark):
    nodes = [(f"n{i}", f"n{i}.ts", "File", i % 97 == 0) for i in range(1300)]
    g = graph(spark, nodes, [])
    places = g.nodes.select("ord", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    got = [r["ord"] for r in view.visible_nodes(g.nodes, places, [0, 0, 1, 1, 0.01]).orderBy("place").collect()]
    entries = [i for i in range(1300) if i % 97 == 0]
    room = 500 - len(entries)
    step = max(1, 1300 // room)
    want = entries + [i for i in range(1300) if i % step == 0 and i % 97][:room]
    assert got == want
    assert view.visible_nodes(g.nodes, places, [0, 0]).count() == 1300
    assert view.visible_nodes(g.nodes, places, [5, 5, 1, 1, 1]).count() == 0


def test_highlight(spark):
    g = graph(spark, ["a", "b"], [])
    marked = g.nodes.withColumn("color", F.lit("#111111")).withColumn("s", F.col("id") == "a").withColumn("old", F.col("id") == "b")
    rows = {r["id"]: (r["shown_color"], r["dimmed"]) for r in view.highlight(marked, {"selected": "s", "search": "old"}, deprecated="old").collect()}
    assert rows == {"a": (view.SELECTED, False), "b": (view.DEPRECATED_DIM, True)}


def test_layouts(spark):
    g = graph(spark, ["root", "a", "b", "leaf", "x", "y"], [("root", "a"), ("root", "b"), ("a", "leaf"), ("b", "leaf"), ("x", "y"), ("y", "x")])
    got = {r["id"]: (r["layer"], r["x"], r["y"]) for r in layout.layered(g).collect()}
    assert {k: v[0] for k, v in got.items()} == {"root": 0, "a": 1, "b": 1, "leaf": 2, "x": 3, "y": 3}
    assert got["a"][1] == -50.0 and got["b"][1] == 50.0 and got["leaf"][2] == 300.0
    crossed = graph(spark, ["p", "q", "s", "t"], [("p", "t"), ("q", "s")])
    places = {r["id"]: r["x"] for r in layout.layered(crossed, sweeps=1).collect()}
    assert places["t"] < places["s"]
    rows = {r["id"]: (r["x"], r["y"]) for r in layout.directory_rows(g.nodes).collect()}
    assert rows["root"] == (-300.0, 0.0)
