"""Indexed search equals a scan, and row groups are passed over."""

import glob
import random

import pyarrow.parquet as pq
from codeloom.operators import subgraph, view
from codeloom.operators.search import SearchIndex
from codeloom.schema import EDGE_SCHEMA, NODE_SCHEMA, Graph


def test_index_equals_scan(spark, tmp_path):
    rng = random.Random(8)
    parts = ["src", "Lib", "öl", "auth", "x", "İstanbul", "views", "日本", "a"]
    rows = []
    for i in range(3000):
        path = "/".join(rng.choices(parts, k=rng.randrange(1, 4))) + f"/{rng.choice(parts)}{i % 700}.ts"
        rows.append((i, f"n{i}", "File", rng.choice([path.split("/")[-1], "run", "Öl"]), path, "typescript", None, None, None, None))
    g = Graph(spark.createDataFrame(rows, NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA), {})
    index = SearchIndex(str(tmp_path / "index"))
    index.write(g, row_group=20_000)
    for q in ("", "a", "ÖL", "auth/x", "views12", "istanbul", "日本", "src/lib/ÖL/", "run", "none at all", "X1.TS"):
        assert sorted(r["ord"] for r in index.search(spark, q).collect()) == sorted(r["ord"] for r in view.search(g, q).collect()), q
    for wanted in ("x12.ts", "run", "", rows[77][4], "/a5.ts", "zzz", "öl", "t"):
        assert [r["ord"] for r in index.find(spark, wanted).collect()] == [r["ord"] for r in subgraph.find_node(g, wanted).collect()], wanted
    plan = index.candidates(spark, "auth/x")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "In(gram" in plan
    files = [pq.ParquetFile(f).metadata for f in glob.glob(str(tmp_path / "index/suffixes/*.parquet"))]
    groups = [(m.row_group(k).column(m.schema.names.index("reversed")).statistics) for m in files for k in range(m.num_row_groups)]
    low, high = "st.21x/", "st.21x0"
    assert len(groups) >= 4 and sum(s.min <= high and s.max >= low for s in groups) <= 2
