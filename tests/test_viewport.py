"""Indexed samples of a viewport equal those from all places; a box reads a part of the tables."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from codeloom.operators import view, viewport
from codeloom.schema import NODE_SCHEMA

KINDS = ["File", "File", "Function", "Class"]


def table(spark, n, entries, seed=3):
    rng = random.Random(seed)
    meta = lambda e: ([], e, [])
    rows = [(i, f"n{i}", rng.choice(KINDS), f"l{i}", f"p{i}", "typescript", None, None, None, meta(rng.random() < entries) if i % 97 else None) for i in range(n)]
    return spark.createDataFrame(rows, NODE_SCHEMA)


def places(spark, n, seed=4):
    """Clusters, one crowded place, ends of the plane, nodes without a place."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.choice([(rng.gauss(0, 50), rng.gauss(0, 50)), (rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)), (250.0, 250.0)])
        rows.append((i, x, y) if i % 50 else (i, None if i % 100 else float("nan"), y))
    return spark.createDataFrame([*rows[:-2], (n - 2, float("inf"), 5.0), (n - 1, -1000.0, float("-inf"))], "ord long, x double, y double")


def got(df):
    return sorted((r["place"], r["ord"]) for r in df.collect())


def test_index_equals_all_places(spark, tmp_path):
    n = 6000
    nodes, at = table(spark, n, 0.01).cache(), places(spark, n).cache()
    index = viewport.PlaceIndex(str(tmp_path / "index"))
    index.write(nodes, at, block=128, row_group=20_000)
    inf = float("inf")
    for box in ([-2000.0, -2000.0, 4000.0, 4000.0], [-100.0, -100.0, 200.0, 200.0], [-700.0, -900.0, 1500.0, 1700.0], [250.0, 250.0, 0.0, 0.0], [3000.0, 0.0, 5.0, 5.0], [0.0, 0.0, -1.0, 5.0], [-1e300, -1e9, 2e300, 2e9], [0.0, 0.0, inf, inf]):
        for zoom in (0.05, 0.3, 0.7) if box[2] == 4000.0 else (0.05,):
            assert got(index.visible(spark, [*box, zoom])) == got(view.visible_nodes(nodes, at, [*box, zoom])), (box, zoom)


@pytest.mark.parametrize("entries", [0.2, 1.0])
def test_many_entry_points(spark, tmp_path, entries):
    nodes, at = table(spark, 1500, entries).cache(), places(spark, 1500).cache()
    index = viewport.PlaceIndex(str(tmp_path / "index"))
    index.write(nodes, at, block=64)
    far = [-2000.0, -2000.0, 4000.0, 4000.0, 0.01]
    assert got(index.visible(spark, far)) == got(view.visible_nodes(nodes, at, far))


def test_empty_and_single(spark, tmp_path):
    for n in (0, 1):
        index = viewport.PlaceIndex(str(tmp_path / f"index{n}"))
        index.write(table(spark, n, 0.0), spark.createDataFrame([(0, 5.0, 5.0)][:n], "ord long, x double, y double"))
        assert got(index.visible(spark, [0.0, 0.0, 9.0, 9.0, 0.01])) == [(1, 0)][:n]


def test_ranges_cover_the_box():
    rng = random.Random(5)

    def key(x, y):
        return sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(viewport.BITS))

    for _ in range(200):
        x0, y0 = rng.randrange(1 << 16), rng.randrange(1 << 16)
        x1, y1 = min(65535, x0 + rng.choice([0, 3, 900, 60000])), min(65535, y0 + rng.choice([0, 5, 800, 60000]))
        found = viewport.ranges(x0, x1, y0, y1)
        assert len(found) <= viewport.RANGES + 4 and all(a[1] + 1 < b[0] for a, b in zip(found, found[1:], strict=False))
        for _ in range(20):
            k = key(rng.randint(x0, x1), rng.randint(y0, y1))
            assert any(a <= k <= b for a, b in found)
    assert viewport.ranges(0, 65535, 0, 65535) == [(0, (1 << 32) - 1)]


def test_a_box_reads_few_row_groups(spark, tmp_path):
    n = 40_000
    rng = random.Random(6)
    at = spark.createDataFrame([(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(n)], "ord long, x double, y double")
    index = viewport.PlaceIndex(str(tmp_path / "index"))
    index.write(table(spark, n, 0.0), at, block=256, row_group=20_000)
    plan = index.inside(spark, [100.0, 100.0, 20.0, 20.0])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "key#" in plan.split("DataFilters: [")[1]
    low, high = zip(*viewport.ranges(*index._corners(spark, [100.0, 100.0, 20.0, 20.0])), strict=True)
    groups = []
    for file in glob.glob(str(tmp_path / "index/places/*/*.parquet")):
        meta = pq.ParquetFile(file).metadata
        groups += [meta.row_group(k).column(meta.schema.names.index("key")).statistics for k in range(meta.num_row_groups)]
    met = [s for s in groups if any(s.min <= b and s.max >= a for a, b in zip(low, high, strict=True))]
    assert len(groups) >= 8 and len(met) <= len(groups) / 4
    counted = {r["block"]: r["n"] for r in index.blocks(spark, [100.0, 150.0, 700.0, 600.0]).collect()}
    want = {r["block"]: r["count"] for r in index.inside(spark, [100.0, 150.0, 700.0, 600.0]).groupBy("block").count().collect()}
    assert counted == want and len(want) > 100
