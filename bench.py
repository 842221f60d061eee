"""Headline queries: one JSON line with seconds per query.

$BENCH_SF_DIR (default /root/testdata/sf0.1), $BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = ["orphans_fk", "graph_stats", "blast_radius_seq", "reverse_deps_seq", "cycles_seq", "subgraph_both", "topo_rounds", "inter_module_edges", "dir_groups", "search_nodes", "edge_resolution_flags", "resolve_typescript", "scan_fresh", "scan_cached"]


def tree(root: str, count: int = 10_000) -> None:
    """A made source tree of `count` small files that import each other."""
    for i in range(count):
        folder = os.path.join(root, f"d{i % 100}")
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, f"m{i}.ts"), "w") as f:
            f.write(f"import a from './m{(i * 7 + 100) % count}';\nimport b from '../d{(i + 1) % 100}/m{(i + 1) % count}';\nexport function f{i}() {{ return a + b; }}\n")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from codeloom import registry

    from codeloom.streaming import watch

    work = tempfile.mkdtemp(prefix="bench-tree-")
    tree(f"{work}/src")

    def scan(_, __):
        return watch.rebuild(spark, f"{work}/src", f"{work}/state", "file").edges

    runs = {**registry.QUERIES, "scan_fresh": scan, "scan_cached": scan}
    registry.QUERIES["orphans_fk"](spark, sf).count()  # warm up
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        runs[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
