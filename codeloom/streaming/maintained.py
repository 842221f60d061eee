"""A graph that is kept up to date by changes of files.

A store holds, for a tree of sources,

* `files`: parsed files with their resolved imports, which is also the manifest
  (path, size, time of change, content hash) that spares reading unchanged files;
* `nodes` and `edges`, in their order;
* `index`: (candidate, path), the paths whose coming or going can change how a
  file's imports resolve;
* `cache`: parses by content, whatever the path.

files, nodes and edges are cut into buckets by ranges of paths, index and cache into
slots by hash. Consecutive buckets are a group, which is a file of the table, sorted by
bucket: there are as many files as GROUP asks for, however small buckets are, and of a
file only the pages of a bucket are read. A batch of changes reads and writes the buckets and slots that it
touches: changed files are parsed (or found in the cache), imports are resolved again
for them and for files whose candidates came or went, and the rows of these files
alone are replaced. A file's nodes and edges hang on its own row, so the result is
that of a full build.

Each batch writes new folders `version=N`; the file `vN` then names, for every
bucket, the version in force, its first path and its counts. It is written last and as
a whole, so a batch that dies leaves the version before it in force. Orders are kept
inside a bucket and become those of the whole graph by adding the counts of the buckets
before, a small list. Two versions stay readable; older folders are deleted.
"""

from __future__ import annotations

import bisect
import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators.build import EDGE_COLUMNS, EDGE_ORDER, NODE_COLUMNS, NODE_ORDER, file_rows, named_edges
from codeloom.operators.resolve import resolve_asts, watched
from codeloom.plans import fs, loops
from codeloom.schema import EDGE_SCHEMA, NODE_SCHEMA, PARSED, Graph
from codeloom.sources import files

#: Files of a bucket when it is made, at most; times that before all buckets are cut anew; slots; versions of the index before they are merged.
BUCKET, OVERFULL, SLOTS, MERGE = 2000, 8, 64, 16
#: Files of a group of buckets, about; buckets that a filter names one by one; how tables lie in folders.
GROUP, NAMED, LAYOUT = 32_000, 100, 2
FILE = f"path string, language string, size long, mtime long, content_hash string, {PARSED}"
_NODE = "_group int, _i int, _at long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NODE_SCHEMA if f.name != "ord")
_EDGE = "path string, _copy int, _group int, _i int, _at long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EDGE_SCHEMA if f.name != "ord")
_CACHE = f"content_hash string, language string, body_spans boolean, parsed_at long, {PARSED}"
TABLES = {"files": FILE, "nodes": _NODE, "edges": _EDGE}


def bucket_of(path: Column, lows: list[str]) -> Column:
    """The range of paths that holds path: that of the last bucket whose first path isn't above it."""

    @F.pandas_udf("int")
    def found(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: max(0, bisect.bisect_right(lows, p.encode()) - 1)).astype("int32")

    lows = [low.encode() for low in lows]
    return found(path)


def slot_of(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(SLOTS)).cast("int")


def _numbers(df: DataFrame, column: str) -> list[int]:
    """Distinct buckets or slots, of which there are few."""
    return sorted(r[0] for r in df.select(column).distinct().collect())


class Maintained:
    """The store at a path. Listeners get the number of each version that is published."""

    def __init__(self, path: str, level: str = "function", bucket: int = BUCKET, body_spans: bool = False):
        self.path, self.level, self.bucket, self.body_spans = path, level, bucket, body_spans
        self.listeners: list[Callable[[int], None]] = []
        #: Of the last batch: what was read (table, bucket or slot), and counts of files parsed and resolved again.
        self.read: set[tuple[str, int]] = set()
        self.parsed = self.resolved = self.hits = 0

    # ---- versions

    def _state(self, spark: SparkSession) -> dict:
        numbers = [int(n[1:]) for n in fs.names(spark, self.path) if n[:1] == "v" and n[1:].isdigit()]
        state = json.loads(fs.read_text(spark, f"{self.path}/v{max(numbers)}")) if numbers else {}
        if state.get("layout") != LAYOUT:  # nothing there, or by folders of another kind: to be built
            return {"version": max(numbers, default=0), "layout": LAYOUT, "buckets": [], "index": [], "cache": {}, "header": {}}
        return state | {"cache": {int(k): v for k, v in state["cache"].items()}}

    def _publish(self, spark: SparkSession, state: dict) -> None:
        fs.write_text(spark, f"{self.path}/v{state['version']}", json.dumps(state))
        old = state["version"] - 2
        fs.delete(spark, f"{self.path}/v{old}")
        kept = [state] + ([json.loads(fs.read_text(spark, f"{self.path}/v{old + 1}"))] if fs.exists(spark, f"{self.path}/v{old + 1}") else [])
        held = {b["version"] for s in kept for b in s["buckets"]}, {v for s in kept for v in s["index"]}, {v for s in kept for v in s["cache"].values()}
        for tables, versions in ((TABLES, held[0]), (("index",), held[1]), (("cache",), held[2])):
            for table in tables:
                for name in fs.names(spark, f"{self.path}/{table}"):
                    if int(name.partition("=")[2]) not in versions:
                        fs.delete(spark, f"{self.path}/{table}/{name}")
        for listener in self.listeners:
            listener(state["version"])

    @property
    def version(self) -> int:
        return self._state(SparkSession.getActiveSession())["version"]

    # ---- reading

    def _table(self, spark: SparkSession, table: str, schema: str, paths: list[str]) -> DataFrame:
        if not paths:
            return spark.createDataFrame([], schema)
        return spark.read.schema(f"{schema}, version int, {'slot' if table in ('index', 'cache') else 'group'} int").option("basePath", f"{self.path}/{table}").parquet(*paths)

    def _buckets(self, spark: SparkSession, state: dict, table: str, only: list[int] | None = None) -> DataFrame:
        """Rows of a table's buckets that are in force, with their bucket."""
        wanted = None if only is None else set(only)
        chosen = {i: b for i, b in enumerate(state["buckets"]) if (wanted is None or i in wanted) and b[table]}
        if only is not None:
            self.read |= {(table, i) for i in chosen}
        folders = sorted({(b["version"], b["group"]) for b in chosen.values()})
        rows = self._table(spark, table, f"{TABLES[table]}, bucket int", [f"{self.path}/{table}/version={v}/group={g}" for v, g in folders])
        if not chosen:
            return rows
        if len(chosen) < len(state["buckets"]):
            rows = rows.filter(F.col("bucket").isin(list(chosen)) if len(chosen) <= NAMED else F.col("bucket").between(min(chosen), max(chosen)))
        force = spark.createDataFrame([(i, b["version"]) for i, b in chosen.items()], "bucket int, version int")
        return rows.join(F.broadcast(force), ["bucket", "version"], "left_semi").drop("version", "group")  # a row per bucket

    def _slots(self, spark: SparkSession, state: dict, table: str, schema: str, only: list[int]) -> DataFrame:
        self.read |= {(table, s) for s in only}
        versions = [(v, s) for v in state["index"] for s in only] if table == "index" else [(state["cache"][s], s) for s in only if s in state["cache"]]
        there = [f"{self.path}/{table}/version={v}/slot={s}" for v, s in versions]
        there = [p for p in there if fs.exists(spark, p)]
        return self._table(spark, table, schema + ("" if there else ", slot int"), there).drop("version")

    def current(self, spark: SparkSession) -> Graph | None:
        """The graph in force; it stays readable until two versions follow."""
        state = self._state(spark)
        if not state["buckets"]:
            return None

        def whole(table: str, columns: tuple[str, ...]) -> DataFrame:
            before, rows = 0, []
            for i, b in enumerate(state["buckets"]):
                rows.append((i, before))
                before += b[table]
            shifts = spark.createDataFrame(rows or [(0, 0)], "bucket int, _before long")
            placed = self._buckets(spark, state, table).join(F.broadcast(shifts), "bucket")  # a row per bucket
            return placed.select((F.col("_at") + F.col("_before")).alias("ord"), *columns)

        return Graph(whole("nodes", NODE_COLUMNS), whole("edges", EDGE_COLUMNS), state["header"])

    def parsed_files(self, spark: SparkSession) -> DataFrame:
        """Parsed files, imports resolved."""
        return self._buckets(spark, self._state(spark), "files").drop("bucket")

    def functions(self, spark: SparkSession, path: str) -> DataFrame:
        """The row of one file; one bucket is read."""
        state = self._state(spark)
        lows = [b["low"] for b in state["buckets"]]
        at = max(0, bisect.bisect_right([x.encode() for x in lows], path.encode()) - 1)
        return self._buckets(spark, state, "files", [at]).filter(F.col("path") == path).drop("bucket")

    # ---- the parse cache

    def cached(self, keys: DataFrame, state: dict | None = None) -> DataFrame:
        """The cached parses of (content_hash, language) rows; only their slots are read."""
        spark = keys.sparkSession
        state = state or self._state(spark)
        slots = _numbers(keys.select(slot_of(F.col("content_hash")).alias("slot")), "slot")
        return self._slots(spark, state, "cache", _CACHE, slots).filter(F.col("body_spans") == self.body_spans).drop("slot", "body_spans").join(keys.distinct(), ["content_hash", "language"], "left_semi")

    def _put(self, spark: SparkSession, state: dict, parsed: DataFrame, version: int) -> None:
        """Bring the slots of new parses up to date, newest per content and language."""
        rows = parsed.select("content_hash", "language", F.lit(self.body_spans).alias("body_spans"), F.lit(int(time.time())).cast("long").alias("parsed_at"), "imports", "exports", "functions", "classes").withColumn("slot", slot_of(F.col("content_hash")))
        if state["cache"]:
            rows = loops.saved(rows, "parses")
        old = self._slots(spark, state, "cache", _CACHE, [s for s in (_numbers(rows, "slot") if state["cache"] else []) if s in state["cache"]])
        number = F.row_number().over(Window.partitionBy("slot", "content_hash", "language", "body_spans").orderBy(F.desc("parsed_at")))
        merged = (old.unionByName(rows) if state["cache"] else rows).repartition("slot").withColumn("_n", number).filter("_n = 1").drop("_n")
        self._write(merged, "cache", "slot", version)
        state["cache"] |= {int(n.partition("=")[2]): version for n in fs.names(spark, f"{self.path}/cache/version={version}") if n.startswith("slot=")}

    # ---- writing

    def _write(self, df: DataFrame, table: str, by: str, version: int, *order: str) -> None:
        """df, dealt by groups or slots, as a file of each."""
        df.sortWithinPartitions(by, *order).write.mode("overwrite").partitionBy(by).parquet(f"{self.path}/{table}/version={version}")

    def _index(self, spark: SparkSession, state: dict, asts: DataFrame, version: int) -> None:
        rows = watched(asts).withColumn("slot", slot_of(F.col("candidate")))
        if len(state["index"]) >= MERGE:
            old = [f"{self.path}/index/version={v}" for v in state["index"] if fs.names(spark, f"{self.path}/index/version={v}")]
            rows = rows.unionByName(self._table(spark, "index", "candidate string, path string", old).drop("version"))
            state["index"] = []
        rows = rows.repartition("slot").dropDuplicates(["slot", "candidate", "path"])  # rows move once
        self._write(rows, "index", "slot", version, "candidate")
        state["index"] = [*state["index"], version]

    def _rows(self, asts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of resolved files, a table, with bucket and order columns."""
        nodes, edges = file_rows(asts, self.level, ("bucket",), once=True)
        # a target is known where an import was resolved to a file or a file holds what it declares
        return nodes, named_edges(edges.withColumn("resolved", F.col("target").isNotNull()))

    def _store(self, spark: SparkSession, state: dict, files_: DataFrame, nodes: DataFrame, edges: DataFrame, touched: list[int], version: int) -> None:
        """Write whole buckets, and their counts into the state."""
        written, groups = None, F.broadcast(spark.createDataFrame([(b, state["buckets"][b]["group"]) for b in touched] or [(0, 0)], "bucket int, group int"))
        for table, df, order in (("files", files_, ("path",)), ("nodes", nodes, NODE_ORDER), ("edges", edges, EDGE_ORDER)):
            df = df.join(groups, "bucket").repartition("group")  # rows move once: buckets are numbered inside their groups
            if table != "files":
                df = df.drop("_at").withColumn("_at", (F.row_number().over(Window.partitionBy("group", "bucket").orderBy(*order)) - 1).cast("long"))
            names = [c.split(" ")[0] for c in _columns(TABLES[table])]
            self._write(df.select(*names, "bucket", "group"), table, "group", version, "bucket", *order)
            if fs.names(spark, f"{self.path}/{table}/version={version}")[1:]:  # more than a mark of success
                own = spark.read.schema("bucket int, group int").parquet(f"{self.path}/{table}/version={version}").select(F.lit(table).alias("table"), "bucket")
                written = own if written is None else written.unionByName(own)
        counts = {(r["table"], r["bucket"]): r["count"] for r in written.groupBy("table", "bucket").count().collect()} if written is not None else {}
        for b in touched:
            state["buckets"][b] |= {"version": version, **{t: counts.get((t, b), 0) for t in TABLES}}

    def full(self, asts: DataFrame, header: dict | None = None) -> None:
        """Build the store from parsed files (FILE columns), a row per path; what was there is replaced."""
        with loops.scope():
            self._full(asts, header)

    def _full(self, asts: DataFrame, header: dict | None) -> None:
        spark = asts.sparkSession
        state = self._state(spark)
        version = state["version"] + 1
        asts = loops.saved(asts.select(*[c.split(" ")[0] for c in _columns(FILE)]), "parsed")
        self.read, self.parsed, self.resolved = set(), asts.count(), 0
        cleared = asts.withColumn("imports", _open(F.col("imports")))
        # groups are ranges of paths, buckets the runs of a sorted group
        ranged = resolve_asts(cleared).repartitionByRange(max(1, -(-self.parsed // max(GROUP, self.bucket))), "path").sortWithinPartitions("path")
        ranged = loops.saved(ranged.withColumn("_number", F.monotonically_increasing_id()), "ranged")
        group, run = F.shiftright("_number", 33).cast("int"), F.floor(F.col("_number").bitwiseAND((1 << 33) - 1) / self.bucket).cast("int")
        ranged = ranged.select(*asts.columns, group.alias("group"), run.alias("_run"))
        runs = sorted(tuple(r) for r in ranged.groupBy("group", "_run").agg(F.min("path")).collect())  # a row per bucket
        places = spark.createDataFrame([(g, r, i) for i, (g, r, _) in enumerate(runs)] or [(0, 0, 0)], "group int, _run int, bucket int")
        ranged = ranged.join(F.broadcast(places), ["group", "_run"]).drop("group", "_run")
        state |= {"version": version, "layout": LAYOUT, "buckets": [{"low": low, "group": g} for g, _, low in runs] or [{"low": "", "group": 0}], "index": [], "header": {"root": "", **(header or {}), "scanned_at": _now()}}
        self._store(spark, state, ranged, *self._rows(ranged), list(range(len(state["buckets"]))), version)
        self._index(spark, state, ranged, version)
        self._put(spark, state, asts, version)
        state["header"]["cache_hits"] = 0
        self._publish(spark, state)

    def apply(self, changed: DataFrame, removed: DataFrame, header: dict | None = None) -> None:
        """Bring the store up to date.

        changed: parsed files (FILE columns, and hit where the parse was cached) that
        are new or differ, a row per path; removed: (path). Paths in both count as
        changed.
        """
        with loops.scope():
            self._apply(changed, removed, header)

    def _apply(self, changed: DataFrame, removed: DataFrame, header: dict | None) -> None:
        spark = changed.sparkSession
        state = self._state(spark)
        if not state["buckets"]:
            return self._full(changed, header)
        self.read = set()
        version, lows = state["version"] + 1, [b["low"] for b in state["buckets"]]
        own = [c.split(" ")[0] for c in _columns(FILE)]
        changed = changed if "hit" in changed.columns else changed.withColumn("hit", F.lit(False))
        changed = loops.saved(changed.select(*own, "hit", bucket_of(F.col("path"), lows).alias("bucket")), "changed")
        removed = loops.saved(removed.select("path").join(changed, "path", "left_anti").distinct().withColumn("bucket", bucket_of(F.col("path"), lows)), "removed")
        # which paths come and go
        moved = changed.select("path", "bucket").unionByName(removed)
        there = self._buckets(spark, state, "files", _numbers(moved, "bucket")).select("path")
        came = changed.select("path").join(there, "path", "left_anti").withColumn("came", F.lit(True))
        went = removed.select("path").join(there, "path", "left_semi").withColumn("came", F.lit(False))
        ends = loops.saved(came.unionByName(went), "ends")
        # files that a coming or going can matter to
        at = ends.select(F.col("path").alias("candidate"), slot_of(F.col("path")).alias("slot"))
        index = self._slots(spark, state, "index", "candidate string, path string", _numbers(at, "slot"))
        met = index.join(at, ["candidate", "slot"], "left_semi").select("path").distinct().join(moved, "path", "left_anti")
        met = loops.saved(met.withColumn("bucket", bucket_of(F.col("path"), lows)), "met")
        again = self._buckets(spark, state, "files", _numbers(met, "bucket")).join(met.select("path"), "path", "left_semi")
        todo = loops.saved(changed.drop("hit").unionByName(again).withColumn("imports", _open(F.col("imports"))), "todo")
        # their candidates among the paths that are there now
        tried = watched(todo).select(F.col("candidate").alias("path")).distinct().withColumn("bucket", bucket_of(F.col("path"), lows))
        tried = loops.saved(tried, "tried")
        known = self._buckets(spark, state, "files", _numbers(tried, "bucket")).select("path").join(tried, "path", "left_semi")
        known = known.join(ends.filter("not came"), "path", "left_anti").unionByName(ends.filter("came").select("path")).distinct()
        done = loops.saved(resolve_asts(todo, known), "resolved")
        # whole buckets anew, of which only these files' rows differ
        touched = _numbers(moved.unionByName(met), "bucket")
        replaced = loops.saved(moved.unionByName(met).select("path"), "replaced")

        def stays(table: str) -> DataFrame:
            return self._buckets(spark, state, table, touched).join(F.broadcast(replaced) if replaced.count() < 10_000 else replaced, "path", "left_anti")

        nodes, edges = self._rows(done)
        kept = stays("files"), stays("nodes"), stays("edges")
        rows = done, nodes.withColumn("_at", F.lit(0).cast("long")).drop("_copy"), edges.withColumn("_at", F.lit(0).cast("long")).drop("specifier")
        total, hits = changed.agg(F.count("*"), F.count_if("hit")).first()
        whole = sum(b["files"] for b in state["buckets"])
        self._store(spark, state, *(k.unionByName(r.select(*k.columns)) for k, r in zip(kept, rows, strict=True)), touched, version)
        self._index(spark, state, changed, version)
        fresh = changed.filter(~F.col("hit"))
        if total > hits:
            self._put(spark, state, fresh, version)
        now = sum(b["files"] for b in state["buckets"])
        self.parsed, self.resolved, self.hits = total - hits, done.count(), now - (total - hits)
        state |= {"version": version, "header": {**state["header"], **(header or {}), "scanned_at": _now(), "cache_hits": self.hits}}
        self._publish(spark, state)
        if max(b["files"] for b in state["buckets"]) > OVERFULL * self.bucket and whole != now:
            self._full(self.parsed_files(spark), state["header"])
        return None

    # ---- trees

    def refresh(self, spark: SparkSession, root: str, options: files.ScanOptions = files.ScanOptions()) -> bool:
        """Scan a tree: list it, read and parse what the manifest doesn't know as it is, bring the store up to date. Whether anything changed."""
        with loops.scope():
            return self._refresh(spark, root, options)

    def _refresh(self, spark: SparkSession, root: str, options: files.ScanOptions) -> bool:
        listed = files.listing(spark, root, options)
        state = self._state(spark)
        if not state["buckets"]:
            self._full(files.scan_files(listed, root, options, None).drop("hit"), {"root": root})
            return True
        old = self._buckets(spark, state, "files").select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
        differ = listed.join(old, "path", "full").filter("_mtime is null or mtime is null or size <> _size or mtime <> _mtime")
        rows = loops.saved(differ.select("path", "language", "size", "mtime"), "differing")
        if rows.isEmpty():
            return False
        self.take(rows.filter("language is not null"), rows.filter("language is null").select("path"), root, options)
        return True

    def take(self, listed: DataFrame, removed: DataFrame, root: str, options: files.ScanOptions = files.ScanOptions()) -> None:
        """Read and parse listed files (path, language, size, mtime), and apply them; files that are gone by now count as removed."""
        with loops.scope():
            self._take(listed, removed, root, options)

    def _take(self, listed: DataFrame, removed: DataFrame, root: str, options: files.ScanOptions) -> None:
        spark = listed.sparkSession
        state = self._state(spark)
        found = loops.saved(files.scan_files(listed, root, options, (lambda keys: self.cached(keys, state)) if state["cache"] else None), "scanned")
        gone = listed.select("path").join(found, "path", "left_anti")
        self._apply(found, removed.unionByName(gone), {"root": root})


def _columns(schema: str) -> list[str]:
    """The fields of a schema text, cut at outer commas."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]


def _open(imports: Column) -> Column:
    """Imports as parsed, to be resolved."""
    return F.transform(imports, lambda i: i.withField("resolved_path", F.lit(None).cast("string")))


def _now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
