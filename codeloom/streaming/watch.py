"""Watching sources: changes as a stream, graphs kept up to date by them."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from codeloom.schema import Graph
from codeloom.sources import files, listing
from codeloom.streaming.maintained import Maintained

#: Changes of the log before its base is written anew.
COMPACT = 64
#: The graph in force and its versions; see Maintained.
Snapshots = Maintained

Change = tuple[str, int, str, str | None, int | None, int]
"""path, mtime, op, language, size, seq"""


class ChangeLog:
    """An append-only log of changes of a tree, a file per batch, numbered from 1, and bases: whole listings as of a number."""

    def __init__(self, path: str):
        self.path = path
        os.makedirs(path, exist_ok=True)

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(n.split("-")[1].split(".")[0]) for n in os.listdir(self.path) if n.startswith(kind) and n.endswith(".jsonl"))

    def _write(self, name: str, rows) -> None:
        """The whole file or none of it."""
        draft = os.path.join(self.path, name + ".draft")
        with open(draft, "w", encoding="utf-8") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        os.replace(draft, os.path.join(self.path, name))

    def _rows(self, name: str) -> Iterator[list]:
        with open(os.path.join(self.path, name), encoding="utf-8") as f:
            yield from map(json.loads, f)

    def last(self) -> int:
        return max(self._numbers("changes") + self._numbers("base"), default=0)

    def listing(self) -> dict[str, list]:
        """path -> mtime, size, language, as of the last number."""
        base = max(self._numbers("base"), default=0)
        out = {p: rest for p, *rest in self._rows(f"base-{base}.jsonl")} if base else {}
        for n in self._numbers("changes"):
            if n > base:
                for path, mtime, op, language, size in self._rows(f"changes-{n}.jsonl"):
                    if op == "remove":
                        out.pop(path, None)
                    else:
                        out[path] = [mtime, size, language]
        return out

    def append(self, rows: list[tuple]) -> int:
        n = self.last() + 1
        self._write(f"changes-{n}.jsonl", rows)
        return n

    def between(self, start: int, end: int) -> Iterator[Change]:
        for n in self._numbers("changes"):
            if start < n <= end:
                yield from ((*r, n) for r in self._rows(f"changes-{n}.jsonl"))

    def compact(self, done: int, known: dict[str, list]) -> None:
        """Write a base as of the last number, and drop what no reader needs: changes up to `done`."""
        if len(self._numbers("changes")) <= COMPACT:
            return
        now = self.last()
        self._write(f"base-{now}.jsonl", ([p, *rest] for p, rest in sorted(known.items())))
        for n in self._numbers("base"):
            if n < now:
                os.remove(os.path.join(self.path, f"base-{n}.jsonl"))
        for n in self._numbers("changes"):
            if n <= min(done, now):
                os.remove(os.path.join(self.path, f"changes-{n}.jsonl"))


class _ChangeReader(SimpleDataSourceStreamReader):
    """Offsets are numbers of the log, whatever the tree's size; a restart goes on from the log."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.scan = files.ScanOptions(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(options.get("scan", "{}")).items()})
        self.log = ChangeLog(options.get("log") or os.path.join(self.root, ".codeloom", "changes"))
        self.known: dict[str, list] | None = None
        self.seq = 0

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def read(self, start: dict) -> tuple[Iterator, dict]:
        if self.known is None or self.seq != self.log.last():
            self.known, self.seq = self.log.listing(), self.log.last()
        now = {p: [mtime, size, language] for p, language, size, mtime in listing.walk(self.root, self.scan)}
        old = self.known
        rows = [(p, v[0], "create" if p not in old else "modify", v[2], v[1]) for p, v in sorted(now.items()) if old.get(p) != v]
        rows += [(p, old[p][0], "remove", None, None) for p in sorted(old.keys() - now.keys())]
        if rows:
            self.seq, self.known = self.log.append(rows), now
        return iter(list(self.log.between(start["seq"], self.seq))), {"seq": self.seq}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator:
        return iter(list(self.log.between(start["seq"], end["seq"])))

    def commit(self, end: dict) -> None:
        if self.known is not None:
            self.log.compact(end["seq"], self.known)


class SourceChanges(DataSource):
    """A streaming source of changes below a folder: create, modify and remove of the files that a scan would find."""

    @classmethod
    def name(cls) -> str:
        return "source_changes"

    def schema(self) -> str:
        return "path string, mtime long, op string, language string, size long, seq long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _ChangeReader(self.options)


def changes(spark: SparkSession, root: str, options: files.ScanOptions = files.ScanOptions(), log: str | None = None) -> DataFrame:
    """T1 as a streaming DataFrame. log: folder of the change log, by default inside the root."""
    spark.dataSource.register(SourceChanges)
    reader = spark.readStream.format("source_changes").option("path", root).option("scan", json.dumps(dataclasses.asdict(options)))
    return (reader.option("log", log) if log else reader).load()


def rebuild(spark: SparkSession, root: str, state: str, level: str = "function", options: files.ScanOptions = files.ScanOptions()) -> Graph:
    """T3 for a scan: the store at `state` is brought up to date with the tree, reading files that changed alone; its graph."""
    store = Maintained(f"{state}/{level}", level, body_spans=options.body_spans)
    store.refresh(spark, root, options)
    return store.current(spark)


def watch(spark: SparkSession, root: str, store: Maintained, checkpoint: str, interval: str = "300 milliseconds", once: bool = False, options: files.ScanOptions = files.ScanOptions(), log: str | None = None):
    """A streaming query that publishes a new version of the graph for each batch of changes, from these alone.

    Changes inside an interval make one batch, so the last one is never lost. A batch
    that is run again has the same result. once: work off what is there and stop.
    """

    def on_batch(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq")))
        rows = batch.withColumn("_n", last).filter("_n = 1")
        there = rows.filter(F.col("op") != "remove").select("path", "language", "size", "mtime")
        store.take(there, rows.filter(F.col("op") == "remove").select("path"), root, options)

    writer = changes(spark, root, options, log).writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def change_rate(stream: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Extension: changes per window of their own time and kind, late ones dropped after `late`."""
    timed = stream.withColumn("at", F.timestamp_micros(F.floor(F.col("mtime") / 1000).cast("long")))
    return timed.withWatermark("at", late).groupBy(F.window("at", window), "op").agg(F.count("*").alias("changes"))
