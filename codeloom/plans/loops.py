"""Fixpoint loops: tables in the shared folder between rounds, adjacency that rounds don't shuffle."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two short columns that are broadcast at most; edges of a bucket, about, and at most where partitions are few.
BROADCAST_ROWS, BUCKET_ROWS, BUCKET_MOST = 100_000, 200_000, 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only on one machine may it be unset: then it is a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codeloom-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


#: Tables that the scopes of a thread have made, the innermost scope last.
_scopes = threading.local()


def _made() -> list[list[str]]:
    if not hasattr(_scopes, "made"):
        _scopes.made = []
    return _scopes.made


@contextlib.contextmanager
def scope() -> Iterator[set[str]]:
    """Tables made inside are deleted at its end, but for those whose folders are put into the set that it yields."""
    kept: set[str] = set()
    _made().append([])
    try:
        yield kept
    finally:
        own = _made().pop()
        spark = SparkSession.getActiveSession()
        for path in own:
            if path in kept:
                for outer in _made()[-1:]:
                    outer.append(path)
            elif spark is not None:
                _delete(spark, path)


def saved(df: DataFrame, name: str = "round", by: str | None = None) -> DataFrame:
    """A table in the shared folder: ends lineage, survives lost executors. by: a column that it is partitioned by."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for scope_ in _made()[-1:]:
        scope_.append(path)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def result(df: DataFrame, kept: set[str], name: str = "result") -> DataFrame:
    """df as a table that outlives the scope that yielded kept."""
    table = saved(df, name)
    kept.update(path for scope_ in _made()[-1:] for path in scope_[-1:])
    return table


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by saved() that no later DataFrame reads."""
    for df in tables:
        for name in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            _delete(df.sparkSession, name)


def small(df: DataFrame) -> DataFrame:
    """A saved table, to be broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def buckets(spark: SparkSession, rows: int) -> int:
    """Buckets for so many rows: a bucket is sorted by one task, however few partitions are set."""
    most = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(min(most, max(4, -(-rows // BUCKET_ROWS))), -(-rows // BUCKET_MOST))


@contextlib.contextmanager
def bucketed(df: DataFrame, *keys: str, rows: int | None = None, dealt: bool = False, by: str | None = None) -> Iterator[DataFrame]:
    """df as a table bucketed by keys while the block runs: joins on the keys move the other side only.

    rows: of df, or a bound, where it is cheap to read; else df is written and counted first. dealt: df's
    partitions are the buckets already. by: a column whose values the table is partitioned by.
    """
    spark = df.sparkSession
    table = saved(df, "unsorted") if rows is None else df
    n = buckets(spark, table.count() if rows is None else rows)
    name = f"codeloom_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    moved = table if dealt else table.repartition(n, *keys)
    out = moved.write.partitionBy(by) if by else moved.sortWithinPartitions(*keys).write.sortBy(*keys)
    out.bucketBy(n, *keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    if rows is None:
        discard(table)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(spark, path)
