"""Helpers that the operators share: tables in the shared folder, words, global ranks."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.plans.loops import discard, shared_dir

__all__ = ["bind", "discard", "freed", "opened", "pieces", "ranked", "saved", "sealed", "shared_dir", "small", "small_batches", "table", "word_count", "words_of"]

#: ASCII white space, which alone separates words.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a regular expression.
SPACES = "[\\x20\\x09-\\x0D]+"
#: Bytes that the writer of a table gathers before it writes.
ROW_GROUP = 16 << 20
#: Rows and bytes of a batch between a task and its Python worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While a job runs, tasks and their Python workers pass each other a few MB at a time, whatever the texts' lengths."""
    before = {name: spark.conf.get(name) for name in BATCHES}
    for name, most in BATCHES.items():
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def freed(batches: Iterator) -> Iterator:
    """The same batches; then what Arrow keeps for later is given back, as workers outlive tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of fixed width, or of names, that are broadcast at most.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """A saved table of short rows, to be broadcast if they are few; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def pieces(batches: Iterator[pa.RecordBatch], column: str | int, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of one column (a row's whole value, however long)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size + 64) // most
        cuts = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def sealed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct `_extra`, whose names so can't clash with any that an operator adds."""
    extra = [c for c in docs.columns if c not in needed]
    packed = F.struct(*[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(extra)]) if extra else F.lit(0)
    return docs.select(*[c for c in docs.columns if c in needed], packed.alias("_extra"))


def opened(df: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows made from sealed(docs, ...) in the columns of docs again."""
    extra = [c for c in docs.columns if c not in df.columns or c == "_extra"]
    return df.select(*[F.col(f"_extra.x{extra.index(c)}").alias(c) if c in extra else F.col(c) for c in docs.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; none for null and empty texts."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, SPACES))


def word_count(text: Column) -> Column:
    """Number of words, long; 0 for null and empty texts."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(F.length(inner) == 0, F.lit(0)).otherwise(F.size(F.split(inner, SPACES))).cast("long")


def ranked(df: DataFrame, column: str, partitions: int, name: str = "rank") -> DataFrame:
    """Add the global rank (from 0) of distinct values by code point, null last.

    Values are dealt out by range, numbered inside each range, and shifted by the
    counts of the ranges before: no task sees more than its own range.
    """
    key = F.struct(F.col(column).isNull(), F.col(column))
    parts = saved(df.repartitionByRange(partitions, key).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = Window.partitionBy("_part").orderBy(F.col(column).isNull(), F.col(column))
    return (
        parts.withColumn("_n", F.row_number().over(inside) - 1)
        .join(offsets.select("_part", "_before"), "_part")
        .withColumn(name, (F.col("_n") + F.col("_before")).cast("long"))
        .drop("_part", "_n", "_before")
    )
