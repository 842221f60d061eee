"""Scanning source trees (S1-S7): files to parsed rows, with a cache by content."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.schema import PARSED
from codeloom.sources import lexers
from codeloom.sources.listing import ScanOptions, exclude_regex, glob_regex, ignore_rules, ignored, language_of, listing, walk

__all__ = ["ScanOptions", "compatible", "exclude_regex", "glob_regex", "ignore_rules", "ignored", "language_of", "list_files", "listing", "parse_files", "read_files", "scan", "scan_files", "walk"]

#: What reading and parsing gives.
SCANNED = f"path string, language string, size long, mtime long, content_hash string, {PARSED}"


def _read_task(root: str, most: int = 8 << 20):
    def task(batches: Iterator) -> Iterator:
        import pandas as pd

        columns = ("path", "language", "size", "mtime", "content")
        rows, held = [], 0
        for batch in batches:
            for path, language, mtime in zip(batch["path"], batch["language"], batch["mtime"], strict=True):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        content = f.read()
                except OSError:
                    continue  # gone or unreadable since it was listed
                rows.append((path, language, len(content), mtime, content))
                held += len(content)
                if held >= most or len(rows) >= 2000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return task


def _dealt(listed: DataFrame, part_bytes: int = 32 << 20) -> DataFrame:
    """Listed files by tasks of about part_bytes of content."""
    total, count = listed.agg(F.sum("size"), F.count("*")).first()
    parts = max(1, -(-(total or 0) // part_bytes), min(1 + count // 500, listed.sparkSession.sparkContext.defaultParallelism))
    return listed.repartition(parts)


def read_files(listed: DataFrame, root: str) -> DataFrame:
    """(path, language, size, mtime) -> the same with content; executors read the files from a folder that all machines see.

    Spark's own binaryFile reader isn't used, as it passes over names that start with _ or .
    """
    schema = "path string, language string, size long, mtime long, content binary"
    return _dealt(listed).mapInPandas(_read_task(os.path.abspath(root)), schema)


def list_files(spark: SparkSession, root: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """(path, language, content): files of known languages below root, by relative path."""
    return read_files(listing(spark, root, options), root).select("path", "language", "content")


def _parse_task(body_spans: bool):
    def task(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            texts = (bytes(raw).decode("utf-8", "replace") for raw in batch["content"])
            rows = [lexers.parse(lang, text, body_spans) for lang, text in zip(batch["language"], texts, strict=True)]
            kept = {c: batch[c] for c in batch.columns if c != "content"}
            yield pd.DataFrame({**kept, **{k: [r[k] for r in rows] for k in lexers.EMPTY}})

    return task


def _scan_task(root: str, body_spans: bool):
    """Read, hash and parse in one pass: contents never leave the worker."""
    read, parsed = _read_task(root), _parse_task(body_spans)

    def task(batches: Iterator) -> Iterator:
        def hashed() -> Iterator:
            for batch in read(batches):
                batch["content_hash"] = [hashlib.sha256(bytes(raw)).hexdigest() for raw in batch["content"]]
                yield batch

        yield from parsed(hashed())

    return task


def parse_files(files: DataFrame, body_spans: bool = False) -> DataFrame:
    """(path, language, content) -> asts with content_hash (S7). One row in, one row out; failures give empty lists.

    Files are dealt to at least as many tasks as there are cores: parsing costs far more
    than moving them, and a table may come as one row group, so as one task.
    """
    spark = files.sparkSession
    dealt = files.select("path", "language", "content").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.withColumn("content_hash", F.sha2("content", 256)).mapInPandas(_parse_task(body_spans), f"path string, language string, content_hash string, {PARSED}")


def scan_files(listed: DataFrame, root: str, options: ScanOptions = ScanOptions(), cached=None) -> DataFrame:
    """Listed files -> path, language, size, mtime, content_hash, the parsed columns, hit.

    cached: of (content_hash, language) rows the cached rows (S8, S9); only files
    whose content isn't among them reach the parser.
    """
    if cached is None:
        fresh = _dealt(listed).mapInPandas(_scan_task(os.path.abspath(root), options.body_spans), SCANNED)
        return fresh.withColumn("hit", F.lit(False))
    hashed = read_files(listed, root).withColumn("content_hash", F.sha2("content", 256))
    known = cached(hashed.select("content_hash", "language")).select("content_hash", "language", "imports", "exports", "functions", "classes")
    columns = ("path", "language", "size", "mtime", "content_hash", "imports", "exports", "functions", "classes")
    hits = hashed.drop("content").join(known, ["content_hash", "language"]).select(*columns, F.lit(True).alias("hit"))
    misses = hashed.join(known.select("content_hash", "language"), ["content_hash", "language"], "left_anti")
    parsed = misses.select("path", "language", "size", "mtime", "content_hash", "content").mapInPandas(_parse_task(options.body_spans), SCANNED)
    return hits.unionByName(parsed.withColumn("hit", F.lit(False)))


def scan(spark: SparkSession, root: str, options: ScanOptions = ScanOptions(), cache: DataFrame | None = None) -> DataFrame:
    """Asts (path, language, content_hash, imports, exports, functions, classes, hit) of all files, with a cache that is a table or none."""
    own = None
    if cache is not None:
        own = cache.filter(F.coalesce("body_spans", F.lit(False)) == options.body_spans) if "body_spans" in cache.columns else cache.filter(F.lit(not options.body_spans))
    found = scan_files(listing(spark, root, options), root, options, None if own is None else lambda _: own)
    return found.drop("size", "mtime")


def compatible(asts: DataFrame, keep: str = "imports") -> DataFrame:
    """What a narrow scan keeps: "imports" alone, or "functions" too; exports never."""
    out = asts.withColumn("exports", F.array().cast(asts.schema["exports"].dataType))
    if keep == "imports":
        for c in ("functions", "classes"):
            out = out.withColumn(c, F.array().cast(asts.schema[c].dataType))
    return out
