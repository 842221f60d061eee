"""Operator 1: exact top-k search by inner product over a vector-approximation file.

Vectors are integers. A batch of candidates is quantised to one of 256 cells per
component (the approximation); from the cells alone follow bounds on every
distance (minus the inner product). Exact vectors are then read in lower-bound
order until the k-th result is certain: no unread vector's bound can beat or tie
it. What a task has found for a query so far prunes its later batches.

Queries are taken in blocks of at most `block` (their bytes are bounded by that
parameter and sent to every task); each block scans all rows. Tasks return at most
k rows a query, which are merged by a window per query.

Defined cases: null vectors and vectors with null or non-finite components take
no part; vectors of another length than the query's are no candidates for it; ties
go to the smaller vec_id; rows with a null vec_id take no part; every row of a
repeated vec_id is a candidate for all other ids; an empty table gives no rows.
Products beyond 64 bits saturate; vectors with a component whose 256-fold is beyond
the range of doubles (from 7e305 on) take no part, as if it were not finite.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CELLS, BLOCK, BATCH = 256, 4096, 4096


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix of floor(256 * x)) for each length of vector."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    ends = vectors.offsets.to_numpy()
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become nan
    valid = ~np.asarray(vectors.is_null())
    sizes = ends[1:] - ends[:-1]
    for size in np.unique(sizes[valid]):
        at = np.flatnonzero(valid & (sizes == size))
        rows = flat[ends[at][:, None] + np.arange(size)]
        with np.errstate(over="ignore"):
            rows = np.floor(256 * rows)
        fine = np.isfinite(rows).all(axis=1)
        yield at[fine], rows[fine]


class Approximation:
    """Cells of a batch of vectors, and the bounds that they give."""

    def __init__(self, rows: np.ndarray):
        self.low = rows.min(axis=0)
        self.width = np.maximum(rows.max(axis=0) / CELLS - self.low / CELLS, 1e-9)
        self.cells = np.clip((rows - self.low) / self.width, 0, CELLS - 1).astype(np.uint8)

    def upper(self, queries: np.ndarray) -> np.ndarray:
        """queries x rows: no inner product is above this."""
        with np.errstate(over="ignore", invalid="ignore"):
            scaled_queries = queries * self.width
            centre = scaled_queries @ (self.cells.astype(np.float64) + 0.5).T
            slack = 0.5 * np.abs(scaled_queries).sum(axis=1)
            base = queries @ self.low
            bound = centre + (base + slack)[:, None]
            bound = bound + 1e-9 * (np.abs(bound) + slack[:, None] + np.abs(base)[:, None]) + 1e-6
        return np.maximum(np.nan_to_num(bound, nan=np.inf), -(2.0**63))  # what overflows bounds nothing


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products."""
    with np.errstate(over="ignore"):
        most = np.abs(rows).max(initial=0.0) * np.abs(query).max(initial=0.0) * max(1, len(query))
    if most < 2**53:
        return (rows @ query).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in rows]
    return np.array([max(-(2**63), min(2**63 - 1, x)) for x in whole], dtype=np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def search_batch(found: dict[int, tuple[np.ndarray, np.ndarray]], queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Bring found (query number -> scores, ids) up to date with a batch; scans cells, then reads exact rows in bound order."""
    bounds = Approximation(rows).upper(queries)
    for q, query in enumerate(queries):
        scores, kept = found.get(q, (np.empty(0, np.int64), np.empty(0, np.int64)))
        bound = bounds[q]
        if len(scores) == k:
            near = np.flatnonzero(bound >= scores[-1])
        else:
            near = np.arange(len(ids))
        if not len(near):
            continue
        near = near[np.argsort(-bound[near], kind="stable")]
        at, step = 0, 4 * k
        while at < len(near) and (len(scores) < k or bound[near[at]] >= scores[-1]):
            read = near[at : at + step]
            read = read[ids[read] != query_ids[q]]
            scores, kept = np.concatenate([scores, exact(rows[read], query)]), np.concatenate([kept, ids[read]])
            top = best(scores, kept, k)
            scores, kept = scores[top], kept[top]
            at, step = at + step, 2 * step
        found[q] = (scores, kept)


def _search_task(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Callable:
    """queries: by length, (ids, matrix)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict] = {size: {} for size in queries}
        for batch in batches:
            all_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, rows in _by_length(batch.column(1)):
                size = rows.shape[1]
                for i in range(0, len(at) if size in queries else 0, BATCH):
                    part = at[i : i + BATCH]
                    for j in range(0, len(queries[size][0]), 256):  # bounds of 256 queries at a time
                        block = found[size].setdefault(j, {})
                        search_batch(block, queries[size][1][j : j + 256], queries[size][0][j : j + 256], rows[i : i + BATCH], all_ids[part].astype(np.int64), k)
        out = [(int(queries[size][0][j + q]), int(i), int(s)) for size, blocks in found.items() for j, block in blocks.items() for q, (scores, kept) in block.items() for s, i in zip(scores, kept, strict=True)]
        if out:
            a, b, c = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["query_id", "vec_id", "score"])

    return task


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(vec_id, embedding) twice -> query_id, rank, vec_id, score: the k best rows for each query, itself apart."""
    spark = vectors.sparkSession
    vectors = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    queries = queries.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    n = queries.count()
    blocks = max(1, -(-n // block))
    out = None
    # dealt by hash, so a block holds about `block` queries; each is bounded and leaves the driver after its scan
    numbered = queries.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    for b in range(blocks):
        rows = numbered.filter(F.col("_block") == b).select("vec_id", "embedding").toArrow()
        by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        ids = rows.column(0).to_numpy()
        for at, matrix in _by_length(rows.column(1)):
            if len(at):
                by_length[matrix.shape[1]] = (ids[at].astype(np.int64), matrix)
        part = vectors.select("vec_id", "embedding").mapInArrow(_search_task(by_length, k), "query_id long, vec_id long, score long")
        if blocks > 1:
            part = common.saved(part, "block-hits")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
