"""Operator 13: lines that many documents share are kept in one document only.

A line's key is the line without ASCII white space at its ends and with A-Z
lower-cased. Keys of at least `least_chars` code points that at least `least_docs`
documents hold lose all their lines except in the largest doc_id that holds them.

Keys go by 128-bit hashes (xxh3). The hashes of shared keys are dealt into shards
by their leading half; each shard becomes a minimal perfect hash, which gives every
key a slot of its own among as many slots as keys, and arrays by slot: a
fingerprint (the other half of the hash), the number of documents, the keeper. A
line that isn't shared lands in some slot too, and its fingerprint tells it apart,
but for one in 2**64.

Documents probe the arrays and are never joined with lines. Arrays of up to
`most_bytes`, a size known before they are made, are sent to all tasks, which read
each text once more and need no shuffle. Larger ones stay in a table: the hashes of
lines travel to their shard (a shard's probes are dealt over several copies of it,
so a line that all documents hold isn't one task), and the hits travel back to the
documents.

Defined cases: a null or empty text is one empty line; a document whose lines all
go keeps ''; every row is a document, and a row with a null doc_id counts as one
below all others (where only such rows hold a key, all of them keep it); repeated
rows with the largest id all keep the line; a line counts once per document,
however often it stands there; texts of any length are cut one at a time; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Keys of a shard, about; bytes that a key takes in its arrays, at most; bytes of arrays that are sent to all tasks.
SHARD, KEY_BYTES, MOST_BYTES = 200_000, 32, 64 << 20
#: Probes of a copy of a shard, about, where hashes travel.
PROBES = 1_000_000
#: Bits of a level of the hash per key that it has to place; levels before the few keys left are listed.
GAMMA, LEVELS = 2, 40
#: Hashes that a task counts before it passes them on.
HELD = 200_000
NO_ID = -(1 << 63)


def key_of(line: str) -> str:
    """The line's key; letters other than A-Z stay as they are."""
    return line.strip(common.SPACE).encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def hash_of(key: str) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
    return whole >> 64, whole & 0xFFFFFFFFFFFFFFFF


def hashes(lines: list[str], least_chars: int) -> list[tuple[int, int] | None]:
    """The hash of each line's key; None for short keys."""
    return [hash_of(key_of(x)) if len(x) >= least_chars and len(x.strip(common.SPACE)) >= least_chars else None for x in lines]


# ---- the minimal perfect hash


def _mix(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    """A hash of the level, of both halves."""
    x = high ^ np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) ^ low
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Slots 0..n-1 for n different keys of two 64-bit halves.

    Each level has a bit per place; keys alone at their place set its bit, the
    others go on to the next level. A key's slot is the number of bits set before
    its own. Keys left after the last level are listed and found by search.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest
        self.counts = [np.concatenate([[0], np.cumsum(np.bitwise_count(x), dtype=np.int64)]) for x in levels]
        self.before = np.concatenate([[0], np.cumsum([c[-1] for c in self.counts], dtype=np.int64)]).astype(np.int64)

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        levels = []
        while len(high) and len(levels) < LEVELS:
            size = -(-len(high) * GAMMA // 64) * 64
            at = _mix(high, low, len(levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = ~alone[at.astype(np.int64)]
            high, low = high[left], low[left]
        order = np.lexsort((low, high))
        return cls(levels, np.stack([high[order], low[order]]))

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Each key's slot; other keys get some slot, or -1."""
        out = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for i, bits in enumerate(self.levels):
            at = _mix(high[left], low[left], i) % np.uint64(64 * len(bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            under = bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[i] + self.counts[i][word[hit]] + np.bitwise_count(under)
            left = left[~hit]
        listed = {(int(h), int(x)): i for i, (h, x) in enumerate(zip(*self.rest, strict=True))}
        for i in left if listed else ():
            out[i] = self.before[-1] + n if (n := listed.get((int(high[i]), int(low[i])))) is not None else -1
        return out


class Shard:
    """The arrays of one shard behind its hash."""

    def __init__(self, index: PerfectHash, prints: np.ndarray, docs: np.ndarray, keeper: np.ndarray) -> None:
        self.index, self.prints, self.docs, self.keeper = index, prints, docs, keeper

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, docs: np.ndarray, keeper: np.ndarray) -> Shard:
        index = PerfectHash.of(high, low)
        at = index.slots(high, low)
        out = [np.empty(len(high), x.dtype) for x in (low, docs, keeper)]
        for to, x in zip(out, (low, docs, keeper), strict=True):
            to[at] = x
        return cls(index, *out)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, prints=self.prints, docs=self.docs, keeper=self.keeper, rest=self.index.rest, **{f"l{i}": x for i, x in enumerate(self.index.levels)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Shard:
        x = np.load(io.BytesIO(data))
        return cls(PerfectHash([x[f"l{i}"] for i in range(len(x.files) - 4)], x["rest"]), x["prints"], x["docs"], x["keeper"])

    def goes(self, high: np.ndarray, low: np.ndarray, doc_id: np.ndarray, least_docs: int) -> np.ndarray:
        """Whether a line with this hash goes from this document."""
        at = self.index.slots(high, low)
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == low[ok]
        ok[ok] = (self.docs[at[ok]] >= least_docs) & (self.keeper[at[ok]] != doc_id[ok])
        return ok


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return ((high >> np.uint64(1)) % np.uint64(shards)).astype(np.int64)


# ---- tasks


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[str]]]]:
    """doc_ids and lines of some documents at a time."""
    for batch in common.pieces(batches, "text", 1 << 20):
        yield batch.column("doc_id").to_pylist(), [(x or "").split("\n") for x in batch.column("text").to_pylist()]


def _halves(found: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.array(found, np.uint64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _counted(least_chars: int):
    """Per hash: documents, largest doc_id, of what a task has read."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[int]] = {}

        def rows() -> pa.RecordBatch:
            high, low = _halves(list(held))
            values = np.array(list(held.values()), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([_signed(high), _signed(low), pa.array(values[:, 0]), pa.array(values[:, 1])], ["high", "low", "docs", "keeper"])

        for ids, texts in _documents(batches):
            for i, lines in zip(ids, texts, strict=True):
                i = NO_ID if i is None else i
                for x in set(hashes(lines, least_chars)) - {None}:
                    if x in held:
                        own = held[x]
                        own[0] += 1
                        own[1] = max(own[1], i)
                    else:
                        held[x] = [1, i]
            if len(held) > HELD:
                yield rows()
                held.clear()
        yield rows()

    return task


def _built(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    shard = Shard.of(rows["high"].to_numpy(np.int64).view(np.uint64), rows["low"].to_numpy(np.int64).view(np.uint64), rows["docs"].to_numpy(np.int64), rows["keeper"].to_numpy(np.int64))
    return pd.DataFrame({"shard": [key[0]], "arrays": [shard.packed()], "held": [int(rows["docs"].sum())]})


def _digests(ids: list, texts: list[list[str]], going: list[set[int]]) -> pa.RecordBatch:
    """Rows of the result."""
    kept = ["\n".join(x for i, x in enumerate(lines) if i not in out) for lines, out in zip(texts, going, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([len(x) for x in going], pa.int64()), pa.array(kept, pa.string())],
        ["doc_id", "n_lines", "n_dropped", "kept"],
    )


def _asked(texts: list[list[str]], least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, line, and both halves of the hash, of lines with long keys."""
    doc, line, found = [], [], []
    for d, lines in enumerate(texts):
        for i, x in enumerate(hashes(lines, least_chars)):
            if x is not None:
                doc.append(d)
                line.append(i)
                found.append(x)
    return np.array(doc, np.int64), np.array(line, np.int64), *_halves(found)


def _ids(ids: list) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in ids], np.int64)


def _probing(packed, shards: int, least_chars: int, least_docs: int):
    """Documents against arrays that every task has."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = {s: Shard.unpacked(x) for s, x in packed.value.items()}
        for ids, texts in _documents(batches):
            doc, line, high, low = _asked(texts, least_chars)
            going: list[set[int]] = [set() for _ in texts]
            at = shard_of(high, shards)
            for s, shard in arrays.items():
                own = np.flatnonzero(at == s)
                out = own[shard.goes(high[own], low[own], _ids(ids)[doc[own]], least_docs)]
                for d, i in zip(doc[out].tolist(), line[out].tolist(), strict=True):
                    going[d].add(i)
            yield _digests(ids, texts, going)

    return task


def _sent(shards: int, least_chars: int):
    """The hashes of each row's lines on their way to their shard."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text", 1 << 20):
            texts = [(x or "").split("\n") for x in batch.column("text").to_pylist()]
            own = [list(set(hashes(x, least_chars)) - {None}) for x in texts]
            times = [len(x) for x in own]
            high, low = _halves([x for y in own for x in y])
            row = np.repeat(np.array(batch.column("row").to_pylist(), np.int64), times)
            ids = np.repeat(_ids(batch.column("doc_id").to_pylist()), times)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(high, shards)), pa.array(row), pa.array(ids), _signed(high), _signed(low)], ["shard", "row", "doc_id", "high", "low"])

    return task


def _met(least_docs: int):
    def found(key: tuple, asked: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        hashed = asked[["row", "high", "low"]]
        if not len(asked) or not len(arrays):
            return hashed.iloc[:0]
        high, low = (asked[c].to_numpy(np.int64).view(np.uint64) for c in ("high", "low"))
        return hashed[Shard.unpacked(arrays["arrays"].iloc[0]).goes(high, low, asked["doc_id"].to_numpy(np.int64), least_docs)]

    return found


def _without(least_chars: int):
    """Documents with the hashes of the lines that go from them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text", 1 << 20):
            texts = [(x or "").split("\n") for x in batch.column("text").to_pylist()]
            gone = [{(x["high"] % (1 << 64), x["low"] % (1 << 64)) for x in found or ()} for found in batch.column("going").to_pylist()]
            going = [{i for i, x in enumerate(hashes(lines, least_chars)) if x in out} if out else set() for lines, out in zip(texts, gone, strict=True)]
            yield _digests(batch.column("doc_id").to_pylist(), texts, going)

    return task


# ---- the operator


def shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, observation: Observation | None = None) -> DataFrame:
    """Table (high, low, docs, keeper) of the keys that enough documents hold; `held` of the observation: how often documents hold any key.

    Tasks add up what they read before the shuffle."""
    counted = docs.select("doc_id", "text").mapInArrow(_counted(least_chars), "high long, low long, docs long, keeper long")
    summed = counted.groupBy("high", "low").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))
    if observation:
        summed = summed.observe(observation, F.sum("docs").alias("held"))
    return common.saved(summed.filter(F.col("docs") >= least_docs), "lines")


def index(lines: DataFrame, keys: int) -> tuple[DataFrame, int]:
    """Table (shard, arrays, held) of the shards, held: how often documents hold its keys; and how many shards there are."""
    shards = max(1, -(-keys // SHARD))
    dealt = lines.withColumn("shard", F.shiftrightunsigned("high", 1) % F.lit(shards).cast("long"))
    return common.saved(dealt.groupBy("shard").applyInPandas(_built, "shard long, arrays binary, held long"), "line-index"), shards


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, most_bytes: int = MOST_BYTES, probes: int = PROBES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without its shared lines)."""
    schema = "doc_id long, n_lines long, n_dropped long, kept string"
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    asked_in_all = Observation()
    lines = shared_lines(docs, least_chars, least_docs, asked_in_all)
    keys = lines.count()
    arrays, shards = index(lines, keys)
    common.discard(lines)
    if keys * KEY_BYTES <= most_bytes:
        packed = docs.sparkSession.sparkContext.broadcast({x.shard: bytes(x.arrays) for x in arrays.select("shard", "arrays").collect()})
        common.discard(arrays)
        return docs.mapInArrow(_probing(packed, shards, least_chars, least_docs), schema)
    # a shard's probes are those of its own keys and its part of all others
    other = (asked_in_all.get["held"] or 0) / shards
    arrays = arrays.withColumn("copies", F.ceil((F.col("held") + other) / probes).cast("int"))
    rows = common.saved(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    asked = rows.mapInArrow(_sent(shards, least_chars), "shard long, row long, doc_id long, high long, low long")
    dealt = asked.join(common.small(arrays.select("shard", "copies")), "shard").withColumn("copy", F.pmod(F.xxhash64("row"), F.col("copies")).cast("int")).drop("copies")
    copied = arrays.select("shard", "arrays", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    met = dealt.groupBy("shard", "copy").cogroup(copied.groupBy("shard", "copy")).applyInPandas(_met(least_docs), "row long, high long, low long")
    going = met.groupBy("row").agg(F.collect_list(F.struct("high", "low")).alias("going"))
    return rows.join(going, "row", "left").select("doc_id", "text", "going").mapInArrow(_without(least_chars), schema)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same by a join of lines.
OP13_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
told AS (SELECT d.doc_id, d.i, d.line, s.k IS NOT NULL AND d.doc_id <> s.keeper AS goes FROM keyed d LEFT JOIN shared s ON d.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""
