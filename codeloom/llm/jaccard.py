"""Operator 4: self join by Jaccard index of shingle sets, size-aware, with classes of linked documents.

A document's set is its distinct shingles of four words (A-Z lower-cased, words
`[^\\x20\\x09-\\x0D]+`; the whole sequence where there are fewer). Two documents link
when 100 * intersection >= 85 * union.

Equal sets are one node. Light nodes (at most x shingles) enumerate their subsets
of the size that a partner of each possible size must share: nodes of fitting sizes
that meet in a subset are linked, no check needed. Heavier nodes go through
inverted lists: of the s shingles, the s - ceil(0.85 s) + 1 first in one global
order, of which linked sets share at least one. The order is by hash, with shingles
that are frequent in some chunk of documents last, which keeps lists short; any
order is correct. The boundary x costs least over the histogram of small sizes.

Lists are worked off without all pairs. The members of a long list are checked
against a pivot. Where it still spans several classes and has more pairs of members than
these have shingles (so a join would cost more than a scan), the members are told
apart by what they differ in from that pivot p: of x and y, |x ^ y| follows from
|x ^ p|, |y ^ p| and how much these two differences share, so unlinked members meet
in a prefix of their differences. These make new, shorter lists, which are worked
off in the same way. Other lists are joined with themselves, across classes, unless
a bound rules a link out: what two sets share of the prefix that ends first lies in
both prefixes, so the lists that they share, and the rest of that set, bound the
intersection. So classes are exact. Lists are dealt out in bounded chunks, and a
pivot's members in bounded lots.

Hashes of shingles have 64 bits, names of sets 128. Defined cases: texts without
words have n_shingles 0 and no links; a null doc_id has no name to be linked by:
such rows keep their n_shingles and have a null component_id; repeated rows give
repeated results; an empty table no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, PERCENT = 4, 85
#: Shingles in one chunk of counting; sets of a chunk that must share a shingle for it to be counted; counts that make it
#: frequent; how many are kept at most. They only shorten lists: any choice gives the same links.
CHUNK, COUNTED, FREQUENT_LEAST, FREQUENT = 1_500_000, 2, 6, 65_536
#: Largest light size considered; weight of a posting of a heavy set against one of a subset.
LIGHTEST, POSTING_COST = 16, 4.0
#: Members of a lot or of a chunk of a list at most; rows of fixed width (some 60 bytes) that are broadcast at most.
LOT, BROADCAST_ROWS = 2000, 100_000
#: Members from which a list gets a pivot; how often differences are taken (of differences, if more than once) before lists are joined whatever their length.
STAR_LEAST, LEVELS = 16, 1
#: Bytes of texts or sets that a task works on at once; bytes of a text that are hashed at once (and the rest of the last word).
PIECE, BLOCK = 2_000_000, 1 << 16

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))
#: What is kept of eight bytes (the first is the lowest) of which so many belong to a word.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def need(a: int, b: int, percent: int = PERCENT) -> int:
    """Least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (-(-percent * n // 100)) + 1


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending, without repeats."""
    values = np.sort(values)
    return values[_starts(values)]


def _starts(ascending: np.ndarray) -> np.ndarray:
    """Whether each is the first of its value."""
    out = np.ones(len(ascending), bool)
    np.not_equal(ascending[1:], ascending[:-1], out=out[1:])
    return out


_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits that isn't linear in any arithmetic."""
    x = x ^ (x >> np.uint64(32))
    x *= _A
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space.

    A word is cut into numbers of eight bytes; each is scrambled, moved by its place
    in the word and scrambled again, and a word's numbers and length are added up.
    Texts are worked on in blocks of whole words.
    """
    out, low = [], 0
    while low < len(text):
        cut = _SPACE.search(text, min(len(text), low + BLOCK))
        high = cut.start() if cut else len(text)
        block = np.frombuffer(text, np.uint8, high - low, low)
        low = high
        inside = np.concatenate([[False], ~_IS_SPACE[block], [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        if not len(turns):
            continue
        first, size = turns[::2], turns[1::2] - turns[::2]
        padded = np.concatenate([block, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(block),), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        total = _scrambled(_scrambled(eights[first] & _KEEP[np.minimum(size, 8)]))
        long = np.flatnonzero(size > 8)
        if len(long):
            numbers = (size[long] - 1) >> 3
            starts = np.cumsum(numbers) - numbers
            place = np.arange(1, starts[-1] + numbers[-1] + 1) - np.repeat(starts, numbers)
            left = np.minimum(np.repeat(size[long], numbers) - 8 * place, 8)
            mixed = _scrambled(_scrambled(eights[np.repeat(first[long], numbers) + 8 * place] & _KEEP[left]) + place.astype(np.uint64) * _C)
            total[long] += np.add.reduceat(mixed, starts)
        out.append(_scrambled(total + size.astype(np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a text's shingles. bytes.lower() knows ASCII only, as asked."""
    h = word_hashes(text.lower())
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), np.uint64)
    for i in range(min(words, len(h))):
        out = (out ^ h[i : i + n]) * _A
        out ^= out >> np.uint64(29)
    out *= _B
    out ^= out >> np.uint64(32)
    return distinct(out)


def name_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _keys_task(words: int):
    """Rows of documents (doc_id, n, key), and among them rows of frequent shingles (token, times)."""

    def frequent(chunk: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        values = np.sort(np.concatenate(list(chunk.values())))
        at = np.flatnonzero(_starts(values))
        values, times = values[at], np.diff(at, append=len(values))
        often = times >= COUNTED
        k = int(often.sum())
        return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(values[often].view(np.int64)), pa.array(times[often].astype(np.int64))], ["doc_id", "n", "key", "token", "times"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: dict[bytes, np.ndarray] = {}
        held = 0
        for batch in common.pieces(common.freed(batches), "text", PIECE):
            sizes, keys = [], []
            for text in _texts(batch):
                s = shingles(text, words)
                sizes.append(len(s))
                keys.append(name_of(s) if len(s) else None)
                if len(s) and keys[-1] not in chunk:
                    chunk[keys[-1]] = s
                    held += len(s)
                    if held >= CHUNK:
                        yield frequent(chunk)
                        chunk, held = {}, 0
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], ["doc_id", "n", "key", "token", "times"])
        if chunk:
            yield frequent(chunk)

    return task


def light_keys(s: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(subset, kind) of a light set: for each size a partner may have, the subsets that it must share; kind 1: equal sizes, 2: two sizes."""
    n, out = len(s), []
    for t in range(-(-percent * n // 100), 100 * n // percent + 1):
        share = need(n, t, percent)
        if share > min(n, t) or t < 1:
            continue
        head = np.array([min(n, t), max(n, t)], np.uint64)
        for part in itertools.combinations(range(n), share):
            out.append((xxhash.xxh3_64_intdigest(head.tobytes() + s[list(part)].tobytes()), 1 if n == t else 2))
    return out


def light_cost(n: int, percent: int = PERCENT) -> int:
    return sum(math.comb(n, need(n, t, percent)) for t in range(max(1, -(-percent * n // 100)), 100 * n // percent + 1) if need(n, t, percent) <= min(n, t))


def boundary(histogram: dict[int, int], percent: int = PERCENT) -> int:
    """The light size x of least cost: subsets of sets up to x, postings of the others and of those near x that may meet them."""

    def cost(x: int) -> float:
        lowest = -(-percent * (x + 1) // 100)
        return sum(k * ((light_cost(n, percent) if n <= x else 0) + (POSTING_COST * prefix_length(n, percent) if n >= lowest else 0)) for n, k in histogram.items())

    return min(range(1, LIGHTEST + 1), key=cost)


#: Postings, by level: at level 0 differences are the sets themselves.
_POSTED = "token long, salt int, key binary, n int, kind int, last int"
_DIFFERENCES = "grp long, token long, salt int, key binary, n int, d int, at int, rest int, last int"


def _columns(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for (_, k), c in zip(names, columns, strict=True)], [n for n, _ in names])


def _repeated(keys: list[bytes], times: list[int]) -> pa.Array:
    return pa.array(keys, pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), times)))


def _postings_task(frequent: np.ndarray, shares: np.ndarray, light: int, words: int, percent: int):
    """Postings of subsets (kind 1, 2) and prefixes (kind 0). A frequent shingle's list is dealt out in `shares` parts by key (salt; else -1)."""
    lowest = -(-percent * (light + 1) // 100)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in common.pieces(common.freed(batches), "text", PIECE):
            tokens, salts, keys, times, columns = [], [], [], [], []
            for text in _texts(batch):
                s = shingles(text, words)
                key, n = name_of(s), len(s)
                if not n or key in seen:
                    continue
                if len(seen) >= 50_000:
                    seen.clear()
                seen.add(key)
                if n <= light and (parts := light_keys(s, percent)):
                    tokens.append(np.array([token for token, _ in parts], np.uint64))
                    salts.append(np.full(len(parts), -1, np.int32))
                    keys.append(key), times.append(len(parts))
                    columns += [np.array([(n, kind, 0) for _, kind in parts], np.int32)]
                if n >= lowest:
                    p = prefix_length(n, percent)
                    at = np.searchsorted(frequent, s)
                    often = frequent[np.minimum(at, len(frequent) - 1)] == s if len(frequent) else np.zeros(n, bool)
                    first = np.concatenate([s[~often], s[often]])[:p]
                    own = n - int(often.sum())
                    salt = np.full(p, -1, np.int32)
                    if own < p:
                        share = shares[at[often][: p - own]]
                        salt[own:] = np.where(share > 1, int.from_bytes(key[:4]) % share, -1)
                    tokens.append(first)
                    salts.append(salt)
                    keys.append(key), times.append(p)
                    columns.append(np.tile(np.array([[n, 0, (int(first[-1]) >> 34) + ((p > own) << 30)]], np.int32), (p, 1)))
            if tokens:
                n, kind, last = np.concatenate(columns).T
                yield _columns(_POSTED, np.concatenate(tokens).view(np.int64), np.concatenate(salts), _repeated(keys, times), n, kind, last)

    return task


def _halves(keys: pa.Array) -> np.ndarray:
    """Names of 16 bytes as rows of two numbers."""
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]
    return np.frombuffer(keys.buffers()[2], np.uint64, 2 * len(keys), int(offsets[0])).reshape(-1, 2)


def _lists_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (token, salt, key): no repeats, of shared tokens only; with the chunk of the list.

    Of the rows before, only the last is held. Parts of a list that is dealt out (salt >= 0) stay whole.
    """
    held, followed, place = None, False, 0
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        token, salt, name = batch.column("token").to_numpy(), batch.column("salt").to_numpy(), _halves(batch.column("key"))
        same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
        fresh = np.concatenate([[True], ~(same & (name[1:] == name[:-1]).all(1))])
        if not fresh.all():
            batch, token, salt = batch.filter(pa.array(fresh)), token[fresh], salt[fresh]
            same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
        after = np.concatenate([[followed], same])
        at = np.arange(len(token))
        starts = np.maximum.accumulate(np.where(after, 0, at))
        places = at - starts + np.where(starts == 0, place, 0) * (np.cumsum(~after) == (0 if followed else 1))
        keep = after[:-1] | same | (salt[:-1] >= 0)
        chunk = np.where(salt >= 0, salt, places // LOT).astype(np.int32)
        out = batch.append_column("chunk", pa.array(chunk))
        yield out.slice(0, len(token) - 1).filter(pa.array(keep))
        held, followed, place = batch.slice(len(token) - 1), bool(after[-1]), int(places[-1])
        if followed or salt[-1] >= 0:
            last = out.slice(len(token) - 1)
        else:
            last = None
    if held is not None and last is not None:
        yield last


def _listed(postings: DataFrame, schema: str, parts: int, name: str) -> DataFrame:
    by = [c for c in ("grp", "token", "salt") if c in postings.columns]
    dealt = postings.repartition(parts, *by).sortWithinPartitions("token", "salt", "key")
    return common.saved(dealt.mapInArrow(_lists_task, f"{schema}, chunk int").drop("salt"), name)


def _members_task(words: int):
    """(text, key, lot, role), rows of one text next to each other -> (lot, role, key, hashes), for the rows whose set is the one named."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, last, raw = "lot binary, role int, key binary, hashes binary", None, None
        for batch in common.pieces(common.freed(batches), "text", PIECE):
            out: list[tuple] = []
            for text, key, lot, role in zip(_texts(batch), *(batch.column(c).to_pylist() for c in ("key", "lot", "role")), strict=True):
                if last != (text, key):
                    s = shingles(text, words)
                    last, raw = (text, key), s.tobytes() if name_of(s) == key else None
                if raw is not None:
                    out.append((lot, role, key, raw))
            if out:
                yield _columns(schema, *zip(*out, strict=True))

    return task


def allowed(a: int, b: int, percent: int) -> int:
    """Most members by which linked sets of sizes a and b may differ, both ways together."""
    return (100 - percent) * (a + b) // (100 + percent)


def difference_prefix(n: int, d: int, pivot: int, percent: int) -> int:
    """How many first members of x ^ p (of size d; x and p of sizes n and `pivot`) meet those of any y not yet known to be linked with x.

    A link needs (d + |y ^ p| - allowed) / 2 shared members, and |y ^ p| is at least the difference of the sizes; least where y is nearest to p in size.
    """
    s = min(max(pivot, -(-percent * n // 100)), 100 * n // percent)
    least = -(-(d + abs(s - pivot) - allowed(n, s, percent)) // 2)
    return d - max(1, least) + 1


def _check_task(percent: int):
    """Rows in order of (lot, role): a lot's pivot, then its members -> linked (a, b)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = pivot = pivot_key = None
        for batch in common.pieces(batches, "hashes", PIECE):
            a, b = [], []
            for this, role, key, raw in zip(*(batch.column(c).to_pylist() for c in ("lot", "role", "key", "hashes")), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if role == 0:
                    lot, pivot, pivot_key = this, s, key
                elif this == lot:
                    both = len(np.intersect1d(pivot, s, assume_unique=True))
                    if 100 * both >= percent * (len(pivot) + len(s) - both):
                        a.append(pivot_key)
                        b.append(key)
            if a:
                yield _columns("a binary, b binary", a, b)

    return task


def _difference_task(percent: int):
    """The same rows -> postings of the members' differences from the pivot: what only they have first, then what only the pivot has."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = pivot = mix = None
        for batch in common.pieces(batches, "hashes", PIECE):
            tokens, keys, times, columns, groups = [], [], [], [], []
            for this, role, key, raw in zip(*(batch.column(c).to_pylist() for c in ("lot", "role", "key", "hashes")), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if role == 0:
                    lot, pivot, mix = this, s, np.frombuffer(key, np.uint64)[0]
                    # lots of a pivot with several of them stay apart until lists are counted
                    salt = int.from_bytes(lot[-4:]) - (1 << 30) if lot[-4] & 0x40 else -1
                elif this == lot:
                    own = np.setdiff1d(s, pivot, assume_unique=True)
                    lost = np.setdiff1d(pivot, s, assume_unique=True)
                    d = len(own) + len(lost)
                    p = difference_prefix(len(s), d, len(pivot), percent)
                    if p > 0 and d:
                        first = np.concatenate([own, lost])[:p]
                        token = (first ^ mix) * _A
                        token = (token ^ (token >> np.uint64(29))) * _B
                        tokens.append(token)
                        keys.append(key), times.append(p)
                        whole = np.tile(np.array([[salt, len(s), d, 0, d - p, (int(first[-1]) >> 34) + ((p > len(own)) << 30)]], np.int32), (p, 1))
                        whole[:, 3] = np.arange(p)
                        columns.append(whole)
                        groups.append(np.full(p, mix))
            if tokens:
                salts, n, d, at, rest, last = np.concatenate(columns).T
                yield _columns(_DIFFERENCES, np.concatenate(groups).view(np.int64), np.concatenate(tokens).view(np.int64), salts, _repeated(keys, times), n, d, at, rest, last)

    return task


def _met(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, task, schema: str) -> DataFrame:
    """pairs (pivot, key) -> what task makes of each pivot and its members. Sets are made again from the texts of the nodes in question."""
    n = pairs.groupBy("pivot").agg(F.count("*").alias("_n"))
    salted = pairs.join(n, "pivot").withColumn("_salt", F.pmod(F.xxhash64("key"), F.ceil(F.col("_n") / LOT)).cast("int") + F.when(F.col("_n") > LOT, 1 << 30).otherwise(0))
    salted = salted.withColumn("lot", F.concat("pivot", F.unhex(F.lpad(F.hex(F.col("_salt")), 8, "0"))))
    heads = salted.select("lot", F.lit(0).alias("role"), F.col("pivot").alias("key")).distinct()
    places = heads.unionByName(salted.select("lot", F.lit(1).alias("role"), "key"))
    targets = common.saved(places.join(reps.select("key", F.col("rep").alias("doc_id")), "key"), "targets")
    members = docs.join(_small(targets), "doc_id").select("text", "key", "lot", "role").mapInArrow(_members_task(words), "lot binary, role int, key binary, hashes binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(parts, "lot").sortWithinPartitions("lot", "role").mapInArrow(task, schema)


def _earlier(own: Column, other: Column) -> Column:
    """Of two values, that of the set whose prefix ends first; the greater where they end together."""
    return F.when(F.col("last") < F.col("plast"), own).when(F.col("last") > F.col("plast"), other).otherwise(F.greatest(own, other))


def _shared_least(percent: int) -> Column:
    """Members that two differences share at least if their sets are linked."""
    allowed_ = F.floor((F.col("n") + F.col("pn")) * (100 - percent) / (100 + percent))
    return F.ceil((F.col("d") + F.col("pd") - allowed_) / 2)


def _possible(percent: int) -> Column:
    """Of two members of a list, whether they may be linked and aren't yet known to be."""
    return (
        (F.col("root") != F.col("proot"))
        & (F.col("n") * 100 >= F.col("pn") * percent)
        & (F.col("pn") * 100 >= F.col("n") * percent)
        & (_shared_least(percent) <= _earlier(F.col("most"), F.col("pmost")))
    )


_OTHER = ("n", "d", "at", "rest", "last", "most", "root")


def _small(df: DataFrame) -> DataFrame:
    """A saved table of rows of fixed width, to be broadcast if they are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _rooted(lists: DataFrame, roots: DataFrame) -> DataFrame:
    return lists.drop("root").join(_small(roots), F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node")


def _open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of lists that span several classes, with their classes, the lists' lengths and the sizes of their members together."""
    labelled = _rooted(lists.drop("m", "mass"), roots)
    chunks = labelled.groupBy("grp", "token", "chunk").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count("*").alias("_m"), F.sum("n").alias("_n"))
    spread = chunks.groupBy("grp", "token").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.sum("_m").alias("m"), F.sum("_n").alias("mass")).filter(F.col("_a") != F.col("_b"))
    places = chunks.select("grp", "token", "chunk").join(spread.select("grp", "token", "m", "mass"), ["grp", "token"])
    return common.saved(labelled.join(places, ["grp", "token", "chunk"]), "open-lists")


def _with_pivots(lists: DataFrame) -> DataFrame:
    """Each row with its list's pivot: the member with the fewest members of its own."""
    order = F.struct((F.col("d") - F.col("most")).alias("o"), "key", *_OTHER)
    chunks = lists.groupBy("grp", "token", "chunk").agg(F.min(order).alias("p"))
    best = chunks.groupBy("grp", "token").agg(F.min("p").alias("p"))
    places = chunks.select("grp", "token", "chunk").join(best, ["grp", "token"])
    places = places.select("grp", "token", "chunk", F.col("p.key").alias("pivot"), *[F.col(f"p.{c}").alias(f"p{c}") for c in _OTHER])
    return lists.join(places, ["grp", "token", "chunk"]).filter(F.col("key") != F.col("pivot"))


def _bounded(lists: DataFrame) -> DataFrame:
    """With `most`, which bounds what a member shares with one whose prefix ends later: its shared postings and what it didn't post."""
    listed = F.count("*").over(Window.partitionBy("grp", "key"))  # a set's own postings
    return lists.withColumn("most", F.col("rest") + listed)


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scanned = common.saved(docs.mapInArrow(_keys_task(words), "doc_id long, n int, key binary, token long, times long"), "keys")
    rows = scanned.filter(F.col("token").isNull()).select("doc_id", "n", "key")
    named = rows.filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    reps = common.saved(named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "sets")

    often = scanned.filter(F.col("token").isNotNull()).groupBy("token").agg(F.sum("times").alias("times")).filter(F.col("times") >= FREQUENT_LEAST)
    top = sorted((r["token"] % (1 << 64), r["times"]) for r in often.orderBy(F.desc("times"), "token").limit(FREQUENT).collect())
    frequent, shares = np.array([t for t, _ in top], np.uint64), np.array([1 + k // LOT for _, k in top], np.int64)
    small = reps.filter(F.col("n") <= 2 * LIGHTEST).groupBy("n").count().collect()  # one row a size
    light = boundary({r["n"]: r["count"] for r in small}, percent)

    postings = docs.filter(F.col("doc_id").isNotNull()).mapInArrow(_postings_task(frequent, shares, light, words, percent), _POSTED)
    lists = _listed(postings, _POSTED, parts, "lists")

    subsets = lists.filter(F.col("kind") > 0)
    stars = subsets.groupBy("token", "kind").agg(F.min("key").alias("a"), F.min("n").alias("_least"), F.max("n").alias("_most"))
    stars = stars.filter((F.col("kind") == 1) | (F.col("_least") < F.col("_most")))
    links = common.saved(subsets.join(stars, ["token", "kind"]).select("a", F.col("key").alias("b")).filter(F.col("a") != F.col("b")).distinct(), "links")

    rest = F.col("n") - (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    heavy = lists.filter(F.col("kind") == 0).select(F.lit(0).cast("long").alias("grp"), "token", "chunk", "key", "n", F.col("n").alias("d"), F.lit(0).alias("at"), rest.cast("int").alias("rest"), "last")
    level, used, left = common.saved(_bounded(heavy), "level"), [lists, links], []
    roots = components(links)

    def linked(pairs: DataFrame) -> None:
        nonlocal roots
        pairs = common.saved(pairs, "pairs")
        if not pairs.isEmpty():
            new = common.saved(_met(pairs, docs, reps, words, _check_task(percent), "a binary, b binary"), "links")
            if not new.isEmpty():
                before, roots = roots, components(new.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
                used.append(before)
            used.append(new)
        used.append(pairs)

    # differences cost a list the sizes of its members, a join their pairs
    costly = F.col("m") * F.col("m") > F.col("mass")
    for depth in range(LEVELS + 1):
        lengths = common.saved(level.groupBy("grp", "token").agg(F.count("*").alias("m"), F.sum("d").alias("mass")).filter((F.col("m") >= STAR_LEAST) & (costly if depth else F.lit(True))), "lengths")
        used += [level, lengths]
        if lengths.isEmpty():
            left.append(level)
            break
        long, by = _small(lengths), ["grp", "token"]
        left.append(level.join(long, by, "left_anti"))
        lists = _open(level.join(long.select(by), by, "left_semi"), roots)
        linked(_with_pivots(lists).filter(_possible(percent)).select("pivot", "key").distinct())
        open_ = _open(lists, roots)
        used += [lists, open_]
        apart = open_.filter(costly)
        if depth == LEVELS or apart.isEmpty():
            left.append(open_)
            break
        left.append(open_.filter(~costly))
        apart = common.saved(_with_pivots(apart).select("pivot", "key").distinct(), "pairs")
        differences = _met(apart, docs, reps, words, _difference_task(percent), _DIFFERENCES)
        found = _listed(differences, _DIFFERENCES, parts, "lists")
        level = common.saved(_bounded(found), "level")
        used += [apart, found]

    columns = ["grp", "token", "key", "n", "d", "at", "rest", "last", "most"]
    whole = left[0].select(columns)
    for more in left[1:]:
        whole = whole.unionByName(more.select(columns))
    whole = common.saved(_rooted(whole, roots), "left")
    other = whole.select("grp", "token", F.col("key").alias("pivot"), *[F.col(c).alias(f"p{c}") for c in _OTHER])
    # of differences, the first shared member leaves enough behind it; of sets, the lists that they share are counted below
    ahead = F.least(F.col("d") - F.col("at"), F.col("pd") - F.col("pat")) >= _shared_least(percent)
    pairs = whole.join(other, ["grp", "token"]).filter((F.col("pivot") < F.col("key")) & _possible(percent) & ((F.col("grp") == 0) | ahead))
    # sets of two classes meet in open lists only, and those that meet in a long one were resolved by differences: so all other lists that they share are counted
    wanted = F.when(F.col("grp") == 0, _shared_least(percent) - _earlier(F.col("rest"), F.col("prest"))).otherwise(0)
    shared = pairs.groupBy("grp", "pivot", "key").agg(F.count("*").alias("_shared"), F.first(wanted).alias("_wanted"))
    linked(shared.filter(F.col("_shared") >= F.col("_wanted")).select("pivot", "key").distinct())
    common.discard(*used, whole)

    classed = reps.join(roots, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    least = classed.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_key = classed.join(least, "root").select("key", "component_id")
    out = rows.join(of_key, "key", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents
), s AS (
  SELECT DISTINCT r, doc_id, unnest(list_transform(range(1, greatest(len(l) - 2, 2)), lambda i: array_to_string(list_slice(l, i, i + 3), ' '))) AS g FROM w WHERE len(l) > 0
), n AS (SELECT r, doc_id, count(*) AS k FROM s GROUP BY r, doc_id),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * i >= 85 * (x.k + y.k - i)),
c AS (SELECT r AS root, r FROM n UNION SELECT c.root, e.b FROM c JOIN e ON e.a = c.r),
m AS (SELECT c.root AS r, min(n.doc_id) AS component_id FROM c JOIN n ON n.r = c.r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.r = w.r LEFT JOIN m ON m.r = w.r
"""
