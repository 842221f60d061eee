"""Operator 12: a Merkle manifest of a dataset, kept as a store of nodes by level.

A leaf is the digest of a row's fields, each with its length. The leaves of one
source, by doc_id, are a tree: every 16 consecutive nodes of a level have one
parent, until one node is left, the subroot. The subroots, by source, are the
leaves of one more tree, whose last node is the root.

The store is a Parquet folder with a partition per level. Leaves are sorted once, by
ranges, and numbered: a node's coordinate is (tree, level, place). Then whole chunks
of 16**3 places, sorted, stream through tasks that hold 16 digests a level and write
the next three levels; the next pass reads the last of these in the same way. Passes
grow with the logarithm of the largest tree, and each reads 1/4096 of the one before.

Proofs are cut out from the top: the nodes of a chunk, of three levels, meet the
proof of the chunk's own root by coordinate, so what is shared above a chunk is
kept once a chunk and never written per leaf. A source with a third of all rows is
many chunks; no task holds more than one chunk.

Defined cases: null fields are `-` in a leaf; rows with a null source are a tree of
their own, the first; rows with null doc_ids come first in their tree and are never
tampered with; rows with one doc_id are ordered by their leaves, so repeated rows
have equal leaves side by side; texts of any length are digested whole, on the JVM;
an empty table has no rows and no root; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Children of a node are 2**FAN; a pass folds STEP levels.
FAN, STEP = 4, 3
CHUNK = FAN * STEP
#: Tree of the subroots.
TOP = -1
NODES = "level int, tree long, idx long, n long, digest string, item long, altered string"
#: before and after, from the leaf's level to the last: what stands left and right of a node among its siblings.
PROOFS = "tree long, idx long, digest string, item long, altered string, subroot string, proof array<string>"
FINAL = "item long, leaf string, subroot string, proof_sha256 string, folded_root string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold(leaf: str, proof: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for before, after in zip(proof[::2], proof[1::2], strict=True):
        leaf = digest(before, leaf, after)
    return leaf


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The leaf of a row."""
    fields = [c.cast("string") for c in (doc_id, source, lang, n_chars, text)]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in fields]).cast("binary"), 256)


def tampered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _numbered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with their number in the order of the keys: ranges are sorted apart, and shifted by the counts of those before."""
    table = common.saved(df.repartitionByRange(_parts(df.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    run = F.shiftright("_at", 33)
    before = F.sum("count").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    shifts = table.groupBy(run.alias("run")).count().select("run", (F.coalesce(before, F.lit(0)) - F.shiftleft("run", 33)).alias("_shift"))
    return table.join(F.broadcast(shifts), run == F.col("run")).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("number"))  # a row of shifts per partition


def _folded(base: int):
    """Sorted nodes of a level, whole chunks of them -> the nodes of the next STEP levels (and those of level 0 themselves)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[list[str]] = [[] for _ in range(STEP)]
        for batch in batches:
            out: list[tuple] = []
            for tree, i, n, d, item, altered in zip(*(batch.column(c).to_pylist() for c in ("tree", "idx", "n", "digest", "item", "altered")), strict=True):
                if base == 0:
                    out.append((0, tree, i, n, d, item, altered))
                for k in range(STEP):
                    if n == 1:
                        break
                    open_[k].append(d)
                    if i & 15 != 15 and i != n - 1:
                        break
                    d = digest(*open_[k])
                    open_[k] = []
                    i, n = i >> FAN, -(-n >> FAN) if n & 15 == 0 else (n >> FAN) + 1
                    out.append((base + k + 1, tree, i, n, d, None, None))
            if out:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["level", "tree", "idx", "n", "digest", "item", "altered"])

    return task


def _after(n: Column, levels: int) -> Column:
    """Nodes that are left of n after so many levels."""
    return F.floor((n + F.lit((1 << FAN * levels) - 1)) / F.lit(1 << FAN * levels)).cast("long") if FAN * levels < 62 else F.lit(1).cast("long")


def passes(most: int) -> int:
    """Passes over trees of at most so many leaves."""
    n = 1
    while most > 1 << CHUNK:
        most, n = -(-most // (1 << CHUNK)), n + 1
    return n


def store(leaves: DataFrame, most: int, path: str) -> DataFrame:
    """Write the nodes above `leaves` (tree, idx, n, digest, item, altered), and themselves, to a folder by level; trees have at most `most` leaves."""
    spark = leaves.sparkSession
    level = leaves
    for j in range(passes(most)):
        runs = level.repartitionByRange(_parts(spark), F.col("tree"), F.shiftright("idx", CHUNK)).sortWithinPartitions("tree", "idx")
        with common.small_batches(spark):
            runs.mapInArrow(_folded(j * STEP), NODES).write.mode("append").partitionBy("level").parquet(path)
        nodes = spark.read.schema(NODES).parquet(path)
        level = nodes.filter((F.col("level") == (j + 1) * STEP) & (F.col("n") > 1)).drop("level")
    return spark.read.schema(NODES).parquet(path)


def roots(nodes: DataFrame) -> DataFrame:
    """(tree, digest) of each tree's last node: the lone one of its level."""
    return nodes.filter("n = 1").select("tree", F.col("digest").alias("subroot"))


def _proven(base: int, final: bool):
    """A chunk's nodes of STEP levels and the proof of its root -> the proof of each node of the base level."""

    def task(key: tuple, nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        up = list(above["proof"].iloc[0])
        levels: list[dict[int, str]] = [{} for _ in range(STEP)]
        for k, i, n, d in zip(nodes["level"], nodes["idx"], nodes["n"], nodes["digest"], strict=True):
            if n > 1:
                levels[k - base][i] = d
        higher: dict[int, list[str]] = {}

        def sides(k: int, i: int) -> list[str]:
            run = [j for j in range(i >> FAN << FAN, ((i >> FAN) + 1) << FAN) if j in levels[k]]
            return ["".join(levels[k][j] for j in run if j < i), "".join(levels[k][j] for j in run if j > i)]

        def from_(k: int, i: int) -> list[str]:
            if k == STEP or i not in levels[k]:
                return up
            if k == 0:
                return sides(k, i) + from_(1, i >> FAN)
            if (at := i << 2 | k) not in higher:
                higher[at] = sides(k, i) + from_(k + 1, i >> FAN)
            return higher[at]

        rows = nodes[nodes["level"] == base]
        proofs = [from_(0, i) for i in rows["idx"]]
        subroot = above["subroot"].iloc[0]
        if not final:
            return pd.DataFrame({"tree": key[0], "idx": rows["idx"], "digest": rows["digest"], "item": rows["item"], "altered": rows["altered"], "subroot": subroot, "proof": proofs})
        leaf = [a or d for a, d in zip(rows["altered"], rows["digest"], strict=True)]
        return pd.DataFrame({"item": rows["item"], "leaf": rows["digest"], "subroot": subroot, "proof_sha256": [digest(*p) for p in proofs], "folded_root": [fold(x, p) for x, p in zip(leaf, proofs, strict=True)]})

    return task


def proofs(nodes: DataFrame, tops: DataFrame, most: int, final: bool = False) -> DataFrame:
    """The proofs of all leaves of a store. tops: (tree, leaves, subroot, proof), the proof of each tree's last node."""
    above = None
    for j in reversed(range(passes(most))):
        base = j * STEP
        ends = (_after(F.col("leaves"), base + STEP) == 1) & (F.lit(j == 0) | (_after(F.col("leaves"), base) > 1))
        own = tops.filter(ends).select("tree", F.lit(0).cast("long").alias("chunk"), "subroot", "proof")
        above = own if above is None else own.unionByName(above.select("tree", F.col("idx").alias("chunk"), "subroot", "proof"))
        within = nodes.filter((F.col("level") >= base) & (F.col("level") < base + STEP) & ((F.col("n") > 1) | F.lit(j == 0) & (F.col("level") == 0)))
        chunk = F.expr(f"shiftright(idx, {FAN} * ({base + STEP} - level))")
        last = final and j == 0
        above = within.withColumn("chunk", chunk).groupBy("tree", "chunk").cogroup(above.groupBy("tree", "chunk")).applyInPandas(_proven(base, last), FINAL if last else PROOFS)
        if not last:
            above = common.saved(above, "proofs")
    return above


def manifest(docs: DataFrame, path: str | None = None, altered: Column | None = None) -> tuple[DataFrame, str | None]:
    """(doc_id, leaf, subroot, proof_sha256, folded_root) of each row, and the root.

    path: folder for the two stores, sources/ and top/. altered: the leaf to fold in
    place of a row's own, where it isn't null.
    """
    spark = docs.sparkSession
    path = path or f"{common.shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    own = leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text"))
    # sources by bytes, null first
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("."), F.col("source").cast("string")))
    rows = common.saved(docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("item"), own.alias("digest"), (F.lit(None) if altered is None else altered).cast("string").alias("altered")), "leaves")
    numbered = _numbered(rows, "key", "item", "digest")
    trees = common.saved(numbered.groupBy("key").agg(F.min("number").alias("tree"), F.count("*").alias("n")), "trees")
    sources, most = trees.agg(F.count("*"), F.max("n")).first()
    if not sources:
        return spark.createDataFrame([], FINAL).withColumnRenamed("item", "doc_id"), None
    placed = numbered.join(common.small(trees), "key").select("tree", (F.col("number") - F.col("tree")).alias("idx"), "n", "digest", "item", "altered")
    nodes = store(placed, most, f"{path}/sources")

    ordered = _numbered(trees.join(roots(nodes), "tree").select("tree", F.col("n").alias("leaves"), "subroot"), "tree")
    ordered = common.saved(ordered, "subroots")
    top = store(ordered.select(F.lit(TOP).cast("long").alias("tree"), F.col("number").alias("idx"), F.lit(sources).cast("long").alias("n"), F.col("subroot").alias("digest"), F.col("tree").alias("item"), F.lit(None).cast("string").alias("altered")), sources, f"{path}/top")
    root = roots(top).first()["subroot"]
    start = spark.range(1).select(F.lit(TOP).cast("long").alias("tree"), F.lit(sources).cast("long").alias("leaves"), F.lit(root).alias("subroot"), F.array().cast("array<string>").alias("proof"))
    tops = proofs(top, start, sources).select(F.col("item").alias("tree"), F.col("digest").alias("subroot"), "proof").join(ordered.select("tree", "leaves"), "tree")
    return proofs(nodes, tops, most, final=True).withColumnRenamed("item", "doc_id"), root


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose doc_id has a crc32 that 5 divides are tampered with."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), tampered(F.col("text")))
    rows, root = manifest(docs, altered=F.when(hit, changed))
    return rows.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def _sql(levels: int = 6) -> str:
    """The same level by level, for trees of at most 16**levels leaves."""

    def tree(name: str, first: str) -> str:
        out = f"{name}0 AS ({first})"
        for k in range(levels):
            out += f",\n{name}{k + 1} AS (SELECT tree, idx // 16 AS idx, (n + 15) // 16 AS n, sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM {name}{k} WHERE n > 1 GROUP BY tree, idx // 16, n)"
            out += f",\n{name}s{k} AS (SELECT a.tree, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY 1, 2)"
        return out + f",\n{name}r AS (" + " UNION ALL ".join(f"SELECT tree, digest FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
    steps = [(f"t{k}", f"ts{k}", "l.tree", f"l.idx // {16**k}") for k in range(levels)] + [(f"u{k}", f"us{k}", "0", f"l.tree // {16**k}") for k in range(levels)]
    joins = " ".join(f"LEFT JOIN {table} {a} ON {a}.tree = {t} AND {a}.idx = {i}" for a, table, t, i in steps)
    proof = " || ".join(f"coalesce({a}.l || {a}.r, '')" for a, *_ in steps)
    chain, before = "", "l"
    for k, (a, *_) in enumerate(steps):
        chain += f",\nf{k} AS (SELECT * EXCLUDE (x), CASE WHEN {a}l IS NULL THEN x ELSE sha256({a}l || x || {a}r) END AS x FROM {before})"
        before = f"f{k}"
    sides = ", ".join(f"{a}.l AS {a}l, {a}.r AS {a}r" for a, *_ in steps)
    return f"""
WITH docs AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {leaf("text")} AS digest, {crc} AS crc,
         {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS lowered, source FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM docs),
{tree("t", "SELECT tree, idx, n, digest FROM leaves")},
{tree("u", "SELECT 0 AS tree, tree AS idx, count(*) OVER () AS n, digest FROM tr")},
l AS (SELECT l.doc_id, l.tree, l.digest AS leaf, CASE WHEN l.crc % 5 = 0 THEN l.lowered ELSE l.digest END AS x, sha256({proof}) AS proof_sha256, {sides} FROM leaves l {joins}){chain}
SELECT f.doc_id, f.leaf, s.digest AS subroot, r.digest AS root, f.proof_sha256, f.x AS folded_root, f.x = r.digest AS verified
FROM {before} f JOIN tr s ON f.tree = s.tree CROSS JOIN ur r
"""


OP12_SQL = _sql()
