"""Operator 11: how far the sources of a language diverge in the terms they use.

A group is a (lang, source); a kept term of a language occurs in at least
`least_docs` of its documents. A group gives a kept term of which it has `count`
the share p = 1 + floor(10**9 * (count + 1) / (N + V)), with N its counts' sum and
V the number of kept terms; the language has shares likewise. Of two shares,
f(p, q) = floor((p - q)**2 / q). A pair of groups has the sum of f over all kept
terms; a group's terms above the language's share have f each.

Sums over pairs are split by how many of a language's G groups use a term.

* Heavy terms, of at least G / 4 groups: blocks of terms become dense matrices of
  shares (numpy), which sum f for all pairs of groups.
* Light terms: every pair starts as if no group used the term (one f of the two
  zero shares, times the number of light terms); a group's own counts, as
  (share, how many terms), then correct its pairs with every other group, and
  pairs of postings of one term correct what two groups share.

Both partial sums are of integers and add up exactly. Shares stay below 10**9 + 2,
so squares fit 64 bits; counts are multiplied as decimals.

Defined cases: null text, lang and source are ''; every row is a document, so
repeated rows count each; a group without terms has zero shares; where no term is
kept, pairs have value 0; ties in a rank go by item, as UTF-8; texts of any length
are cut into terms one at a time; an empty table gives no rows; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAST_DOCS, TOP = 3, 200
#: A term used by one group in so many is heavy: a pair of postings costs a join's row, some 16 cells of a matrix.
HEAVY = 4
#: Terms of a tile at least, cells of a tile at most, groups whose pairs a tile sums.
TERMS, CELLS, ROWS = 256, 4 << 20, 256
#: Parts that a group's terms are ranked in before they are ranked together.
SALTS = 16
#: Different terms that a task counts before it passes them on.
HELD = 250_000
#: Bytes of a text to bytes of terms: A-Z as a-z, other ASCII as blanks.
_TERMS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and other signs above ASCII, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group and term: occurrences, documents. A group's row without a term says that the group occurs."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in groups.items():
            terms = pa.array([b"", *n], pa.binary()).cast(pa.string())
            columns = [pa.array([x] * len(terms)) for x in (lang, source)] + [terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *(d[t] for t in n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    for batch in common.pieces(batches, "text", 4 << 20):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, d = groups.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), Counter(terms_of(text))
            n.update(own)
            d.update(own.keys())
            held += len(n) - before
        if held > HELD:
            yield from rows()
            groups, held = {}, 0
    yield from rows()


def _share(n: str, total: str, kept: str) -> Column:
    """p of n occurrences; null where no term is kept."""
    times = f"cast(1000000000 as decimal(10,0)) * cast({n} + 1 as decimal(20,0))"
    return F.expr(f"case when {kept} > 0 then 1 + ({times}) div cast({total} + {kept} as decimal(20,0)) end")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _per_tile(groups: Column) -> Column:
    """Terms of a tile of a language with so many groups."""
    return F.greatest(F.lit(64), F.least(F.greatest(F.lit(TERMS), groups), F.floor(F.lit(CELLS) / groups))).cast("long")


def _tile(key: tuple, shares: pd.DataFrame, zero: pd.DataFrame) -> pd.DataFrame:
    """Sums of f over the terms of a tile, for the groups of its rows against all others."""
    lang, _, rows = key
    zero = zero.sort_values("g")
    p0 = zero["p0"].to_numpy(np.int64)
    term, names = pd.factorize(shares["term"])
    p = np.repeat(p0[None, :], len(names), 0)
    p[term, shares["g"].to_numpy(np.int64)] = shares["p"].to_numpy(np.int64)
    at = np.arange(rows * ROWS, min((rows + 1) * ROWS, len(p0)))
    sums = np.zeros((len(at), len(p0)), np.int64)
    step = max(1, (1 << 20) // len(p0))
    for first in range(0, len(names), step):
        q = p[first : first + step]
        for i, a in enumerate(at):
            d = q[:, a : a + 1] - q
            sums[i] += (d * d // q).sum(0)
    a, b = np.repeat(at, len(p0)), np.tile(np.arange(len(p0)), len(at))
    return pd.DataFrame({"lang": lang, "a": a, "b": b, "value": sums.ravel()})[a != b]


def counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Table (lang, source, term, n, total, users, first): kept terms by group, and a row with term '' per group.

    total and users are the language's occurrences and groups of the term; first
    marks one row per term. Tasks add up their own counts before the one shuffle,
    by language and term, so a term of every document is a row per task and group.
    """
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    term = Window.partitionBy("lang", "term")
    summed = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    wide = summed.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("total"), F.count("*").over(term).alias("users"), (F.min("source").over(term) == F.col("source")).alias("first"))
    return common.saved(wide.filter((F.col("docs") >= least_docs) | (F.col("term") == "")).drop("docs"), "terms")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Documents -> lang, source, part ('pair' or 'term'), item, value, rank."""
    table = counts(docs, least_docs)
    kept = table.filter(F.col("term") != "")
    sizes = table.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    by_lang = sizes.groupBy("lang").agg(F.count("*").alias("groups"), F.sum("size").alias("all_size"))
    heavy = F.col("users") * HEAVY >= F.col("groups")
    first = kept.filter("first").join(common.small(common.saved(by_lang, "languages")), "lang")
    terms = first.groupBy("lang").agg(F.count("*").alias("v"), F.count(F.when(heavy, 1)).alias("v_heavy"))
    langs = by_lang.join(terms, "lang", "left").fillna(0, ["v", "v_heavy"])
    numbered = sizes.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = numbered.join(langs, "lang").select("*", _share("0", "size", "v").alias("p0"))
    groups = common.small(common.saved(groups, "groups"))

    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "g", "term", "groups", "v_heavy", "p0", heavy.alias("heavy"), _share("n", "size", "v").alias("p"), _share("total", "all_size", "v").alias("q"))
    shares = common.saved(shares, "shares")
    common.discard(table)
    return _pairs(shares, groups).unionByName(_terms(shares, top))


def _terms(shares: DataFrame, top: int) -> DataFrame:
    """The terms that a group uses more than its language, the first in two steps: each task and part passes on `top` at most."""
    found = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value"), F.pmod(F.xxhash64("term"), F.lit(SALTS)).alias("salt"))
    order = (F.col("value").desc(), F.col("item"))
    part = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    whole = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).filter(F.col("rank") <= top)
    return whole.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """The sums of f for all pairs of groups of a language."""
    one = groups.select("lang", F.col("g").alias("a"), F.col("p0").alias("pa"), (F.col("v") - F.col("v_heavy")).alias("light"))
    two = groups.select("lang", F.col("g").alias("b"), F.col("p0").alias("pb"))
    none = one.join(two, "lang").filter("a != b").select("lang", "a", "b", F.coalesce(_apart("pa", "pb") * F.col("light"), F.lit(0)).alias("value"))

    light = shares.filter(~F.col("heavy")).select("lang", "term", "g", "p", "p0")
    own = light.groupBy("lang", "g", "p", "p0").agg(F.count("*").alias("n")).join(two, "lang").filter("g != b")
    single = own.select("lang", F.explode(F.array(
        F.struct(F.col("g").alias("a"), F.col("b"), ((_apart("p", "pb") - _apart("p0", "pb")) * F.col("n")).alias("value")),
        F.struct(F.col("b").alias("a"), F.col("g").alias("b"), ((_apart("pb", "p") - _apart("pb", "p0")) * F.col("n")).alias("value")),
    )).alias("x")).select("lang", "x.*")
    posted = light.select("lang", "term", F.col("g").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("za"))
    other = light.select("lang", "term", F.col("g").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("zb"))
    both = posted.join(other, ["lang", "term"]).filter("a != b").select("lang", "a", "b", (_apart("pa", "pb") - _apart("pa", "zb") - _apart("za", "pb") + _apart("za", "zb")).alias("value"))

    tiles = F.ceil(F.col("v_heavy") / _per_tile(F.col("groups"))).cast("long")
    rows = F.explode(F.sequence(F.lit(0), F.floor((F.col("groups") - 1) / ROWS).cast("int"))).alias("rows")
    dense = shares.filter("heavy").select("lang", F.pmod(F.xxhash64("term"), tiles).alias("tile"), "groups", "term", "g", "p").select("*", rows).drop("groups")
    zero = groups.filter("v_heavy > 0").select("lang", "g", "p0", "groups", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("tile")).select("*", rows).drop("groups")
    key = ("lang", "tile", "rows")
    tiled = dense.groupBy(*key).cogroup(zero.groupBy(*key)).applyInPandas(_tile, "lang string, a int, b int, value long")

    sums = none.unionByName(single).unionByName(both).unionByName(tiled).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    named = sums.join(groups.select("lang", F.col("g").alias("a"), "source"), ["lang", "a"]).join(groups.select("lang", F.col("g").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents").select("lang", "source", "text"))


#: The same by plain joins: every pair of groups meets at every kept term.
OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
tokens AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
terms AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
used AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM tokens t JOIN terms k ON t.lang = k.lang AND t.term = k.term GROUP BY 1, 2, 3),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM terms GROUP BY lang),
groups AS (SELECT g.lang, g.source, coalesce(sum(u.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN used u ON g.lang = u.lang AND g.source = u.source GROUP BY 1, 2),
shares AS (
  SELECT g.lang, g.source, t.term, coalesce(u.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 1)) // (g.n + s.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (t.n + 1)) // (s.n + s.v)::HUGEINT AS q
  FROM groups g JOIN terms t ON g.lang = t.lang JOIN sizes s ON g.lang = s.lang LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = t.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
found AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM found))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
