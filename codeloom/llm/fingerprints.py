"""Operator 5: bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a
text's shingles (five lower-cased words; the whole sequence where there are fewer).
Sketches of parts merge into the sketch of the whole, and estimate resemblance,
containment and the number of distinct shingles.

Defined cases: null and empty texts have the empty sketch; two empty sketches are
alike (1.0), an empty and another are not (0.0); equal texts have equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, WORDS = 128, 5
#: Documents dealt to one range by the query, and the most ranges it makes.
RANGE_ROWS, RANGES = 1000, 10_000


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """array<bigint>, ascending, at most k long."""
    parts = common.words_of(F.lower(text))

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + d) for d in range(words)]))

    each = common.bind(parts, lambda w: F.when(F.size(w) > 0, hashes(w)).otherwise(F.array().cast("array<bigint>")))
    return F.slice(F.sort_array(F.array_distinct(each)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what a and b were made from."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(df: DataFrame, column: str, *by: str, k: int = K) -> DataFrame:
    """(by..., column): the sketch of the union of each group's sketches; groups of empty sketches alone have the empty one.

    Hashes are made distinct across all tasks first; of these each task keeps its k
    smallest per group before they meet, so no task holds a group's sketches.
    """
    keys = [F.col(c) for c in by]
    hashes = df.select(*keys, F.explode(F.col(column)).alias("_hash")).distinct()
    place = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_hash"))
    least = hashes.withColumn("_place", place).filter(F.col("_place") <= k)
    sketches = least.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias("_sketch"))
    if not by:
        return sketches.select(F.col("_sketch").alias(column))
    same = [F.col(f"_g{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)]
    groups = df.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).distinct()
    every = groups.join(sketches, same, "left").select(*[F.col(f"_g{i}").alias(c) for i, c in enumerate(by)], F.col("_sketch"))
    return every.select(*keys, F.coalesce("_sketch", F.array().cast("array<bigint>")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's k smallest hashes that both hold: estimates the Jaccard index."""
    joint = merge(a, b, k)
    both = F.size(F.array_intersect(joint, F.array_intersect(a, b)))
    return F.when(F.size(joint) == 0, F.lit(1.0)).otherwise(both / F.size(joint))


def distinct_count(a: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below k, else (k - 1) over the k-th hash as a share of the range."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has: resemblance times the union's size over a's."""
    size = distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / size))


def as_string(a: Column) -> Column:
    """Sixteen hex digits for each hash, ascending."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _ranges(ids: DataFrame, rows: int, most: int) -> list[int]:
    """Ascending lower bounds of at most `most` ranges of about `rows` ids each; the driver gets no more than these."""
    low, high, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    if not n or low == high:
        return []
    wanted = min(most, -(-n // rows))
    at = [i / wanted for i in range(1, wanted)]
    if not at:
        return []
    found = ids.agg(F.percentile_approx("doc_id", at, max(10_000, 10 * wanted))).first()[0]
    return sorted({x for x in found if x > low})


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds not above key, by a search over two levels; null keys are before all."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    tops = F.array(*[F.lit(c[0]) for c in chunks])
    fine = F.array(*[F.array(*[F.lit(x) for x in c]) for c in chunks])
    which = F.size(F.filter(tops, lambda x: x <= key))
    inside = F.size(F.filter(F.element_at(fine, F.greatest(which, F.lit(1))), lambda x: x <= key))
    return F.when(key.isNull() | (which == 0), F.lit(0)).otherwise((which - 1) * step + inside)


def with_next(docs: DataFrame, rows: int = RANGE_ROWS, most: int = RANGES) -> DataFrame:
    """doc_id, text, sketch, and the next row's text and sketch (ascending doc_id, null first, equal ids by text; the last's next is the first).

    Texts are shuffled once, to ranges of ids. The first row of each range is also
    sent to the range before it, so that no window spans ranges.
    """
    bounds = _ranges(docs.select("doc_id"), rows, most)
    count = len(bounds) + 1
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_range", _range_of(F.col("doc_id"), bounds))
    firsts = placed.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"))).alias("_first"))
    firsts = firsts.select("_range", F.col("_first.doc_id").alias("_id")).collect()  # at most `most` rows
    filled = sorted(r["_range"] for r in firsts)
    if not filled:
        return placed.select("doc_id", "text", F.col("text").alias("next_text"), sketch(F.col("text")).alias("sketch"), sketch(F.col("text")).alias("next_sketch"))
    before = {r: filled[i - 1] for i, r in enumerate(filled)}
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    heads = [r["_id"] for r in firsts if r["_id"] is not None]
    # a null id can only be first of the first range
    is_first = F.col("doc_id").isin(heads) | F.col("doc_id").isNull() if any(r["_id"] is None for r in firsts) else F.col("doc_id").isin(heads)
    own = F.struct(F.col("_range").alias("r"), F.lit(False).alias("s"))
    guest = F.struct(F.element_at(to, F.col("_range")).alias("r"), F.lit(True).alias("s"))
    both = placed.withColumn("_to", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))))
    both = both.select("doc_id", "text", F.col("_to.r").alias("_range"), F.col("_to.s").alias("_guest"))
    line = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").asc_nulls_first(), "text")
    both = both.withColumn("next_text", F.lead("text").over(line)).withColumn("sketch", sketch(F.col("text")))
    return both.withColumn("next_sketch", F.lead("sketch").over(line)).filter(~F.col("_guest")).drop("_guest", "_range")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(common.table(spark, sf_dir, "documents"))
    cut = "int(floor(length(text) / 4))"
    docs = docs.withColumn("edited", F.expr(f"concat(left(text, length(text) - {cut}), left(next_text, {cut}))"))
    docs = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("sketch").alias("_own"), sketch(F.col("edited")).alias("_edited"), F.col("next_sketch").alias("_next"))
    return docs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("_own")).alias("fingerprint"),
        as_string(F.col("_edited")).alias("edited_fingerprint"),
        resemblance(F.col("_own"), F.col("_edited")).alias("near_edited"),
        resemblance(F.col("_own"), F.col("_next")).alias("near_next"),
    )
