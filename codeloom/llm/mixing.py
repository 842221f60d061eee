"""Operator 8: mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, targets follow from the weights (no source above
`most` times its size), and each document is taken floor(rate) times plus one
further time if its seeded hash falls below the rate's fraction.

Defined cases: a null text has size 0 and is still returned; a null source is a
source of its own, last in order; repeated rows share their decision, since it
hangs on doc_id (and, where doc_id is null, on the text); an empty table gives
no rows; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Weights repeat over the sources by code point. A target is min(most * size,
    level * weight); each round sets the level from what the capped sources leave
    and ends when no further source is above its cap, which is resharing the
    excess until none is. Rounds are sums over the small table of sources; the
    driver sees scalars only.
    """
    partitions = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rank = common.ranked(sizes, "source", min(partitions, 200))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = common.saved(rank.select("source", "source_size", weight.alias("_weight"), (F.lit(float(most)) * F.col("source_size")).alias("_cap")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    want, level, capped = share * total, 0.0, -1
    while True:
        over = F.col("_cap") <= F.lit(level) * F.col("_weight")
        row = table.agg(
            F.count(F.when(over, 1)).alias("n"),
            F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if row["n"] == capped or not row["weight"]:
            break
        capped, level = row["n"], max(level, (want - row["full"]) / row["weight"])
    return table.select("source", "source_size", F.least(F.col("_cap"), F.lit(level) * F.col("_weight")).alias("target"))


def copies(rate: Column, key: Column, seed: int) -> Column:
    """floor(rate) copies, and one more with probability rate - floor(rate), from a hash of key and seed."""
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, seed: int = 8, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, text, source, _size, _source_size, _target and _copies; all other columns of docs in one struct `_extra`.

    The sums per source are combined before the shuffle, so a source with a third
    of all rows is one row per task there. The table of targets has one row per
    source and meets the documents by an equal join, which Spark splits where a
    source is hot.
    """
    sized = common.sealed(docs, "doc_id", "text", "source").withColumn("_size", common.word_count(F.col("text")))
    sums = common.saved(sized.groupBy("source").agg(F.sum("_size").alias("source_size")), "source-sums")
    targets = source_targets(sums, weights, share, most).select(
        F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target")
    )
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col("text"), F.lit(""))))
    return sized.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").withColumn("_copies", copies(rate, key, seed))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, in the columns of docs."""
    plan = mix_plan(docs, **options).filter(F.col("_copies") > 0)
    return common.opened(plan.select("doc_id", "text", "source", "_extra", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).drop("_copy"), docs)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_plan(docs).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )
