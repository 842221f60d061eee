"""A corpus pipeline of five stages; each works on all that the one before it kept.

quality: documents that the classifier rejects go. near_duplicates: of each class of
documents linked by a similarity of 0.8 or more on five words, the one with the least
doc_id stays. secrets: secrets in texts are
replaced. mixing: documents are repeated or left out, to the sources' targets. bpe:
the texts' ids and their decoding, as digests.

Each stage's result is written as Parquet to the shared folder and read again. Stages
import their operators when they run.

In all stages null and empty texts are texts without words; very long texts are worked
on whole; an empty table gives an empty table; other columns, whatever their names, are
carried along, but for the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the weak-label model accepts. Repeated rows share their fate, as it hangs on the text alone; empty texts are judged like all others."""
    from codeloom.llm import quality

    return quality.keep(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per class; rows with one doc_id are one document (that of the least hash stays, then of the least text and other columns).

    Documents without words are linked with nothing. Null ids stay as they are.
    """
    from codeloom.llm import common, jaccard

    classes = jaccard.join(docs.select("doc_id", "text"), words=5, percent=80)
    first = classes.filter(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    inner = common.sealed(docs, "doc_id", "text")
    named = inner.filter(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi")
    order = F.struct(F.xxhash64("text"), "text", F.to_json(F.struct("_extra")))
    one = named.groupBy("doc_id").agg(F.min_by(F.struct("text", "_extra"), order).alias("_d")).select("doc_id", "_d.text", "_d._extra")
    return common.opened(one.unionByName(inner.filter(F.col("doc_id").isNull()).select("doc_id", "text", "_extra")), docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced and n_chars brought up to date; null texts stay null."""
    from codeloom.llm import secrets

    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as it is taken, by doc_id (by text where it is null), so repeated rows are taken alike; a null source is one of its own."""
    from codeloom.llm import mixing

    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, repeated ones too; a null text has no tokens."""
    from codeloom.llm import bpe

    return bpe.encode(docs.select("doc_id", "text"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express the stages; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm import common

    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
