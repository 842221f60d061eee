"""Edges as joins move them: ends as the bytes that their hex digits stand for, without ids that follow from the ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import scalars

#: Before texts that aren't 16 hex digits: with it they are longer than the eight bytes of those that are.
_MARK = bytes(9)
_OPEN = "unresolved:"


def key(ident: Column) -> Column:
    """A node id as bytes, another for each id: eight where it is 16 hex digits."""
    return F.when(ident.rlike("^[0-9a-f]{16}\\z"), F.unhex(ident)).otherwise(F.concat(F.lit(bytearray(_MARK)), ident.cast("binary")))


def text(packed: Column) -> Column:
    """The id of which packed is the key."""
    return F.when(F.length(packed) == 8, F.lower(F.hex(packed))).otherwise(F.substring(packed, len(_MARK) + 1, 2**30).cast("string"))


def _following() -> Column:
    target = F.col("target")
    end = F.when(target.startswith(_OPEN), F.substring(target, len(_OPEN) + 1, 2**30)).otherwise(target)
    return scalars.edge_id(F.col("source"), end, F.col("kind"))


def slim(edges: DataFrame) -> DataFrame:
    """source and target as keys; id null, and _follows true, where it follows from ends and kind."""
    if {"id", "kind"} <= set(edges.columns):
        edges = edges.withColumn("_follows", F.col("id").eqNullSafe(_following())).withColumn("id", F.when(~F.col("_follows"), F.col("id")))
    return edges.withColumns({c: key(F.col(c)) for c in ("source", "target")})


def whole(edges: DataFrame) -> DataFrame:
    """The edges of which these are the slim ones."""
    edges = edges.withColumns({c: text(F.col(c)) for c in ("source", "target")})
    if "_follows" in edges.columns:
        edges = edges.withColumn("id", F.when(F.col("_follows"), _following()).otherwise(F.col("id"))).drop("_follows")
    return edges


def keys(nodes: DataFrame, name: str) -> DataFrame:
    """(name): the keys of nodes (id)."""
    return nodes.select(key(F.col("id")).alias(name))


def between(edges: DataFrame, nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """Slim edges with both ends among nodes (id). parts: tasks that share either join; edges then stream past hashed nodes, so neither join sorts them, and lie by their targets at the end."""
    for end in ("source", "target"):
        known = keys(nodes, end)
        if parts is None:
            edges = edges.join(known, end, "left_semi")
        else:  # a semi join would be pushed below the move, and each part of a union moved again
            edges = edges.repartition(parts, end).join(known.repartition(parts, end).distinct().hint("shuffle_hash"), end)
    return edges
