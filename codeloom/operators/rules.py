"""Dependency rules: which paths must not depend on which (an extension; SURVEY 2.11).

A rule is a pair of globs. Globs are cut after their last whole segment without a
wildcard; paths meet them by an equal join on their own leading segments, one row per
level, and only those that share this stem are tested against the whole glob. An edge
breaks a rule where its source meets the first glob and its target the second, which
is again an equal join, on path and rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators import slim
from codeloom.plans import loops
from codeloom.schema import Graph
from codeloom.sources.listing import glob_regex


def stem(glob: str) -> str:
    """The leading segments without wildcards, but for the last segment of all; '' if there are none."""
    out: list[str] = []
    for segment in glob.split("/")[:-1]:
        if any(c in segment for c in "*?["):
            break
        out.append(segment)
    return "/".join(out)


def stems(path: Column) -> Column:
    """All leading parts of a path, '' among them, the path itself not."""
    parts = F.split(path, "/")
    levels = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(F.size(parts) > 1, F.concat(F.array(F.lit("")), levels)).otherwise(F.array(F.lit("")))


def met(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """(path), (rule, glob) -> (path, rule): which paths meet which rules' globs."""

    @F.udf("struct<stem: string, regex: string>")
    def compiled(glob: str):  # once per rule
        return stem(glob), f"^{glob_regex(glob)}$"

    keyed = loops.saved(globs.withColumn("_c", compiled("glob")).select("rule", F.col("_c.stem").alias("stem"), F.col("_c.regex").alias("regex")), "globs")
    climbed = paths.select("path", F.explode(stems(F.col("path"))).alias("stem"))
    return climbed.join(loops.small(keyed), "stem").filter(F.rlike("path", F.col("regex"))).select("path", "rule").distinct()


def violations(graph: Graph, rules: DataFrame) -> DataFrame:
    """rules (rule, source_glob, target_glob) -> rule, ord, id, source_path, target_path of each edge that breaks one."""
    paths = graph.nodes.select("id", "path")

    def nodes(end: str) -> DataFrame:
        """Nodes that meet a rule's glob at this end: only these meet the edges."""
        found = met(paths, rules.select("rule", F.col(f"{end}_glob").alias("glob")))
        return paths.join(found, "path").select(slim.key(F.col("id")).alias(end), F.col("path").alias(f"{end}_path"), "rule")

    begun = slim.slim(graph.edges.select("ord", "id", "source", "target", "kind")).join(nodes("source"), "source")
    return slim.whole(begun.join(nodes("target"), ["target", "rule"])).select("rule", "ord", "id", "source_path", "target_path")
