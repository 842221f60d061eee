"""All queries of the graph engine, and their SQL."""

from __future__ import annotations

from codeloom.plans import source_queries  # noqa: F401  (registers its queries)
from codeloom.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
