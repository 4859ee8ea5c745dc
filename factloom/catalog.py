"""Registered queries and their equivalents in SQL."""

from __future__ import annotations

from .plans import drill_queries, event_queries, file_queries, finding_queries, overview_queries, report_queries, run_queries, scan_queries, source_queries, tree_queries  # noqa: F401  they register their queries
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
