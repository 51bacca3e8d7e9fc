"""The queries of the data-quality, profiling, variance, matching and extraction operators, with their SQL."""

from __future__ import annotations

from plumbline.plans import check_queries, match_queries, profile_queries, suite_queries  # noqa: F401
from plumbline.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "check_suite"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
