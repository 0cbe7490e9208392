"""Registered queries: every operator over the given tables, with the same result in SQL where SQL can say it."""

from catalog import (  # noqa: F401  (importing registers the queries)
    alignment, anomalies, checks, dashboard_tests, functions, joins, rules, runs, scans, summaries)
from catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
