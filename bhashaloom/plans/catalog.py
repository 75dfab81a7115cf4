"""The core queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bhashaloom.plans import line_queries, line_sql, metric_queries, sequence_queries, sequence_sql, source_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of the core."""
    return line_queries.QUERIES | sequence_queries.QUERIES | metric_queries.QUERIES | source_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return line_sql.SQL | sequence_sql.SQL | metric_queries.SQL | source_queries.SQL
