"""The registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bhashaloom.llm import budget_queries, duplicate_queries, encoding_queries, language_queries, leak_queries, overlap_queries, residue_queries, sampling_queries


def _modules() -> list:
    return [sampling_queries, overlap_queries, duplicate_queries, budget_queries, encoding_queries, language_queries, leak_queries, residue_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries, in the order of their problems."""
    return {name: run for module in _modules() for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
