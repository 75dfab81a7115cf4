"""Problem 4: duplicates hidden by formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bhashaloom.llm.format_duplicates import collapsed, format_duplicates
from bhashaloom.plans.session import spread, table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every line that repeats a record in some form, with the record's first line."""
    return format_duplicates(spread(table(spark, folder, "raw_lines").select("line_id", "line")), "line_id", "line")


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    """One line of each record, with its number of copies."""
    return collapsed(table(spark, folder, "raw_lines"), "line_id", "line")


QUERIES = {"p4_found": p4_found, "p4_records": p4_records}

SQL: dict[str, str] = {}
