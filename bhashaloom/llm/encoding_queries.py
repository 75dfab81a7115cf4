"""Problem 6: lines of prepared_lines that were read in a wrong encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bhashaloom.llm.encoding import repairs
from bhashaloom.plans.session import spread, table


def p6_repairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every garbled line with what can be had back of it."""
    return repairs(spread(table(spark, folder, "prepared_lines").select("line_id", "line")), "line_id", "line").withColumn("gain", F.round("gain", 6))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every garbled line."""
    return p6_repairs(spark, folder).select("line_id")


QUERIES = {"p6_found": p6_found, "p6_repairs": p6_repairs}

SQL: dict[str, str] = {}
