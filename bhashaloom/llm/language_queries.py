"""Problem 7: missing and wrong language labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bhashaloom.llm.languages import identify, mislabelled
from bhashaloom.plans.session import spread, table


def p7_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of raw_lines with its language, or the language of each of its stretches, and a confidence."""
    return identify(spread(table(spark, folder, "raw_lines").select("line_id", "line", "language")), "line_id", "line", "language", table(spark, folder, "languages")).withColumn("confidence", F.round("confidence", 6))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose label is missing or wrong, and mixed lines, with each language they are written in."""
    return mislabelled(p7_stretches(spark, folder), "line_id")


QUERIES = {"p7_found": p7_found, "p7_stretches": p7_stretches}

SQL: dict[str, str] = {}
