"""Problem 10: template residue, filler and error pages in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bhashaloom.llm.residue import residue
from bhashaloom.llm.residue_neighbours import classes
from bhashaloom.plans.session import table


def p10_method(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its component of near-duplicates, and whether residue is in it."""
    return classes(table(spark, folder, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with residue of their own, by rule."""
    return residue(table(spark, folder, "documents"), "doc_id", "text").select("doc_id")


def p10_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus without the documents found: id, language and source of what stays."""
    documents = table(spark, folder, "documents")
    return documents.join(p10_found(spark, folder), "doc_id", "left_anti").select("doc_id", "lang", "source")


QUERIES = {"p10_method": p10_method, "p10_found": p10_found, "p10_clean": p10_clean}

SQL: dict[str, str] = {}
