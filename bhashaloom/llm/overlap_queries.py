"""Problem 2: overlaps between the splits of prepared_lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bhashaloom.llm.cross_split import overlaps
from bhashaloom.plans.session import spread, table


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return overlaps(spread(table(spark, folder, "prepared_lines").select("line_id", "line", "is_test", "lang")), "line_id", "line", "is_test", "lang")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of a test and a train line of one lang that are the same or nearly so."""
    return _pairs(spark, folder).select(F.least("test_id", "train_id").alias("id_a"), F.greatest("test_id", "train_id").alias("id_b"))


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per split and source: its lines, those that overlap with the other split, and pairs, exact and near."""
    lines = table(spark, folder, "prepared_lines").where("is_test IS NOT NULL").select("line_id", "is_test", "source")
    exact = (F.col("shared") == F.col("longer")).cast("long")
    sides = F.explode(F.array(F.struct(F.lit(True).alias("is_test"), F.col("test_id").alias("id")), F.struct(F.lit(False).alias("is_test"), F.col("train_id").alias("id"))))
    per_line = _pairs(spark, folder).select(exact.alias("exact"), sides.alias("side")).groupBy(F.col("side.id").alias("line_id")).agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("exact").alias("exact")
    )
    return lines.join(per_line, "line_id", "left").groupBy("is_test", "source").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count("pairs").alias("n_overlapping"),
        F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("n_pairs"), F.coalesce(F.sum("exact"), F.lit(0)).cast("long").alias("n_exact_pairs"),
    )


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts}

SQL: dict[str, str] = {}
