"""Problems 1 and 3: a sample of fixed size, and a mixture by weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bhashaloom.llm.fixed_sample import fixed_size_sample, piece_report
from bhashaloom.llm.mixing import mix, plan, shares
from bhashaloom.plans.session import table

#: Lines that the sample is to have.
SAMPLE_LINES = 50_000


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    """SAMPLE_LINES lines of raw_lines, each line equally likely; all lines where there are fewer."""
    return fixed_size_sample(table(spark, folder, "raw_lines"), SAMPLE_LINES, "piece_no", ["line_id"])


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines each piece had and how many of them a sample of 1000 drew."""
    lines = table(spark, folder, "raw_lines").select("line_id", "piece_no")
    return piece_report(lines, fixed_size_sample(lines, 1000, "piece_no", ["line_id"], seed=7), "piece_no")


def p1_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Of a sample of 2000 lines: its rows, how many differ, and how many are lines of the table."""
    lines = table(spark, folder, "raw_lines")
    drawn = fixed_size_sample(lines, 2000, "piece_no", ["line_id"], seed=11)
    there = lines.select("line_id", F.xxhash64("line").alias("there"), F.lit(True).alias("known"))
    return drawn.join(there, "line_id", "left").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("line_id").alias("n_lines"), F.count_if(F.col("known") & F.xxhash64("line").eqNullSafe(F.col("there"))).alias("n_known")
    )


def _train(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "packed_seqs").where("split_name = 'train'")


def p3_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The train sequences that the mixture uses with their tokens, a row for each use."""
    return mix(_train(spark, folder), table(spark, folder, "mix_targets"))


def p3_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted, target and reached share of each language."""
    rows, targets = _train(spark, folder).drop("tokens"), table(spark, folder, "mix_targets")
    return shares(mix(rows, targets), plan(rows, targets)).withColumnRenamed("source", "lang")


def p3_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Each train shard once: sequences stated, by its size, and held, and whether the three agree."""
    listed = table(spark, folder, "bin_files").where("split_name = 'train'").groupBy("file_name").agg(
        F.count(F.lit(1)).alias("times_listed"), F.max("n_sequences").alias("stated"), F.floor(F.max("n_bytes") / 2048).alias("by_size")
    )
    held = _train(spark, folder).groupBy("file_name").agg(F.count(F.lit(1)).alias("held"))
    both = listed.join(held, "file_name", "full").withColumn("held", F.coalesce("held", F.lit(0)).cast("long"))
    return both.withColumn("agree", F.coalesce((F.col("stated") == F.col("held")) & (F.col("by_size") == F.col("held")), F.lit(False)))


QUERIES = {"p1_sample": p1_sample, "p1_pieces": p1_pieces, "p1_valid": p1_valid, "p3_mixture": p3_mixture, "p3_shares": p3_shares, "p3_shards": p3_shards}

SQL = {
    "p1_valid": "SELECT least(2000, count(*)) AS n_rows, least(2000, count(DISTINCT line_id)) AS n_lines, least(2000, count(*)) AS n_known FROM raw_lines",
    "p3_shares": """
WITH wanted AS (
  SELECT lang, max(train_weights) AS weight, floor(min(max_repeats)) AS cap FROM mix_targets
  WHERE lang IS NOT NULL AND train_weights > 0 AND NOT isnan(train_weights) GROUP BY lang
), held AS (
  SELECT lang, count(*) AS n FROM packed_seqs WHERE split_name = 'train' AND lang IS NOT NULL GROUP BY lang
), both_ AS (SELECT w.lang, weight, cap, coalesce(n, 0) AS n FROM wanted w LEFT JOIN held h ON w.lang = h.lang),
sums AS (
  SELECT sum(weight) AS every, sum(weight) FILTER (WHERE n > 0) AS there, min(cap * n / weight) FILTER (WHERE n > 0) AS most, sum(n) AS size FROM both_
), rated AS (
  SELECT b.*, weight / every AS wanted_share, CASE WHEN n > 0 THEN weight / there ELSE 0 END AS target_share,
    CASE WHEN n > 0 THEN least(weight / there * coalesce(most * there, size) / n, coalesce(cap, 'inf'::DOUBLE)) ELSE 0 END AS copies,
    ('0x' || substr(md5('42:' || lang), 1, 8))::BIGINT / 4294967296.0 AS start
  FROM both_ b, sums
), used AS (SELECT *, floor(n * copies + start)::BIGINT AS n_uses FROM rated),
most AS (
  SELECT lang, max(floor(i * copies + start) - floor((i - 1) * copies + start))::BIGINT AS most_uses
  FROM (SELECT lang, copies, start, unnest(range(1, n + 1)) AS i FROM used) GROUP BY lang
)
SELECT u.lang, n AS n_rows, n_uses, coalesce(most_uses, 0) AS most_uses, round(wanted_share, 9) AS wanted_share, round(target_share, 9) AS target_share,
  round(n_uses / (SELECT sum(n_uses) FROM used), 9) AS reached_share
FROM used u LEFT JOIN most m ON u.lang = m.lang""",
    "p3_shards": """
SELECT coalesce(b.file_name, h.file_name) AS file_name, times_listed, stated, by_size, coalesce(held, 0) AS held,
  coalesce(stated = coalesce(held, 0) AND by_size = coalesce(held, 0), false) AS agree
FROM (SELECT file_name, count(*) AS times_listed, max(n_sequences) AS stated, max(n_bytes) // 2048 AS by_size
      FROM bin_files WHERE split_name = 'train' GROUP BY file_name) b
FULL JOIN (SELECT file_name, count(*) AS held FROM packed_seqs WHERE split_name = 'train' GROUP BY file_name) h ON b.file_name = h.file_name""",
}
