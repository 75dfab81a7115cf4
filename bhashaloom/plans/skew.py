"""Joins whose keys may be hot, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows. At most 1 / HOT_SHARE keys can
#: be, whatever the data, which is the proof that their table is small enough to broadcast.
HOT_SHARE = 1 / 1000


#: Rows of a hot key that one task takes, about, and the fewest and most tasks for a key.
TASK_ROWS, LEAST_SALTS, MOST_SALTS = 100_000, 8, 100_000


def hot_keys(counted: DataFrame, keys: Sequence[str], count: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of ``total`` rows, with their ``__rows``; at most 1 / share rows.

    counted: one row per key, whose counts sum up to ``total`` at most. Tables of under 1000 / share
    rows have no hot keys worth splitting beyond those of 1000 rows.
    """
    return counted.where(F.col(count) > F.lit(max(int(total * share), 1000))).select(*keys, F.col(count).cast("bigint").alias("__rows"))


def salted_join(many: DataFrame, few: DataFrame, keys: Sequence[str], hot: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    """Inner join of ``many`` with ``few`` on ``keys``; rows of a hot key are spread over a task for each TASK_ROWS of them.

    ``hot`` (see hot_keys) has a proven size bound and is broadcast. Only the hot keys' rows of
    ``few`` are repeated. Null keys match nothing.
    """
    salts = F.least(F.greatest(F.ceil(F.col("__rows") / TASK_ROWS), F.lit(LEAST_SALTS)), F.lit(MOST_SALTS)).cast("int")
    marked = F.broadcast(hot.select(*keys, salts.alias("__salts")))
    left = many.join(marked, list(keys), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("__salts")).cast("int"), F.lit(0)))
    right = few.join(marked, list(keys), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)))
    return left.drop("__salts").join(right.drop("__salts"), [*keys, "__salt"]).drop("__salt")


def checkpointed(frame: DataFrame) -> DataFrame:
    """Frame written to the folder that all executors share, with its lineage cut.

    The folder is the session's spark.checkpoint.dir; only where that is unset (tests, one
    machine) is a temporary one used.
    """
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    return frame.checkpoint()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder in use, set from the session's settings if need be."""
    context = spark.sparkContext
    if (now := context.getCheckpointDir()) is not None:
        return now
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="bhashaloom-checkpoint-"))
    return context.getCheckpointDir()
