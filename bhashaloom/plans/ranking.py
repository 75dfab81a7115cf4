"""Exact ranks within groups of any size.

A window over a group sorts it in one task. Here a group is parted into buckets that follow the order; buckets are counted,
the counts before each are summed up, which are few rows, and only a bucket is sorted by one task. Where only the first rows of
a group are wanted, no more than the one bucket in which the last of them stands is sorted at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, about, in large tables.
BUCKET_ROWS = 1_000_000


def order_bucket(frame: DataFrame, key: str) -> Column:
    """Buckets of consecutive whole numbers for with_rank: 65,536 of them, or wider ones where the keys are sparse, so
    that there are at most 4096 buckets or one for BUCKET_ROWS rows, however the keys are spread. One small aggregation."""
    span = frame.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    width = max(65_536, -(-(hi - lo + 1) // max(4096, span["n"] // BUCKET_ROWS)))
    return F.floor((F.col(key).cast("decimal(20,0)") - F.lit(lo)) / F.lit(width)).cast("bigint")


def digest_digits(frame: DataFrame, least: int = 3) -> int:
    """Hexadecimal digits of a digest that part a table of this size into buckets of about BUCKET_ROWS rows; 3, or 4096 buckets,
    at least. Counts the rows, for which no column is read."""
    n, digits = frame.count(), least
    while 16**digits * BUCKET_ROWS < n:
        digits += 1
    return digits


def _starts(staged: DataFrame) -> DataFrame:
    """(__g, __bucket, __n, __before): rows of each bucket, and of those before it in its group."""
    counts = staged.groupBy("__g", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__g").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))


def with_rank(frame: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column | str], rank: str = "rank") -> DataFrame:
    """Frame with the rank of each row in its group, from 1.

    bucket must not fall as the order rises. Rows that tie in the whole order are ranked in any order. Null groups are a group.
    Group and bucket are keys of both the join and the window, so that rows are shuffled once, however large the table of buckets is.
    """
    staged = frame.withColumn("__g", F.struct(*group)).withColumn("__bucket", F.coalesce(bucket.cast("string"), F.lit("")))
    numbered = frame.withColumn("__g", F.struct(*group)).withColumn("__bucket", bucket)
    starts = _starts(numbered).select("__g", F.coalesce(F.col("__bucket").cast("string"), F.lit("")).alias("__bucket"), "__before")
    within = F.row_number().over(Window.partitionBy("__g", "__bucket").orderBy(*order))
    ranked = staged.join(starts, ["__g", "__bucket"]).withColumn("__within", within)
    return ranked.select(*frame.columns, (F.col("__before") + F.col("__within")).cast("bigint").alias(rank))


def digest_rank(frame: DataFrame, group: Sequence[str], digest: Column, tie: Sequence[Column | str], rank: str = "rank", digits: int | None = None) -> DataFrame:
    """Frame with the rank of each row in its group in the order of a hexadecimal digest, then of ``tie``."""
    digits = digits or digest_digits(frame)
    staged = frame.withColumn("__digest", digest)
    return with_rank(staged, group, F.substring("__digest", 1, digits), ["__digest", *tie], rank).drop("__digest")


def first_by_digest(frame: DataFrame, group: Sequence[str], digest: Column, key: str, quota: Column, taken: str = "taken") -> DataFrame:
    """Frame with ``taken``: whether the row is among the first ``quota`` of its group in the order of a digest, then of the key.

    quota: an expression that is the same for all rows of a group and may use ``size``, the group's rows. Rows are not
    shuffled but for a hot join: a group's table of buckets tells which are taken as a whole, and of the one that is not, (digest, key)
    of the last row that is. Rows that repeat that key and its digest are told apart by nothing, so that all of them are taken.
    """
    digits = digest_digits(frame)
    keyed = frame.select(F.struct(*group).alias("__g"), digest.alias("__digest"), F.col(key).alias("__key")).withColumn("__bucket", F.substring("__digest", 1, digits))
    starts = _starts(keyed).withColumn("size", F.sum("__n").over(Window.partitionBy("__g")))
    starts = starts.select("__g", "__bucket", "__n", (F.least(quota, F.col("size")) - F.col("__before")).alias("__want")).where("__want > 0")
    parted = starts.where("__want < __n")
    nth = F.row_number().over(Window.partitionBy("__g", "__bucket").orderBy("__digest", "__key"))
    last = keyed.join(parted, ["__g", "__bucket"]).withColumn("__nth", nth).where("__nth = __want").select("__g", "__bucket", F.struct("__digest", "__key").alias("__last"))
    limits = starts.join(last, ["__g", "__bucket"], "left").select("__g", "__bucket", "__last", F.lit(True).alias("__first"))
    staged = frame.withColumns({"__g": F.struct(*group), "__digest": digest}).withColumn("__bucket", F.substring("__digest", 1, digits))
    joined = staged.join(limits, ["__g", "__bucket"], "left")
    within = F.col("__last").isNull() | (F.struct("__digest", F.col(key).alias("__key")) <= F.col("__last"))
    return joined.select(*frame.columns, (F.coalesce("__first", F.lit(False)) & within).alias(taken))


def with_halo(frame: DataFrame, rank: str, size: int, halo: int) -> DataFrame:
    """Frame cut into chunks of ``size`` ranks, with the last ``halo`` rows of the chunk before in each.

    Adds ``chunk`` and ``own``, false for the rows of the chunk before.
    """
    chunk = F.floor((F.col(rank) - 1) / size)
    late = F.pmod(F.col(rank) - 1, F.lit(size)) >= size - halo
    copies = F.when(late, F.array(F.struct(chunk.alias("chunk"), F.lit(True).alias("own")), F.struct((chunk + 1).alias("chunk"), F.lit(False).alias("own")))).otherwise(
        F.array(F.struct(chunk.alias("chunk"), F.lit(True).alias("own")))
    )
    return frame.withColumn("__copy", F.explode(copies)).select(*frame.columns, "__copy.chunk", "__copy.own")
