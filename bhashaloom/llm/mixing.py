"""Mixing sources to target weights (problem 3).

Each row of a source is expected in the mixture equally often, c times. The rows of a source stand in a fixed
order; the running sum of c with one random offset crosses a whole number as often as the row is emitted. So a
row comes out floor(c) or ceil(c) times, and a source as often as planned but for one. Running sums over a source
of any size come from ranks within buckets of bounded size and the sums of the buckets before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bhashaloom.plans.skew import hot_keys, salted_join

#: Rows of a bucket, about, which one task sorts, and most buckets of a source, whose sums one task adds up.
BUCKET_ROWS, MOST_BUCKETS = 2_000, 1_000_000
#: A table of targets of at most so many rows is broadcast; a larger one is joined with salted keys.
BROADCAST_TARGETS = 100_000


@dataclass(frozen=True)
class Columns:
    """The column names of a mixture: of the rows, then of the targets."""

    source: str = "lang"
    key: str = "seq_id"
    target_source: str = "lang"
    weight: str = "train_weights"
    cap: str = "max_repeats"


def offset(source: Column, seed: int) -> Column:
    """A source's offset from 0 to under 1, by its name and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), source.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def plan(frame: DataFrame, targets: DataFrame, columns: Columns = Columns(), total: float | None = None, size: Column | None = None) -> DataFrame:
    """One row per wanted source: its rows and size, wanted share of all wanted sources, target share of those
    that have rows, and ``copies``, the expected copies of each row.

    Sources with a null, zero, negative or NaN weight are not wanted; neither are rows of a null source or of one
    without target. A source listed twice is wanted once, with its largest weight and smallest cap. A cap counts
    as its whole part, null as none. Without ``total``, the largest total is taken at which every source with rows reaches
    its share under its cap (the size of all wanted rows if nothing is capped). With a total, a source whose cap
    is too low stays below its share, and the shares reached tell.
    """
    wanted = (
        targets.where(F.col(columns.target_source).isNotNull() & (F.col(columns.weight) > 0) & ~F.isnan(columns.weight))
        .groupBy(F.col(columns.target_source).alias("source"))
        .agg(F.max(columns.weight).cast("double").alias("weight"), F.floor(F.min(columns.cap)).cast("double").alias("cap"))
    )
    held = frame.where(F.col(columns.source).isNotNull()).groupBy(F.col(columns.source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.lit(1) if size is None else size).cast("double").alias("size")
    )
    both = wanted.join(held, "source", "left").withColumns({"n_rows": F.coalesce("n_rows", F.lit(0)), "size": F.coalesce("size", F.lit(0.0))})
    there = F.col("size") > 0
    sums = both.agg(
        F.sum("weight").alias("all"), F.sum(F.when(there, F.col("weight"))).alias("there"),
        F.min(F.when(there, F.col("cap") * F.col("size") / F.col("weight"))).alias("most"), F.sum("size").alias("size"),
    ).first()  # one row
    weights, present = sums["all"] or 0.0, sums["there"] or 0.0
    if total is None:
        total = (sums["most"] * present if sums["most"] is not None else sums["size"]) or 0.0
    share = F.when(there, F.col("weight") / F.lit(present)).otherwise(F.lit(0.0))
    copies = F.when(there, F.least(share * F.lit(float(total)) / F.col("size"), F.coalesce("cap", F.lit(float("inf"))))).otherwise(F.lit(0.0))
    return both.select("source", "n_rows", "size", (F.col("weight") / F.lit(weights)).alias("wanted_share"), share.alias("target_share"), "cap", copies.alias("copies"))


def mix(frame: DataFrame, targets: DataFrame, columns: Columns = Columns(), total: float | None = None, size: Column | None = None, seed: int = 42) -> DataFrame:
    """The mixture: the frame's columns and ``copy_no``, from 1, one row per use of a row.

    A row is used floor or ceil of its source's expected copies, never more often than the cap. The order within a source is
    by a hash of the row, then the key; repeated keys and rows are rows of their own. Rows of unwanted sources don't come out.
    The same rows and seed give the same mixture. Rows are shuffled once, by bucket, for the sums and the ranks alike.
    """
    rates = plan(frame, targets, columns, total, size).where("copies > 0").select(F.col("source").alias("__source"), F.col("n_rows").alias("__rows"), F.col("copies").alias("__copies"))
    rows = frame.withColumn("__source", F.col(columns.source))
    if targets.count() <= BROADCAST_TARGETS:
        rated = rows.join(F.broadcast(rates), "__source")
    else:
        every = rates.agg(F.sum("__rows")).first()[0] or 0  # one row
        rated = salted_join(rows, rates, ["__source"], hot_keys(rates, ["__source"], "__rows", every), [columns.key])
    buckets = F.least(F.ceil(F.col("__rows") / F.lit(BUCKET_ROWS)), F.lit(MOST_BUCKETS)).cast("long")
    place = F.xxhash64(F.lit(seed), *(c for c, kind in frame.dtypes if not kind.startswith(("map", "variant"))))  # null and repeated keys are spread by the other columns
    rated = rated.withColumns({"__place": place, "__bucket": F.pmod(place, buckets)})
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rated.groupBy("__source", "__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    rank = F.row_number().over(Window.partitionBy("__source", "__bucket").orderBy("__place", columns.key))
    ranked = rated.withColumn("__rank", rank).join(starts, ["__source", "__bucket"])
    position = F.col("__before") + F.col("__rank")
    start = offset(F.col("__source"), seed)
    copies = F.floor(position * F.col("__copies") + start) - F.floor((position - 1) * F.col("__copies") + start)
    used = ranked.withColumn("__uses", copies).where("__uses > 0")
    return used.select(*frame.columns, F.explode(F.sequence(F.lit(1), F.col("__uses").cast("int"))).alias("copy_no"))


def shares(mixture: DataFrame, planned: DataFrame, columns: Columns = Columns(), size: Column | None = None) -> DataFrame:
    """What was reached: per wanted source its rows, uses, most uses of one row, wanted, target and reached share."""
    per_row = mixture.groupBy(F.col(columns.source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_uses"), F.max("copy_no").cast("long").alias("most_uses"), F.sum(F.lit(1) if size is None else size).cast("double").alias("used")
    )
    total = (per_row.agg(F.sum("used").alias("x")).first()["x"]) or 0.0  # one row
    both = planned.join(per_row, "source", "left")
    reached = F.coalesce(F.col("used") / F.lit(total), F.lit(0.0)) if total else F.lit(0.0)
    return both.select(
        "source", "n_rows", F.coalesce("n_uses", F.lit(0)).cast("long").alias("n_uses"), F.coalesce("most_uses", F.lit(0)).cast("long").alias("most_uses"),
        F.round("wanted_share", 9).alias("wanted_share"), F.round("target_share", 9).alias("target_share"), F.round(reached, 9).alias("reached_share"),
    )
