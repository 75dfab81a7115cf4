"""Batches of packed sequences as rows (batch, slot), by digests of keys: the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bhashaloom.functions.keyed import integer, uniform
from bhashaloom.plans.ranking import BUCKET_ROWS, order_bucket, with_rank


def language_weights(frame: DataFrame, group: list[str]) -> DataFrame:
    """(group, n_sequences, weight): share of each within the groups that share all but the last column."""
    counts = frame.groupBy(*group).agg(F.count(F.lit(1)).alias("n_sequences"))
    whole = Window.partitionBy(*group[:-1]) if len(group) > 1 else Window.partitionBy(F.lit(1))
    return counts.withColumn("weight", F.round(F.col("n_sequences") / F.sum("n_sequences").over(whole), 9))  # few rows


def allocation(weights: DataFrame, name: str, weight: str, batch: int) -> DataFrame:
    """Slots of a batch by weight: the whole part of each share, and all that is left to the largest, first by name."""
    largest = Window.partitionBy(F.lit(1)).orderBy(F.desc(weight), name)
    shares = weights.select(name, weight, F.floor(F.col(weight) * batch + F.lit(1e-9)).alias("slots"), F.row_number().over(largest).alias("place"))
    rest = F.lit(batch) - F.sum("slots").over(Window.partitionBy(F.lit(1)))
    return shares.select(name, F.when(F.col("place") == 1, F.col("slots") + rest).otherwise(F.col("slots")).cast("bigint").alias("slots"))


def mixed_batches(frame: DataFrame, lang: str, key: str, batch: int, seed: int = 42) -> DataFrame:
    """(batch, slot) and all columns: each slot draws a language by its number of sequences and takes the next of them.

    There are floor(n / batch) batches. A language whose sequences run out starts again with its first. The key must be unique in
    its language: slots are dealt to keys alone, and the sequences join at the end, shuffled once.
    """
    counts = frame.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).where("lang IS NOT NULL")
    order = Window.partitionBy(F.lit(1)).orderBy("lang")
    bands = counts.withColumn("hi", F.sum("n").over(order)).withColumn("lo", F.col("hi") - F.col("n"))  # a row per language
    held = [(r["lang"], r["n"], r["lo"], r["hi"]) for r in bands.collect()]
    total = max((h[3] for h in held), default=0)
    slots = frame.sparkSession.range(total // batch * batch).select(F.col("id").alias("draw"), F.floor(uniform(seed, F.col("id")) * F.lit(total)).alias("at"))
    drawn, size = F.lit(None).cast("string"), F.lit(1).cast("bigint")
    for name, n, lo, hi in held:
        inside = (F.col("at") >= lo) & (F.col("at") < hi)
        drawn, size = F.when(inside, F.lit(name)).otherwise(drawn), F.when(inside, F.lit(n)).otherwise(size)
    width = max(65_536, total // BUCKET_ROWS)
    taken = with_rank(slots.select("draw", drawn.alias("lang"), size.alias("n")), ["lang"], F.floor(F.col("draw") / width), ["draw"], "turn")
    own = frame.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(key).alias("key"))
    numbered = with_rank(own, ["lang"], order_bucket(own, "key"), ["key"], "nth")
    wanted = taken.withColumn("nth", (F.col("turn") - 1) % F.col("n") + 1)
    dealt = wanted.join(numbered, ["lang", "nth"]).select(F.floor(F.col("draw") / batch).alias("batch"), (F.col("draw") % batch).alias("slot"), F.col("lang").alias(lang), F.col("key").alias(key))
    return dealt.join(frame, [lang, key]).select("batch", "slot", *frame.columns)


def single_batches(frame: DataFrame, group: list[str], key: str, batch: int) -> DataFrame:
    """(batch, slot) and all columns, in order of the key; the last batch of a group may be short."""
    ranked = with_rank(frame, group, order_bucket(frame, key), [key], "__nth")
    return ranked.select(F.floor((F.col("__nth") - 1) / batch).alias("batch"), ((F.col("__nth") - 1) % batch).alias("slot"), *frame.columns)


def padded(batches: DataFrame, group: list[str], batch: int, seed: int = 42) -> DataFrame:
    """Short batches filled up with copies of their own rows, picked by digest."""
    sizes = batches.groupBy(*group, "batch").agg(F.count(F.lit(1)).alias("have")).where(F.col("have") < batch)
    holes = sizes.withColumn("slot_", F.explode(F.sequence(F.col("have"), F.lit(batch - 1).cast("bigint"))))
    picked = holes.withColumn("slot", F.pmod(integer(seed, F.concat_ws(":", *group, "batch", "slot_")), F.col("have")))
    copies = picked.join(batches, [*group, "batch", "slot"]).drop("slot", "have").withColumnRenamed("slot_", "slot")
    return batches.unionByName(copies.select(batches.columns))


def random_windows(sequences: DataFrame, lang: str, key: str, tokens: str, windows: int, length: int, seed: int = 42) -> DataFrame:
    """(lang, draw, start, x, y): so many windows of a language's tokens, read as one row, at offsets by digest.

    x has ``length`` tokens and y the same shifted by one. A language with no more than ``length`` tokens is left out.
    A window spans two sequences at most, as none is shorter than it. Keys alone are ranked, and must be unique in their language.
    """
    own = sequences.where(F.col(lang).isNotNull())
    keys = own.select(lang, key, F.size(tokens).alias("__width"))
    numbered = with_rank(keys, [lang], order_bucket(keys, key), [key], "nth")
    sizes = keys.groupBy(lang).agg(F.count(F.lit(1)).alias("n"), F.max("__width").cast("bigint").alias("width"))
    usable = sizes.where(F.col("n") * F.col("width") > length)
    draws = usable.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(windows - 1).cast("bigint"))))
    draws = draws.withColumn("start", F.pmod(integer(seed, F.concat_ws(":", lang, "draw")), F.col("n") * F.col("width") - length))
    first = draws.withColumn("nth", F.floor(F.col("start") / F.col("width")) + 1)
    wanted = first.select("*", F.posexplode(F.array("nth", F.col("nth") + 1)).alias("part", "__nth"))
    at = numbered.select(lang, F.col("nth").alias("__nth"), key)
    # Keys of the sequences that a window touches, two at most; only their tokens are read on.
    found = wanted.join(at, [lang, "__nth"]).join(own.select(lang, key, F.col(tokens).alias("__tokens")), [lang, key])
    both = found.groupBy(lang, "draw", "start", "width").agg(F.sort_array(F.collect_list(F.struct("part", "__tokens"))).alias("__two"))
    both = both.withColumn("all", F.flatten(F.transform("__two", lambda x: x["__tokens"])))
    begin = (F.col("start") % F.col("width") + 1).cast("int")
    return both.select(lang, "draw", "start", F.slice("all", begin, length).alias("x"), F.slice("all", begin + 1, length).alias("y"))
