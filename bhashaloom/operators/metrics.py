"""Metrics of runs: rolling means, moving averages, schedules and throughput."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bhashaloom.plans.ranking import with_halo

#: Rows of a chunk of a series; windows over a series of any length are taken chunk by chunk.
CHUNK = 10_000


def rolling_mean(ranked: DataFrame, series: str, rank: str, value: str, last: int) -> DataFrame:
    """Frame with ``rolling``: mean of the last values of a series, this one included. Null values are left out of a mean."""
    halo = with_halo(ranked, rank, CHUNK, last - 1)
    window = Window.partitionBy(series, "chunk").orderBy(rank).rowsBetween(-(last - 1), 0)
    return halo.withColumn("rolling", F.avg(value).over(window)).where("own").select(*ranked.columns, "rolling")


def delta(ranked: DataFrame, series: str, rank: str, value: Column) -> DataFrame:
    """Frame with ``delta``: the value less the one before in its series; null for the first."""
    halo = with_halo(ranked, rank, CHUNK, 1).withColumn("__v", value)
    before = F.lag("__v").over(Window.partitionBy(series, "chunk").orderBy(rank))
    return halo.withColumn("delta", F.col("__v") - before).where("own").select(*ranked.columns, "delta")


#: Rows of a block of a chunk. A chunk has a hundred blocks, so that no array is longer than about this.
BLOCK = 100


def moving_average(ranked: DataFrame, series: str, rank: str, value: str, keep: float = 0.9, start: int = 1) -> DataFrame:
    """(series, rank, ema): the first value starts it; then keep * before + (1 - keep) * value. Values must not be null.

    start: the rank of the first value that counts; rows before it don't come out. The average is linear: each block is averaged
    from nothing, a block's end is carried into the next of its chunk, and a chunk's into the next chunk, which is a fold of
    one pair of numbers for each, exact for any keep from 0 to 1.
    """
    number = F.col(rank) - F.lit(start - 1)
    rows = ranked.where(number >= 1).select(series, rank, F.col(value).cast("double").alias("v"), number.alias("__nth"), F.floor((number - 1) / CHUNK).alias("chunk"))
    rows = rows.withColumn("block", F.floor(((F.col("__nth") - 1) % CHUNK) / BLOCK))
    gathered = rows.groupBy(series, "chunk", "block").agg(F.sort_array(F.collect_list(F.struct("__nth", rank, "v"))).alias("xs"))  # BLOCK rows at most
    step = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) * keep + x["v"] * F.when(x["__nth"] == 1, 1.0).otherwise(1 - keep)))
    local = gathered.withColumn("es", F.aggregate("xs", F.array().cast("array<double>"), step))
    ends = local.select(series, "chunk", "block", F.element_at("es", -1).alias("end"), F.pow(F.lit(float(keep)), F.size("xs")).alias("fade"))

    def carried(table: DataFrame, group: list[str], order: str) -> DataFrame:
        """Table with ``carry``: the average at the end of the rows before, as folded from their (end, fade)."""
        per = table.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(order, "end", "fade"))).alias("all"))
        fold = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) * x["fade"] + x["end"]))
        sums = per.withColumn("sums", F.aggregate("all", F.array().cast("array<double>"), fold))
        each = sums.select(*group, F.posexplode("all").alias("i", "x"), "sums")
        return each.select(*group, F.col(f"x.{order}").alias(order), F.coalesce(F.try_element_at("sums", F.when(F.col("i") > 0, F.col("i"))), F.lit(0.0)).alias("carry"))

    blocks = carried(ends, [series, "chunk"], "block")  # a hundred at most
    whole = F.aggregate("all", F.lit(0.0), lambda acc, x: acc * x["fade"] + x["end"])
    fades = F.aggregate("all", F.lit(1.0), lambda acc, x: acc * x["fade"])
    chunks = ends.groupBy(series, "chunk").agg(F.sort_array(F.collect_list(F.struct("block", "end", "fade"))).alias("all")).select(series, "chunk", whole.alias("end"), fades.alias("fade"))
    # Chunks are folded in the same way, a thousand at a time, so that 10**7 rows make one array, and the few sums of those once more.
    groups = chunks.withColumn("big", F.floor(F.col("chunk") / 1000))
    within = carried(groups, [series, "big"], "chunk")
    bigs = groups.groupBy(series, "big").agg(F.sort_array(F.collect_list(F.struct("chunk", "end", "fade"))).alias("all")).select(series, "big", whole.alias("end"), fades.alias("fade"))
    before = carried(bigs, [series], "big")
    faded = Window.partitionBy(series, "big").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    factor = groups.withColumn("factor", F.coalesce(F.product("fade").over(faded), F.lit(1.0))).select(series, "chunk", "big", "factor")
    carry = factor.join(within.select(series, "chunk", F.col("carry").alias("near")), [series, "chunk"]).join(before.select(series, "big", F.col("carry").alias("far")), [series, "big"])
    carry = carry.select(series, "chunk", (F.col("near") + F.col("far") * F.col("factor")).alias("chunk_carry"))
    # The carry of a block: what its chunk's earlier blocks left, and what the chunks before left, faded by the chunk's full blocks before it.
    joined = local.join(blocks, [series, "chunk", "block"]).join(carry, [series, "chunk"])
    every = F.col("carry") + F.col("chunk_carry") * F.pow(F.lit(float(keep)), F.col("block") * BLOCK)
    out = joined.select(series, every.alias("carry"), F.posexplode(F.arrays_zip(F.col("xs").alias("x"), F.col("es").alias("e"))).alias("i", "z"))
    return out.select(series, F.col(f"z.x.{rank}").alias(rank), (F.col("z.e") + F.col("carry") * F.pow(F.lit(float(keep)), F.col("i") + 1)).alias("ema"))


def learning_rate(step: Column, *, base: float, least: float, warmup: int, decay: int, done: int = 0) -> Column:
    """Linear warm-up, then a cosine down to the least rate, which stays."""
    it = step + done
    progress = (it - warmup) / F.lit(float(max(1, decay - warmup)))
    cosine = F.lit(least) + (F.cos(progress * F.pi()) + 1) * 0.5 * (base - least)
    return F.when(it < warmup, (it + 1) * base / (warmup + 1)).when(it > decay, F.lit(least)).otherwise(cosine)


def flops_utilisation(parameters: Column, layers: int, heads: int, head_size: int, context: int, iterations: Column, seconds: Column, peak: float = 312e12) -> Column:
    """Share of a device's peak that training reached: 6 N + 12 L H Q T operations per token."""
    per_token = parameters * 6 + 12 * layers * heads * head_size * context
    return per_token * context * iterations / seconds / peak


def tokens_per_iteration(accumulation: int, world: int, batch: int, context: int) -> int:
    """Tokens that one update sees."""
    return accumulation * world * batch * context


def throughput(tokens: Column, seconds: Column, micro_steps: int = 1) -> Column:
    """Tokens a second of an update of so many like steps, of which one has been timed; null for no time."""
    return tokens / F.nullif(seconds * micro_steps, F.lit(0.0))


def line_rate(lines: Column, seconds: Column) -> Column:
    """Lines a second; null for no time."""
    return lines / F.nullif(seconds.cast("double"), F.lit(0.0))


def remaining_seconds(total: Column, done: Column, rate: Column) -> Column:
    """Seconds until all lines are done at a rate; null without a rate."""
    return F.greatest(total - done, F.lit(0)) / F.nullif(rate.cast("double"), F.lit(0.0))


def gigabytes(size):
    """Bytes as GB of 1024 cubed; for numbers and columns."""
    return size / 1024**3


def megabytes(size):
    """Bytes as MB of 1024 squared; for numbers and columns."""
    return size / 1024**2


def extrapolated(rates: DataFrame, totals: DataFrame, lang: str, bytes_per_second: float, threads: Sequence[int] = (1, 2, 4, 8, 16)) -> DataFrame:
    """(lang, n_lines, megabytes, kept_lines, threads, seconds): what cleaning whole files will take and leave, by the rate of one thread.

    rates: (lang, share) kept of a sample; totals: (lang, n_lines, size in bytes). A thread more is taken to add as much as the first.
    """
    known = totals.join(rates.select(F.col(lang).alias("__lang"), "share"), F.col(lang).eqNullSafe(F.col("__lang")))
    each = known.withColumn("threads", F.explode(F.array(*(F.lit(t).cast("bigint") for t in threads))))
    return each.select(
        lang, "n_lines", F.round(megabytes(F.col("size")), 6).alias("megabytes"), F.round(F.col("n_lines") * F.col("share")).cast("bigint").alias("kept_lines"), "threads",
        F.round(F.col("size") / F.lit(float(bytes_per_second)) / F.col("threads"), 6).alias("seconds"),
    )


def scalar_settings(settings: Column) -> Column:
    """Of a JSON object the entries whose value is a number, a truth value or a string, and whose name does not begin with an underscore.

    A map of the values as text; null for what is no JSON object.
    """
    parsed = F.from_json(settings, "map<string,variant>")
    scalar = lambda v: F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|STRING|BOOLEAN|DECIMAL.*)$")
    kept = F.map_filter(parsed, lambda k, v: ~k.startswith("_") & F.coalesce(scalar(v), F.lit(False)))
    return F.transform_values(kept, lambda _, v: F.variant_get(v, "$", "string"))


def duration(seconds: Column) -> Column:
    """Seconds as hours, minutes and seconds."""
    whole = F.floor(seconds)
    return F.concat(F.floor(whole / 3600).cast("string"), F.lit("h "), F.floor(whole % 3600 / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s"))


def macro_mean(frame: DataFrame, group: str, value: str) -> DataFrame:
    """(group, mean, macro): the mean of each group, and the plain mean of those means."""
    means = frame.groupBy(group).agg(F.avg(value).alias("mean"))
    return means.withColumn("macro", F.avg("mean").over(Window.partitionBy(F.lit(1))))  # a row per group


def parameter_shapes(spark: SparkSession, layers: int, width: int, vocabulary: int, context: int, bias: bool = False) -> DataFrame:
    """(name, layers, shape, positional, decayed) of a decoder with tied embeddings: each kind of weight, how often it occurs, and
    whether it is the table of positions and of rank two or more, which alone decay."""
    kinds = [
        ("token embedding", 1, [vocabulary, width]), ("position embedding", 1, [context, width]), ("norm before attention", layers, [width]), ("query, key and value", layers, [width, 3 * width]),
        ("attention output", layers, [width, width]), ("norm before layer", layers, [width]), ("expansion", layers, [width, 4 * width]), ("contraction", layers, [4 * width, width]), ("last norm", 1, [width]),
    ]
    biases = [(f"{n} bias", c, [s[-1]]) for n, c, s in kinds if bias and "embedding" not in n]
    rows = [(n, c, s, n == "position embedding", len(s) >= 2) for n, c, s in kinds + biases]
    return spark.createDataFrame(rows, "name string, layers int, shape array<bigint>, positional boolean, decayed boolean")


def parameter_counts(shapes: DataFrame) -> DataFrame:
    """(total, without_positions, decayed): sizes of all weights, of all but the positions, and of those that decay."""
    size = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, n: a * n) * F.col("layers")
    some = lambda condition: F.sum(F.when(condition, size).otherwise(0)).cast("bigint")
    return shapes.agg(F.sum(size).cast("bigint").alias("total"), some(~F.col("positional")).alias("without_positions"), some(F.col("decayed")).alias("decayed"))
