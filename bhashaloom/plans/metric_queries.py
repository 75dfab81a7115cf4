"""Queries on metrics and numeric arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bhashaloom.functions.keyed import uniform
from bhashaloom.operators import arrays as A
from bhashaloom.operators import metrics as M
from bhashaloom.plans.ranking import with_rank
from bhashaloom.plans.session import table


def _series(spark: SparkSession, folder: str) -> DataFrame:
    """Events as one series per type, in order of time."""
    events = table(spark, folder, "events").select("event_id", "event_type", "ts", "value")
    return with_rank(events, ["event_type"], F.date_trunc("hour", "ts"), ["ts", "event_id"], "step")


def _logits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", A.doubles(F.col("embedding")).alias("v"))


def rolling_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of the last hundred and the last twenty values of each series."""
    rows = _series(spark, folder)
    hundred = M.rolling_mean(rows, "event_type", "step", "value", 100).withColumnRenamed("rolling", "r100")
    both = M.rolling_mean(hundred, "event_type", "step", "value", 20)
    return both.select("event_id", F.round("r100", 9).alias("mean_100"), F.round("rolling", 9).alias("mean_20"))


def ema(spark: SparkSession, folder: str) -> DataFrame:
    """Moving average of each series' values, nine tenths kept."""
    rows = _series(spark, folder).where("value IS NOT NULL")
    return M.moving_average(rows, "event_type", "step", "value").select("event_type", "step", F.round("ema", 6).alias("ema"))


def ema_late(spark: SparkSession, folder: str) -> DataFrame:
    """Moving average that begins with the sixth value of each series and keeps nearly all of what was before."""
    rows = _series(spark, folder).where("value IS NOT NULL")
    return M.moving_average(rows, "event_type", "step", "value", 0.9999, start=6).select("event_type", "step", F.round("ema", 6).alias("ema"))


def step_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Microseconds since the event before of the same type."""
    return M.delta(_series(spark, folder), "event_type", "step", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", F.col("delta").alias("micros"))


def duration_text(spark: SparkSession, folder: str) -> DataFrame:
    """Each event's value, taken as seconds, as hours, minutes and seconds."""
    return table(spark, folder, "events").where("value IS NOT NULL AND value >= 0").select("event_id", M.duration(F.col("value") * 100).alias("shown"))


def lr_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """The learning rate of each of fifteen thousand steps."""
    rate = M.learning_rate(F.col("id"), base=6e-4, least=6e-5, warmup=500, decay=12400)
    return spark.range(15_000).select(F.col("id").alias("step"), F.round(rate, 12).alias("rate"))


def mfu(spark: SparkSession, folder: str) -> DataFrame:
    """Share of a device's peak for models of growing size, and tokens of an update."""
    share = M.flops_utilisation(F.col("id") * 1_000_000, 12, 12, 64, 1024, F.lit(16 * 30), F.lit(8.7))
    return spark.range(1, 501).select(F.col("id").alias("millions"), F.round(share, 9).alias("share"), F.lit(M.tokens_per_iteration(30, 1, 16, 1024)).cast("bigint").alias("tokens"))


def macro_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Mean value of each event type and the mean of the means."""
    out = M.macro_mean(table(spark, folder, "events"), "event_type", "value")
    return out.select("event_type", F.round("mean", 6).alias("mean"), F.round("macro", 6).alias("macro"))


def resource_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Count, mean and largest value by event type."""
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"))


def tensor_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Least, largest, mean, deviation and invalid elements of each vector."""
    v = F.col("v")
    return _logits(spark, folder).select(
        "vec_id", F.round(F.array_min(v), 6).alias("least"), F.round(F.array_max(v), 6).alias("most"), F.round(A.mean(v), 6).alias("mean"),
        F.round(A.deviation(v), 6).alias("deviation"), A.invalid_count(v).cast("bigint").alias("invalid"),
    )


def topk_softmax(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities of the five largest logits of each vector at a temperature of 0.8."""
    masked = _logits(spark, folder).select("vec_id", A.top_k_mask(F.col("v"), 5).alias("v"))
    return masked.select("vec_id", F.transform(A.softmax(F.col("v"), 0.8), lambda p: F.round(p, 6)).alias("probabilities"))


def cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Loss of each vector as logits, with its label as the target."""
    return _logits(spark, folder).select("vec_id", F.round(A.cross_entropy(F.col("v"), F.col("label") % 64), 6).alias("loss"))


def multinomial_draw(spark: SparkSession, folder: str) -> DataFrame:
    """One position of each vector, drawn by its softmax."""
    staged = _logits(spark, folder).select("vec_id", A.softmax(F.col("v")).alias("p"))
    return staged.select("vec_id", A.draw(F.col("p"), uniform(42, F.col("vec_id"))).cast("bigint").alias("drawn"))


def gather_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens of each packed sequence in another order, every seventh one after the other."""
    order = F.transform(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: i * 7 % F.size("tokens"))
    return table(spark, folder, "packed_seqs").select("seq_id", A.gather(F.col("tokens"), order).alias("tokens"))


def shard_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Size of each listed shard file in MB and GB."""
    files = table(spark, folder, "bin_files").select("file_name", "n_bytes").distinct()
    return files.select("file_name", F.round(M.megabytes(F.col("n_bytes")), 9).alias("megabytes"), F.round(M.gigabytes(F.col("n_bytes")), 12).alias("gigabytes"))


def token_throughput(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens a second of an update of thirty like steps, each event's value being the seconds of the last of them."""
    tokens = F.lit(float(M.tokens_per_iteration(30, 1, 16, 1024)))
    return table(spark, folder, "events").select("event_id", F.round(M.throughput(tokens, F.col("value"), 30), 6).alias("tokens_per_second"))


def settings_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Of each event as an object the entries that are scalars and not private, as sorted names and values."""
    made = F.named_struct(
        F.lit("id"), F.col("event_id"), F.lit("kind"), F.col("event_type"), F.lit("_user"), F.col("user_id"), F.lit("late"), F.col("event_id") % 2 == 0,
        F.lit("tags"), F.array("event_type"), F.lit("more"), F.struct(F.col("user_id").alias("id")),
    )
    kept = M.scalar_settings(F.to_json(made))
    return table(spark, folder, "events").select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("settings"))


def parameter_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of a decoder of twelve layers."""
    return M.parameter_counts(M.parameter_shapes(spark, 12, 768, 50304, 1024))


QUERIES = {
    f.__name__: f
    for f in (parameter_counts, gather_tokens, shard_sizes, token_throughput, settings_filter, rolling_mean, ema, ema_late, step_delta, duration_text, lr_schedule, mfu, macro_loss, resource_summary, tensor_summary, topk_softmax, cross_entropy, multinomial_draw)
}

_SERIES = "series AS (SELECT event_id, event_type, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step FROM events)"
_VECTORS = "vectors AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"

SQL = {
    "parameter_counts": """WITH w AS (SELECT 50304 * 768 AS token, 1024 * 768 AS place, 12 * 12 * 768 * 768 AS layers, 25 * 768 AS norms)
SELECT (token + place + layers + norms)::BIGINT AS total, (token + layers + norms)::BIGINT AS without_positions, (token + place + layers)::BIGINT AS decayed FROM w""",
    "rolling_mean": f"""WITH {_SERIES} SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY step ROWS 99 PRECEDING), 9) AS mean_100,
round(avg(value) OVER (PARTITION BY event_type ORDER BY step ROWS 19 PRECEDING), 9) AS mean_20 FROM series""",
    "ema": f"""WITH RECURSIVE {_SERIES}, full_ AS (SELECT * FROM series WHERE value IS NOT NULL), e AS (
SELECT event_type, step, value::DOUBLE AS ema FROM full_ WHERE step = 1
UNION ALL SELECT f.event_type, f.step, e.ema * 0.9::DOUBLE + f.value * 0.1::DOUBLE FROM e JOIN full_ f ON e.event_type = f.event_type AND f.step = e.step + 1)
SELECT event_type, step, round(ema, 6) AS ema FROM e""",
    "ema_late": f"""WITH RECURSIVE {_SERIES}, full_ AS (SELECT * FROM series WHERE value IS NOT NULL AND step >= 6), e AS (
SELECT event_type, step, value::DOUBLE AS ema FROM full_ WHERE step = 6
UNION ALL SELECT f.event_type, f.step, e.ema * 0.9999::DOUBLE + f.value * (1 - 0.9999::DOUBLE) FROM e JOIN full_ f ON e.event_type = f.event_type AND f.step = e.step + 1)
SELECT event_type, step, round(ema, 6) AS ema FROM e""",
    "gather_tokens": "SELECT seq_id, list_transform(range(0, len(tokens)), lambda i: tokens[i * 7 % len(tokens) + 1]) AS tokens FROM packed_seqs",
    "shard_sizes": "SELECT file_name, round(n_bytes / 1048576.0::DOUBLE, 9) AS megabytes, round(n_bytes / 1073741824.0::DOUBLE, 12) AS gigabytes FROM (SELECT DISTINCT file_name, n_bytes FROM bin_files)",
    "token_throughput": "SELECT event_id, round(491520.0::DOUBLE / nullif(value * 30, 0), 6) AS tokens_per_second FROM events",
    "settings_filter": "SELECT event_id, concat_ws(',', 'id=' || event_id, 'kind=' || event_type, 'late=' || (event_id % 2 = 0)::VARCHAR) AS settings FROM events",
    "step_delta": f"WITH {_SERIES} SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY step) AS micros FROM series",
    "duration_text": """SELECT event_id, (s // 3600)::VARCHAR || 'h ' || (s % 3600 // 60)::VARCHAR || 'm ' || (s % 60)::VARCHAR || 's' AS shown
FROM (SELECT event_id, floor(value * 100)::BIGINT AS s FROM events WHERE value >= 0)""",
    "lr_schedule": """SELECT i AS step, round(CASE WHEN i < 500 THEN (i + 1) * 6e-4 / 501 WHEN i > 12400 THEN 6e-5
ELSE 6e-5 + (cos((i - 500) / 11900::DOUBLE * pi()) + 1) * 0.5 * (6e-4 - 6e-5) END, 12) AS rate FROM range(15000) t(i)""",
    "mfu": "SELECT i AS millions, round((i * 6e6 + 12 * 12 * 12 * 64 * 1024) * 1024.0::DOUBLE * 480 / 8.7::DOUBLE / 312e12, 9) AS share, 491520::BIGINT AS tokens FROM range(1, 501) t(i)",
    "macro_loss": "SELECT event_type, round(m, 6) AS mean, round(avg(m) OVER (), 6) AS macro FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type)",
    "resource_summary": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM events GROUP BY event_type",
    "tensor_summary": f"""WITH {_VECTORS} SELECT vec_id, round(list_min(v), 6) AS least, round(list_max(v), 6) AS most, round(list_avg(v), 6) AS mean, round(list_stddev_samp(v), 6) AS deviation,
len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AS invalid FROM vectors""",
    "topk_softmax": f"""WITH {_VECTORS}, masked AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN x < list_reverse_sort(v)[5] THEN '-inf'::DOUBLE ELSE x END) AS v FROM vectors),
powers AS (SELECT vec_id, list_transform(v, lambda x: exp((x - list_max(v)) / 0.8::DOUBLE)) AS p FROM masked)
SELECT vec_id, list_transform(p, lambda x: round(x / list_sum(p), 6)) AS probabilities FROM powers""",
    "cross_entropy": f"WITH {_VECTORS} SELECT vec_id, round(ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) + list_max(v) - v[label % 64 + 1], 6) AS loss FROM vectors",
    "multinomial_draw": f"""WITH {_VECTORS}, powers AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS p FROM vectors),
bands AS (SELECT vec_id, list_transform(range(1, len(p) + 1), lambda i: list_sum(list_slice(p, 1, i)) / list_sum(p)) AS c FROM powers)
SELECT vec_id, least(len(list_filter(c, lambda x: x <= ('0x' || substr(md5('42:' || vec_id), 1, 8))::BIGINT / 4294967296.0)), len(c) - 1) AS drawn FROM bands""",
}
