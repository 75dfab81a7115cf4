"""Samples, splits and shuffles, by digests of keys: the same on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bhashaloom.functions.keyed import order_key
from bhashaloom.functions.text import shortened
from bhashaloom.functions.unicode import is_blank, strip
from bhashaloom.plans.ranking import digest_rank, first_by_digest, order_bucket, with_rank


def sample_per_group(frame: DataFrame, group: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows of each group without replacement; all rows of a smaller group. Rows with the key of the last one all come out."""
    return first_by_digest(frame, [group], order_key(seed, F.col(key)), key, F.lit(k), "__taken").where("__taken").drop("__taken")


def sample_proportional(frame: DataFrame, lang: str, line: str, key: str, sizes: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """Of each language floor(size / sum of sizes * target) non-blank lines, stripped, with their shuffled position.

    sizes: (lang, size) as declared, one row per language; languages without a row or size are left out. Fewer lines come out where
    fewer are there. Only the lines that are taken are ranked.
    """
    known = sizes.where("size IS NOT NULL")
    total = known.agg(F.sum("size")).first()[0] or 1  # one row
    quotas = known.select(lang, F.floor(F.col("size") / F.lit(float(total)) * F.lit(target)).alias("__quota"))
    lines = frame.where(~is_blank(F.col(line))).join(quotas, lang)
    digest = order_key(seed, F.col(key))
    taken = first_by_digest(lines.select(lang, key, line, "__quota"), [lang, "__quota"], digest, key, F.col("__g.__quota"), "__taken").where("__taken")
    ranked = digest_rank(taken, [lang], digest, [key], "position", digits=3 if target < 10**9 else 5)
    return ranked.select(lang, key, "position", strip(F.col(line)).alias("text"))


def head_sample(frame: DataFrame, group: str, line_no: str, line: str, key: str, k: int = 10, seed: int = 42) -> DataFrame:
    """k of the non-blank lines among the first 10 k of each group, shortened for display."""
    head = frame.where((F.col(line_no) <= 10 * k) & ~is_blank(F.col(line)))
    return sample_per_group(head, group, key, k, seed).select(group, key, shortened(strip(F.col(line))).alias("shown"))


def split_exact(frame: DataFrame, group: str, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Frame with ``split``: floor(n * ratio) rows of each group are test, the others train."""
    quota = F.floor(F.col("size") * F.lit(ratio))
    judged = first_by_digest(frame, [group], order_key(seed, F.col(key)), key, quota, "__test")
    return judged.select(*frame.columns, F.when(F.col("__test"), "test").otherwise("train").alias("split"))


def shuffled(frame: DataFrame, group: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """Frame with ``pos``, a permutation of each group, from 1; tables have no order, so that the position is a column."""
    return digest_rank(frame, group, order_key(seed, F.col(key)), [key], "pos")


def buffer_shuffled(frame: DataFrame, group: str, key: str, buffer_rows: int = 250_000, seed: int = 42) -> DataFrame:
    """Frame with ``buffer`` and ``pos``: buffers of consecutive rows in shuffled order, shuffled rows within each."""
    numbered = with_rank(frame, [group], order_bucket(frame, key), [key], "__nth").withColumn("buffer", F.floor((F.col("__nth") - 1) / buffer_rows))
    place = F.concat(order_key(seed, F.col("buffer")), order_key(seed, F.col(key)))
    return with_rank(numbered, [group], F.substring(place, 1, 3), [place, key], "pos").drop("__nth")
