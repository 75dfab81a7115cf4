"""Cleaning of lines: normalization, filters and exact deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bhashaloom.config import Cleaning
from bhashaloom.functions import text as X
from bhashaloom.functions.unicode import is_blank, strip


def _judged(frame: DataFrame, line: str, lang: str, settings: Cleaning) -> tuple[DataFrame, Column, list[str]]:
    """Frame with the steps' columns, the cleaned line as an expression, null if the line is rejected, and those columns' names."""
    source = F.when(~is_blank(F.col(line)), F.col(line)).otherwise(F.lit(""))
    staged = frame.withColumn("__a", X.drop_controls(X.clean_whitespace(X.remove_html(source))))
    if settings.clean_unicode:
        staged = staged.withColumn("__b", X.nfkc(F.col("__a"))).withColumn("__c", X.normalize_script(F.col("__b"), F.col(lang)))
    else:
        staged = staged.withColumns({"__b": F.col("__a"), "__c": F.col("__a")})
    staged = staged.withColumn("__l", X.letters_of(F.col("__c")))
    letters, keep = F.length("__l"), F.lit(True)
    if settings.remove_low_quality:
        keep = X.is_quality(F.col("__c"), letters, settings.min_length, settings.max_repeats, settings.min_alpha)
    if settings.script_filtering:
        keep = keep & X.is_target_script(letters, X.script_count(F.col("__l"), F.col(lang), settings.script_ranges), settings.min_script)
    return staged, F.when(keep, strip(F.col("__c"))), ["__a", "__b", "__c", "__l"]


def clean(frame: DataFrame, line: str, lang: str, settings: Cleaning = Cleaning(), out: str = "text") -> DataFrame:
    """Frame with the cleaned line, which is empty if the line is rejected.

    The order of the steps is fixed: blank test, tags, white space, controls, Unicode and script, quality,
    script filter, strip. The filters see the text before it is stripped. Null lines are blank.
    """
    staged, text, made = _judged(frame, line, lang, settings)
    return staged.withColumn(out, F.coalesce(text, F.lit(""))).drop(*made)


def kept_lines(frame: DataFrame, line: str, lang: str, settings: Cleaning = Cleaning(), out: str = "text") -> DataFrame:
    """Frame with the cleaned line, without rejected lines and those of which nothing is left.

    They are dropped by exploding none or one text: a filter would be pushed below the steps and repeat them.
    """
    staged, text, made = _judged(frame, line, lang, settings)
    staged = staged.withColumn("__t", text)
    return staged.select("*", F.explode(F.when(F.col("__t") != "", F.array("__t"))).alias(out)).drop(*made, "__t")


def first_of_each(frame: DataFrame, lang: str, text: str, order: str) -> DataFrame:
    """(lang, text, order) of each distinct text of a language, at its first place.

    Copies are merged before they are shuffled, so that a line of a third of the rows is no burden to one task.
    """
    return frame.groupBy(lang, text).agg(F.min(order).alias(order))


def process(frame: DataFrame, line: str, lang: str, order: str, settings: Cleaning = Cleaning()) -> DataFrame:
    """The processed corpus: (lang, order, text) of the lines that are kept."""
    kept = kept_lines(frame.select(order, lang, line), line, lang, settings)
    if settings.deduplicate:
        return first_of_each(kept, lang, "text", order).select(lang, order, "text")
    return kept.select(lang, order, "text")


def counters(frame: DataFrame, line: str, lang: str, settings: Cleaning = Cleaning()) -> DataFrame:
    """Lines read, kept and skipped by language; skipped ones are rejected or repeated."""
    per_text = clean(frame.select(lang, line), line, lang, settings).groupBy(lang, "text").agg(F.count(F.lit(1)).alias("n"))
    kept = F.when(F.col("text") == "", 0).otherwise(F.lit(1) if settings.deduplicate else F.col("n"))
    return per_text.groupBy(lang).agg(F.sum("n").alias("n_read"), F.sum(kept).cast("bigint").alias("n_kept")).withColumn("n_skipped", F.col("n_read") - F.col("n_kept"))
