"""Queries on lines: cleaning, filters, deduplication, statistics, samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bhashaloom.config import EXTRA_SCRIPT_RANGES, FILE_LANGUAGES, SCRIPT_RANGES, Cleaning
from bhashaloom.functions import text as X
from bhashaloom.functions.unicode import is_blank, strip
from bhashaloom.operators import sample as S
from bhashaloom.operators.clean import counters, first_of_each, process
from bhashaloom.operators.stats import char_frequencies, corpus_statistics, top_characters
from bhashaloom.plans.jobs import retention
from bhashaloom.plans.session import spread, table

_RANGES = SCRIPT_RANGES | EXTRA_SCRIPT_RANGES
_SETTINGS = Cleaning(script_ranges=_RANGES)


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    """Collected lines; the language of a line is that of its file."""
    lines = table(spark, folder, "raw_lines").select("line_id", "file_name", "line_no", "line")
    return spread(lines).withColumn("lang", X.language_of_file(F.col("file_name"), FILE_LANGUAGES))


def _prepared(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "prepared_lines").select("line_id", "lang", "line_no", "line"))


def _full(frame: DataFrame) -> DataFrame:
    return frame.where(~is_blank(F.col("line")))


def clean_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines without tags, runs of white space and control characters."""
    text = strip(X.drop_controls(X.clean_whitespace(X.remove_html(F.col("line")))))
    return _full(_raw(spark, folder)).select("line_id", text.alias("cleaned"))


def nfkc_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines in normalization form KC."""
    return _full(_raw(spark, folder)).select("line_id", X.nfkc(F.col("line")).alias("normal"))


def normalize_script(spark: SparkSession, folder: str) -> DataFrame:
    """Lines after the replacements of their language."""
    return _full(_raw(spark, folder)).select("line_id", X.normalize_script(F.col("line"), F.col("lang")).alias("normal"))


def _measured(spark: SparkSession, folder: str, ranges: dict) -> DataFrame:
    line = F.col("line")
    staged = _full(_raw(spark, folder)).withColumn("letters", X.letters_of(line))
    return staged.withColumns({"n_alpha": F.length("letters"), "n_script": X.script_count(F.col("letters"), F.col("lang"), ranges)})


def quality_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Length, letters and repetition of each line, and whether it is kept."""
    line, letters = F.col("line"), F.col("n_alpha")
    return _measured(spark, folder, _RANGES).select(
        "line_id", F.length(line).cast("bigint").alias("n_chars"), letters.cast("bigint").alias("n_alpha"), X.is_repetitive(line).alias("repetitive"), X.is_quality(line, letters).alias("kept")
    )


def script_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Letters of each line within its language's script, and whether it is kept."""
    return _measured(spark, folder, _RANGES).select("line_id", "lang", F.col("n_script").cast("bigint").alias("n_script"), X.is_target_script(F.col("n_alpha"), F.col("n_script")).alias("kept"))


def script_filter_unknown_lang(spark: SparkSession, folder: str) -> DataFrame:
    """Lines kept by language where only six languages have a script; others pass."""
    kept = _measured(spark, folder, SCRIPT_RANGES).where(X.is_target_script(F.col("n_alpha"), F.col("n_script")))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"))


def preprocess_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The processed corpus: every distinct clean line of a language, at its first place."""
    return process(_raw(spark, folder), "line", "lang", "line_id", _SETTINGS)


def preprocess_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Lines read, kept and skipped by language."""
    return counters(_raw(spark, folder), "line", "lang", _SETTINGS)


def dedup_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct stripped line of a language with its digest, at its first place."""
    lines = _full(_raw(spark, folder)).select("lang", "line_id", strip(F.col("line")).alias("text"))
    return first_of_each(lines, "lang", "text", "line_id").select("lang", "line_id", F.md5("text").alias("digest"))


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the prepared corpus by language."""
    return corpus_statistics(_prepared(spark, folder), "lang", "line")


def char_freq(spark: SparkSession, folder: str) -> DataFrame:
    """Frequency of each character by language."""
    return char_frequencies(_prepared(spark, folder), "lang", "line", "line_id").select("lang", "ch", "cnt")


def top_chars(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty most frequent characters of each language."""
    return top_characters(char_frequencies(_prepared(spark, folder), "lang", "line", "line_id"), "lang")


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of each document."""
    documents = table(spark, folder, "documents").where("text IS NOT NULL")
    return documents.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("nth", "sentence")).withColumn("nth", F.col("nth").cast("bigint"))


def line_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Physical and non-blank lines of each file."""
    return _raw(spark, folder).groupBy("file_name", "lang").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(~is_blank(F.col("line"))).alias("n_full"))


def sample_k_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A thousand lines of each file's language."""
    return S.sample_per_group(_full(_raw(spark, folder)), "lang", "line_id", 1000).select("lang", "line_id")


def sample_proportional(spark: SparkSession, folder: str) -> DataFrame:
    """Two thousand lines, of each language by its declared size."""
    sizes = table(spark, folder, "languages").select("lang", F.col("declared_lines").alias("size"))
    return S.sample_proportional(_prepared(spark, folder), "lang", "line", "line_id", sizes, 2000)


def head_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Ten of the first hundred lines of each file, shortened."""
    return S.head_sample(_raw(spark, folder), "file_name", "line_no", "line", "line_id")


def train_test_split(spark: SparkSession, folder: str) -> DataFrame:
    """Each prepared line's new split: exactly a twentieth of each language is test."""
    return S.split_exact(_prepared(spark, folder), "lang", "line_id", 0.05).select("line_id", "lang", "split")


def retention_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """How much of a thousand lines of each file's language the cleaning keeps."""
    return retention(_raw(spark, folder), "line", "lang", "line_id", 1000, _SETTINGS)


QUERIES = {
    f.__name__: f
    for f in (
        clean_lines, nfkc_lines, normalize_script, quality_filter, script_filter, script_filter_unknown_lang, preprocess_pipeline, preprocess_counters, dedup_lines, corpus_stats,
        char_freq, top_chars, sentences, line_counts, sample_k_lines, sample_proportional, head_sample, train_test_split, retention_estimate,
    )
}
