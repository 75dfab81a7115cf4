"""The two jobs of a corpus, end to end: cleaning files, and preparing a dataset from what was cleaned."""

from __future__ import annotations

import posixpath
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bhashaloom.config import Cleaning, Packing
from bhashaloom.functions.unicode import is_blank
from bhashaloom.logs import logger
from bhashaloom.operators.clean import clean, counters, process
from bhashaloom.operators.metrics import extrapolated
from bhashaloom.operators.sample import sample_per_group, shuffled, split_exact
from bhashaloom.operators.stats import char_frequencies, corpus_statistics, top_characters
from bhashaloom.operators.tokens import pack, subword_ids
from bhashaloom.plans.session import spread
from bhashaloom.plans.skew import checkpointed
from bhashaloom.sources.metadata import by_language, dataset_metadata, machine_specs, processing_stats, write_metadata
from bhashaloom.sources.sequences import sequence_files, write_sequences
from bhashaloom.sources.text import read_numbered, require, statistics_report, write_lines


LOG = logger(__name__)


def clean_corpus(spark: SparkSession, source: str, target: str, settings: Cleaning = Cleaning(), sample: int | None = None) -> DataFrame:
    """Cleans the text files of a folder, each file one language.

    Writes the processed lines (``processed``, a folder for each language), statistics (``statistics`` as a table, ``report`` as
    text) and the most frequent characters (``characters``). With a sample size, so many lines of each language
    are kept, or all where there are fewer. Gives the counters. A source that is not there is an error.
    """
    require(spark, [source])
    LOG.info("cleaning %s", source)
    lines = spread(read_numbered(spark, source).select("lang", F.col("place").alias("line_id"), "line"))
    kept = process(lines, "line", "lang", "line_id", settings)
    if sample is not None:
        kept = sample_per_group(kept, "lang", "line_id", sample)
    kept.write.mode("overwrite").partitionBy("lang").parquet(f"{target}/processed")
    kept = spark.read.parquet(f"{target}/processed")
    statistics = corpus_statistics(kept, "lang", "text")
    statistics.write.mode("overwrite").parquet(f"{target}/statistics")
    statistics = spark.read.parquet(f"{target}/statistics")
    top_characters(char_frequencies(kept, "lang", "text", "line_id"), "lang").write.mode("overwrite").parquet(f"{target}/characters")
    write_lines(statistics_report(statistics, "lang", spark.read.parquet(f"{target}/characters")), "report", f"{target}/report", "lang")
    LOG.info("wrote processed lines, statistics, characters and reports to %s", target)
    return counters(lines, "line", "lang", settings)


def prepare_dataset(spark: SparkSession, source: str, target: str, model: str, settings: Packing = Packing()) -> dict:
    """Splits, tokenizes, packs and shuffles a processed corpus (lang, line_id, text) and writes it as sequence files.

    Writes ``sequences`` (a table by language and split), the files ``<language>_<part>_{train,test}.bin`` in ``bin`` and ``metadata``.
    Train sequences are shuffled, test sequences stay in order. Gives the metadata.
    """
    require(spark, [source])
    began = time.monotonic()
    lines = spark.read.parquet(source).where(~is_blank(F.col("text"))).select(F.col("lang").cast("string").alias("lang"), "line_id", "text")
    lines = split_exact(lines, "lang", "line_id", settings.test_ratio, settings.seed)
    keyed = lines.withColumn("key", F.struct("lang", "split", "line_id"))
    # Written once: packing reads the rows several times, and the tokenizer is the costly step.
    tokens = checkpointed(subword_ids(spread(keyed), "key", "text", model).select("key.lang", "key.split", "key.line_id", "tokens"))
    packed = pack(tokens, ["lang", "split"], "line_id", "tokens", settings).withColumn("place", F.col("chunk") * 1_000_000 + F.col("seq"))
    train = shuffled(packed.where("split = 'train'"), ["lang"], "place", settings.seed)
    every = train.unionByName(packed.where("split = 'test'").withColumn("pos", F.col("place")))
    every.select("lang", "split", "pos", "tokens").write.mode("overwrite").partitionBy("lang", "split").parquet(f"{target}/sequences")
    written = spark.read.parquet(f"{target}/sequences").withColumn("lang", F.col("lang").cast("string"))
    for split in ("train", "test"):
        ordered = written.where(F.col("split") == split).repartitionByRange("lang", "pos").sortWithinPartitions("lang", "pos")
        write_sequences(ordered.select("lang", "tokens"), f"{target}/bin", f"_{split}.bin")
        LOG.info("wrote the %s sequences to %s/bin", split, target)
    metadata = dataset_metadata(lines, written, "lang", "split", settings)
    files = {split: [posixpath.basename(f) for f, _ in sequence_files(f"{target}/bin", f"_{split}.bin")] for split in ("train", "test")}
    done = sum(x["total_lines"] for x in metadata["languages"].values())
    metadata |= {"files": by_language(files), "machine_specs": machine_specs(spark), "processing_stats": processing_stats(done, time.monotonic() - began)}
    write_metadata(spark, metadata, f"{target}/metadata")
    LOG.info("prepared %d lines, %.1f a second", done, metadata["processing_stats"]["lines_per_second"])
    return metadata


def retention(frame: DataFrame, line: str, lang: str, key: str, lines: int = 1000, settings: Cleaning = Cleaning()) -> DataFrame:
    """(lang, n_sampled, n_bytes, n_kept, share): how much of a sample of each language the cleaning keeps, before deduplication, and its bytes."""
    sample = sample_per_group(frame.select(key, lang, line), lang, key, lines)
    judged = clean(sample, line, lang, settings)
    return judged.groupBy(lang).agg(
        F.count(F.lit(1)).alias("n_sampled"), F.coalesce(F.sum(F.octet_length(line)), F.lit(0)).cast("bigint").alias("n_bytes"), F.count_if(F.col("text") != "").alias("n_kept"), F.round(F.avg((F.col("text") != "").cast("double")), 6).alias("share")
    )


def processing_estimate(spark: SparkSession, lines: DataFrame, line: str, lang: str, key: str, threads: tuple[int, ...] = (1, 2, 4, 8, 16), sample: int = 1000, settings: Cleaning = Cleaning()) -> DataFrame:
    """extrapolated() at the rate at which this session cleans a sample of each language, which is timed."""
    rates = checkpointed(retention(lines, line, lang, key, sample, settings))
    began = time.monotonic()
    counted = retention(lines, line, lang, key, sample, settings).agg(F.sum("n_bytes")).first()[0] or 0
    per_second = counted / max(time.monotonic() - began, 1e-9)
    LOG.info("sample rate: %.2f KB a second", per_second / 1024)
    totals = lines.groupBy(lang).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length(line)).cast("bigint").alias("size"))
    return extrapolated(rates, totals, lang, per_second / spark.sparkContext.defaultParallelism, threads)
