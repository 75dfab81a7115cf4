"""The description of a prepared dataset, and summaries of runs, as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bhashaloom.config import Packing
from bhashaloom.operators.metrics import gigabytes


def dataset_metadata(lines: DataFrame, sequences: DataFrame, lang: str, split: str, settings: Packing = Packing()) -> dict:
    """Sizes of a prepared dataset: lines and sequences of each language and split."""
    out = {"sequence_length": settings.sequence_length, "vocab_size": settings.vocabulary, "dtype": "uint16", "train_test_ratio": settings.test_ratio, "languages": {}, "sequence_counts": {"train": {}, "test": {}}}
    for r in lines.groupBy(lang).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(split) == "train").alias("a"), F.count_if(F.col(split) == "test").alias("b")).collect():  # a row per language
        out["languages"][str(r[lang])] = {"total_lines": r["n"], "train_lines": r["a"], "test_lines": r["b"]}
    for r in sequences.groupBy(lang, split).agg(F.count(F.lit(1)).alias("n")).collect():
        out["sequence_counts"].setdefault(r[split], {})[str(r[lang])] = r["n"]
    return out


def by_language(files: dict[str, list[str]]) -> dict[str, dict[str, list[str]]]:
    """File names of each split by the language that their names begin with."""
    out: dict[str, dict[str, list[str]]] = {}
    for split, names in files.items():
        out[split] = {}
        for name in names:
            out[split].setdefault(name.split("_")[0], []).append(name)
    return out


def machine_specs(spark: SparkSession) -> dict:
    """What the session runs on: tasks at a time, executors, and the memory of each, in GB."""
    context = spark.sparkContext
    memory = context._jsc.sc().getExecutorMemoryStatus()
    each, most = memory.valuesIterator(), []
    while each.hasNext():
        most.append(each.next()._1())
    return {"vcpus": context.defaultParallelism, "workers": max(1, len(most) - 1), "memory_gb": round(gigabytes(sum(most)), 3)}


def processing_stats(lines: int, seconds: float) -> dict:
    """Time, lines and lines a second of a job."""
    return {"total_time_seconds": seconds, "lines_processed": lines, "lines_per_second": lines / seconds if seconds > 0 else 0.0}


def write_metadata(spark: SparkSession, metadata: dict, path: str) -> None:
    """One JSON document in a folder."""
    spark.createDataFrame([(json.dumps(metadata, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Summaries of runs, one JSON object each; runs may lack any key. Keys with slashes are columns of that name."""
    return spark.read.option("multiLine", True).json(path)


def append_metrics(frame: DataFrame, path: str) -> None:
    """Adds metric rows to a table."""
    frame.write.mode("append").parquet(path)
