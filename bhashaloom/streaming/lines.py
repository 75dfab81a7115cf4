"""Lines and metrics as they come in. An extension: bounded state, late data within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bhashaloom.config import Cleaning
from bhashaloom.operators.clean import kept_lines


def stream_lines(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number of them at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def clean_stream(lines: DataFrame, line: str, lang: str, at: str, delay: str = "1 hour", settings: Cleaning = Cleaning()) -> DataFrame:
    """Cleaned lines of a stream, each text of a language once within the delay; later ones count as new."""
    kept = kept_lines(lines.withWatermark(at, delay), line, lang, settings)
    return kept.dropDuplicatesWithinWatermark([lang, "text"]) if settings.deduplicate else kept


def windowed_counts(lines: DataFrame, lang: str, at: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Lines of each language by tumbling window; rows later than the delay are left out."""
    return lines.withWatermark(at, delay).groupBy(F.window(at, width), lang).agg(F.count(F.lit(1)).alias("n_lines")).select(F.col("window.start").alias("start"), lang, "n_lines")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes a stream to Parquet, each row once, and stops when all that is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
