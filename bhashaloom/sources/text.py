"""Text files as lines, and lines as text files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bhashaloom.config import FILE_LANGUAGES
from bhashaloom.functions.text import language_of_file
from bhashaloom.logs import logger


@F.pandas_udf(T.StringType())
def _lossy(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def _readable(value: Column) -> Column:
    """Text without the bytes that are not UTF-8; only lines that hold some pass through Python."""
    return F.coalesce(_lossy(F.when(~F.is_valid_utf8(value), value.cast("binary"))), value)


def _raw_lines(spark: SparkSession, path: str, pattern: str, line_separator: str | None = None) -> DataFrame:
    """(file_path, file_name, start, value): lines with the file and the first byte of the part of it that a task reads."""
    reader = spark.read.option("pathGlobFilter", pattern)
    if line_separator is not None:
        reader = reader.option("lineSep", line_separator)
    meta = F.col("_metadata")
    return reader.text(path).select(meta["file_path"].alias("file_path"), meta["file_name"].alias("file_name"), meta["file_block_start"].alias("start"), F.col("value"))


def read_lines(spark: SparkSession, path: str, pattern: str = "*.txt", line_separator: str | None = None) -> DataFrame:
    """(file_name, lang, line) of the text files of a folder, or of one file.

    Lines end at a line feed, a carriage return or both, unless a separator is given. Bytes that are not UTF-8 are left
    out; only lines that hold some pass through Python. An empty folder gives no rows.
    """
    rows = _raw_lines(spark, path, pattern, line_separator)
    return rows.select("file_name", language_of_file(F.col("file_name"), FILE_LANGUAGES).alias("lang"), _readable(F.col("value")).alias("line"))


def read_numbered(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(file_name, lang, place, line): read_lines with a number that rises along a file, on any file system that Spark reads.

    A line is no shorter than its end, so that the first byte of its part of the file and the rows read before it make places that
    rise within the part, and from part to part, as parts of a file that has several are read by a task of their own.
    """
    rows = _raw_lines(spark, path, pattern).withColumn("place", F.col("start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return rows.select("file_name", language_of_file(F.col("file_name"), FILE_LANGUAGES).alias("lang"), "place", _readable(F.col("value")).alias("line"))


def line_offsets(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(file_name, offset, line): the byte at which each line begins names it and gives its place in the file. Only line feeds end lines.

    Sizes of lines are summed up within each part of a file that a task reads, and sizes of parts over the file.
    """
    rows = _raw_lines(spark, path, pattern, "\n").withColumns({"__row": F.monotonically_increasing_id(), "__bytes": F.octet_length("value").cast("bigint") + 1})
    within = Window.partitionBy("file_path", "start").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("__path").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(F.col("file_path").alias("__path"), F.col("start").alias("__start")).agg(F.sum("__bytes").alias("__size"))
    parts = parts.select("__path", "__start", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))  # a row for each part of a file
    placed = rows.withColumn("__within", F.coalesce(F.sum("__bytes").over(within), F.lit(0)))
    joined = placed.join(parts, (F.col("file_path") == F.col("__path")) & (F.col("start") == F.col("__start")))
    return joined.select("file_name", (F.col("__before") + F.col("__within")).alias("offset"), _readable(F.col("value")).alias("line"))


def lines_at(lines: DataFrame, index: DataFrame) -> DataFrame:
    """The lines whose (file_name, offset) an index lists."""
    return lines.join(index.select("file_name", "offset").distinct(), ["file_name", "offset"], "left_semi")


def existing(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """Paths that are there and paths that are not, on any file system that Spark knows."""
    there, missing = [], []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        (there if system.exists(at) else missing).append(path)
    return there, missing


def require(spark: SparkSession, paths: list[str]) -> None:
    """Fails unless all paths are there."""
    if missing := existing(spark, paths)[1]:
        raise FileNotFoundError(", ".join(missing))


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are there; of each other one a warning is logged."""
    there, missing = existing(spark, paths)
    for path in missing:
        logger(__name__).warning("left out, as it is not there: %s", path)
    return there


def write_lines(frame: DataFrame, text: str, path: str, by: str | None = None) -> None:
    """One line of text per row, in folders by a column if one is named. The job's commit makes the files appear at once."""
    if by is None:
        frame.select(text).write.mode("overwrite").text(path)
    else:
        frame.select(by, text).write.mode("overwrite").partitionBy(by).text(path)


def shown_character(ch: Column) -> Column:
    """A character between quotation marks; line ends, tabs and spaces by their code points."""
    return F.concat(F.lit("'"), F.when(ch.isin("\n", "\t", "\r", " "), F.ascii(ch).cast("string")).otherwise(ch), F.lit("'"))


def statistics_report(statistics: DataFrame, lang: str, characters: DataFrame | None = None) -> DataFrame:
    """(lang, report): the statistics of a language as lines of text, with thousands separated, and its most frequent characters.

    characters: (lang, place, ch, cnt) as top_characters gives them.
    """
    count = lambda c: F.format_number(F.col(c), 0)
    mean = lambda c: F.format_number(F.col(c), 2)
    lines = [
        F.concat(F.lit("Language: "), F.initcap(F.col(lang))), F.concat(F.lit("Lines: "), count("line_count")), F.concat(F.lit("Words: "), count("word_count")),
        F.concat(F.lit("Characters: "), count("char_count")), F.concat(F.lit("Vocabulary: "), count("vocab_size")), F.concat(F.lit("Distinct characters: "), count("unique_chars")),
        F.concat(F.lit("Mean word length: "), mean("avg_word_length")), F.concat(F.lit("Mean sentence length: "), mean("avg_sentence_length")),
    ]
    if characters is None:
        return statistics.select(lang, F.concat_ws("\n", *lines).alias("report"))
    row = F.concat(shown_character(F.col("ch")), F.lit(": "), F.format_number("cnt", 0))
    listed = characters.groupBy(F.col(lang).alias("__lang")).agg(F.sort_array(F.collect_list(F.struct("place", row.alias("row")))).alias("__rows"))  # a few characters of each language
    joined = statistics.join(listed, F.col(lang).eqNullSafe(F.col("__lang")), "left")
    more = F.transform(F.coalesce("__rows", F.array().cast("array<struct<place:bigint,row:string>>")), lambda x: F.concat(F.lit("  "), x["row"]))
    return joined.select(lang, F.concat_ws("\n", *lines, F.lit("Most frequent characters:"), F.array_join(more, "\n")).alias("report"))
