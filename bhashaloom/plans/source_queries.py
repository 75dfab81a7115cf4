"""Queries on readers, writers, loaders and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bhashaloom.config import FILE_LANGUAGES, Packing
from bhashaloom.functions.text import language_of_file
from bhashaloom.operators import metrics as M
from bhashaloom.operators.stats import char_frequencies, corpus_statistics, top_characters
from bhashaloom.plans.jobs import retention
from bhashaloom.plans.line_queries import _SETTINGS, _prepared, _raw
from bhashaloom.plans.line_sql import FILE_LANG
from bhashaloom.plans.line_sql import SQL as LINES
from bhashaloom.plans.loading import Loader
from bhashaloom.plans.sequence_queries import shared_folder
from bhashaloom.plans.session import table
from bhashaloom.sources.metadata import append_metrics, dataset_metadata, read_metadata, write_metadata
from bhashaloom.sources.text import line_offsets, lines_at, read_numbered, statistics_report, write_lines


def _one_line(spark: SparkSession, folder: str) -> DataFrame:
    """Prepared lines that hold no line end of their own, each after its number."""
    lines = table(spark, folder, "prepared_lines").where("line IS NOT NULL").withColumn("line", F.translate("line", "\n\r", "  "))
    return lines.select("line_id", "is_test", F.concat_ws("\t", F.col("line_id").cast("string"), "line").alias("text"))


def _parted(line: str) -> list:
    """The number and the text of such a line."""
    return [F.split_part(line, F.lit("\t"), F.lit(1)).cast("bigint").alias("line_id"), F.regexp_replace(line, "^[^\t]*\t", "").alias("line")]


def text_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """All prepared lines written as text files and read again by universal line ends: number and text."""
    path = shared_folder(spark)
    write_lines(_one_line(spark, folder), "text", path)
    return read_numbered(spark, path).select(*_parted("line"))


def lines_by_offset(spark: SparkSession, folder: str) -> DataFrame:
    """The test lines, fetched from text files of all lines by the bytes at which they begin."""
    path = shared_folder(spark)
    write_lines(_one_line(spark, folder), "text", path)
    lines = line_offsets(spark, path)
    tests = table(spark, folder, "prepared_lines").where("is_test").select("line_id")
    index = lines.select("file_name", "offset", _parted("line")[0]).join(tests, "line_id", "left_semi").select("file_name", "offset")
    return lines_at(lines, index).select(*_parted("line"))


def statistics_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The report on each language of the prepared lines, with its most frequent characters."""
    lines = _prepared(spark, folder)
    return statistics_report(corpus_statistics(lines, "lang", "line"), "lang", top_characters(char_frequencies(lines, "lang", "line", "line_id"), "lang"))


def metadata_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the dataset, written as metadata and read again: lines, and sequences of each split, by language."""
    path = shared_folder(spark)
    split = F.when(F.col("is_test"), "test").when(~F.col("is_test"), "train")
    lines = table(spark, folder, "prepared_lines").select("lang", split.alias("split_name"))
    write_metadata(spark, dataset_metadata(lines, table(spark, folder, "packed_seqs").select("lang", "split_name"), "lang", "split_name", Packing()), path)
    read = read_metadata(spark, path)
    counts = read["sequence_counts"]
    rows = [(g, n["total_lines"], n["train_lines"], n["test_lines"], counts["train"].get(g, 0), counts["test"].get(g, 0)) for g, n in read["languages"].items()]
    return spark.createDataFrame(rows, "lang string, total_lines bigint, train_lines bigint, test_lines bigint, train_sequences bigint, test_sequences bigint")


def metrics_table(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of the events, added to a table in two steps and read again: rows and mean by type."""
    path = shared_folder(spark)
    events = table(spark, folder, "events").select("event_type", "value")
    for half in (events.where("value < 5"), events.where("value >= 5 OR value IS NULL")):
        append_metrics(half, path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def file_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Shard files of the train split whose name holds a part of a language's."""
    name = F.col("file_name")
    return table(spark, folder, "bin_files").where(name.rlike("_train(_[0-9]+)?[.]bin$") & name.contains("mala")).select("file_name").distinct()


def named_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each collected file as it is shown, and as it begins the names of files."""
    files = table(spark, folder, "raw_lines").select("file_name").distinct()
    named = files.select("file_name", language_of_file(F.col("file_name"), FILE_LANGUAGES).alias("lang"))
    return named.select("file_name", F.initcap("lang").alias("shown"), F.lower("lang").alias("stem"))


def _loader(spark: SparkSession, folder: str) -> Loader:
    return Loader(table(spark, folder, "packed_seqs").select("split_name", "lang", "seq_id", "tokens"), 16)


def loader_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """What a loader holds of each split and language, and the batches it has given after three of train and one of test."""
    loader = _loader(spark, folder)
    loader.next_batch()
    loader.language_batch(loader.languages()[0])
    loader.batch_of("test", min(loader.counts["test"]))
    loader.language_batch(loader.languages()[0])
    return loader.statistics()


def switched_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of sixteen of the first language: two of train, one of test, and one of train, which goes on where it was."""
    loader = _loader(spark, folder)
    first = loader.languages()[0]
    taken = [loader.language_batch(first), loader.language_batch(first)]
    loader.switch_mode("test")
    taken.append(loader.language_batch(loader.languages()[0]))
    loader.switch_mode("train")
    taken.append(loader.language_batch(first))
    numbered = [batch.withColumn("turn", F.lit(i).cast("bigint")) for i, batch in enumerate(taken)]
    out = numbered[0]
    for more in numbered[1:]:
        out = out.unionByName(more)
    return out.select("turn", "slot", "lang", "seq_id", "tokens")


def processing_times(spark: SparkSession, folder: str) -> DataFrame:
    """What cleaning each file's language takes and leaves at a thousand KB a second and thread, by the share that a sample keeps."""
    lines = _raw(spark, folder)
    rates = retention(lines, "line", "lang", "line_id", 1000, _SETTINGS)
    totals = lines.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("line")).cast("bigint").alias("size"))
    return M.extrapolated(rates, totals, "lang", 1000 * 1024.0)


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """By piece of collected lines: lines a second between its first and last, and seconds that all other lines would take."""
    at = lambda c: F.unix_micros(c.cast("timestamp"))
    lines = table(spark, folder, "raw_lines").select("piece_no", "fetched_at")
    seconds = (at(F.max("fetched_at")) - at(F.min("fetched_at"))) / F.lit(1e6)
    pieces = lines.groupBy("piece_no").agg(F.count(F.lit(1)).alias("n_lines"), seconds.alias("seconds"))
    total = F.lit(lines.count())
    rate = M.line_rate(F.col("n_lines"), F.col("seconds"))
    return pieces.select("piece_no", "n_lines", F.round(rate, 6).alias("lines_per_second"), F.round(M.remaining_seconds(total, F.col("n_lines"), rate), 3).alias("seconds_left"))


QUERIES = {
    f.__name__: f
    for f in (text_roundtrip, lines_by_offset, statistics_reports, metadata_sizes, metrics_table, file_choice, named_languages, loader_statistics, switched_batches, processing_times, progress)
}

_PLAIN = "SELECT line_id, translate(line, chr(10) || chr(13), '  ') AS line FROM prepared_lines WHERE line IS NOT NULL"
_SHOWN = "CASE WHEN ch IN (chr(10), chr(9), chr(13), ' ') THEN unicode(ch)::VARCHAR ELSE ch END"


def _number(x: str) -> str:
    return f"format('{{:,}}', {x})"


SQL = {
    "text_roundtrip": _PLAIN,
    "lines_by_offset": f"{_PLAIN} AND is_test",
    "statistics_reports": f"""WITH stats AS ({LINES['corpus_stats']}), tops AS ({LINES['top_chars']}),
listed AS (SELECT lang, string_agg('  ' || chr(39) || {_SHOWN} || chr(39) || ': ' || {_number('cnt')}, chr(10) ORDER BY place) AS listing FROM tops GROUP BY lang)
SELECT s.lang, concat_ws(chr(10), 'Language: ' || upper(s.lang[1]) || lower(s.lang[2:]), 'Lines: ' || {_number('line_count')}, 'Words: ' || {_number('word_count')}, 'Characters: ' || {_number('char_count')},
'Vocabulary: ' || {_number('vocab_size')}, 'Distinct characters: ' || {_number('unique_chars')}, 'Mean word length: ' || printf('%.2f', avg_word_length), 'Mean sentence length: ' || printf('%.2f', avg_sentence_length),
'Most frequent characters:', coalesce(listing, '')) AS report FROM stats s LEFT JOIN listed l ON s.lang IS NOT DISTINCT FROM l.lang""",
    "metadata_sizes": """WITH l AS (SELECT coalesce(lang, 'None') AS lang, count(*) AS total_lines, count(*) FILTER (WHERE NOT is_test) AS train_lines, count(*) FILTER (WHERE is_test) AS test_lines FROM prepared_lines GROUP BY ALL),
s AS (SELECT coalesce(lang, 'None') AS lang, count(*) FILTER (WHERE split_name = 'train') AS a, count(*) FILTER (WHERE split_name = 'test') AS b FROM packed_seqs GROUP BY ALL)
SELECT l.*, coalesce(a, 0) AS train_sequences, coalesce(b, 0) AS test_sequences FROM l LEFT JOIN s ON l.lang = s.lang""",
    "metrics_table": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "file_choice": "SELECT DISTINCT file_name FROM bin_files WHERE regexp_matches(file_name, '_train(_[0-9]+)?[.]bin$') AND contains(file_name, 'mala')",
    "named_languages": f"SELECT DISTINCT file_name, upper(l[1]) || lower(l[2:]) AS shown, lower(l) AS stem FROM (SELECT file_name, {FILE_LANG} AS l FROM raw_lines)",
    "loader_statistics": """SELECT split_name AS mode, lang, n AS n_sequences, round(n / sum(n) OVER (PARTITION BY split_name), 9) AS weight, (CASE split_name WHEN 'train' THEN 3 ELSE 1 END)::BIGINT AS consumed
FROM (SELECT split_name, lang, count(*) AS n FROM packed_seqs WHERE lang IS NOT NULL AND split_name IN ('train', 'test') GROUP BY ALL)""",
    "switched_batches": """WITH numbered AS (SELECT split_name, lang, seq_id, tokens, row_number() OVER (PARTITION BY split_name, lang ORDER BY seq_id) - 1 AS n FROM packed_seqs WHERE lang IS NOT NULL),
named AS (SELECT split_name, min(lang) AS first FROM packed_seqs GROUP BY split_name),
rounds AS (SELECT b.split_name, ceil(count(*) / 16)::BIGINT AS batches FROM numbered b JOIN named n ON b.split_name = n.split_name AND b.lang = n.first GROUP BY b.split_name),
turns AS (SELECT * FROM (VALUES (0::BIGINT, 'train', 0), (1, 'train', 1), (2, 'test', 0), (3, 'train', 2)) t(turn, split_name, nth))
SELECT turn, n % 16 AS slot, b.lang, seq_id, tokens FROM turns t JOIN named f ON t.split_name = f.split_name JOIN rounds r ON t.split_name = r.split_name
JOIN numbered b ON b.split_name = t.split_name AND b.lang = f.first AND n // 16 = nth % batches""",
    "processing_times": f"""WITH rates AS ({LINES['retention_estimate']}), raw AS (SELECT line, {FILE_LANG} AS lang FROM raw_lines),
totals AS (SELECT lang, count(*) AS n_lines, sum(strlen(line))::BIGINT AS size FROM raw GROUP BY lang)
SELECT t.lang, n_lines, round(size / 1048576.0::DOUBLE, 6) AS megabytes, round(n_lines * share)::BIGINT AS kept_lines, threads, round(size / 1024000.0::DOUBLE / threads, 6) AS seconds
FROM totals t JOIN rates r ON t.lang = r.lang, (SELECT unnest([1, 2, 4, 8, 16])::BIGINT AS threads)""",
    "progress": """SELECT piece_no, n AS n_lines, round(n / nullif(s, 0), 6) AS lines_per_second, round(((SELECT count(*) FROM raw_lines) - n) / nullif(n / nullif(s, 0), 0), 3) AS seconds_left
FROM (SELECT piece_no, count(*) AS n, (epoch_us(max(fetched_at)) - epoch_us(min(fetched_at))) / 1e6::DOUBLE AS s FROM raw_lines GROUP BY piece_no)""",
}
