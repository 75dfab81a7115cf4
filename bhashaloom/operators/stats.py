"""Statistics of a corpus, by language. Each text is taken apart once, in Arrow batches; only sums and distinct items are shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bhashaloom.functions.text import SENTENCE_END

#: Distinct words that a task holds back at most before it passes them on.
HELD_WORDS = 200_000
_SENTENCE_END = re.compile(SENTENCE_END)


def _characters(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines one after the other, each with its line end, and where each line begins, and the end."""
    codes = np.frombuffer("".join(f"{x}\n" for x in lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(x) + 1 for x in lines), np.int64, len(lines))
    return codes, np.concatenate([[0], np.cumsum(sizes)])


def char_frequencies(frame: DataFrame, lang: str, text: str, order: str) -> DataFrame:
    """(lang, ch, cnt, first_line, first_pos) of each character, the line end of each non-blank line included.

    order: a whole number. Characters are counted within each batch; a row for each distinct one of a language leaves it.
    """
    kind = frame.schema[lang].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, x in enumerate(batch.column("text").to_pylist()) if x is not None and not x.isspace() and x]
            batch = batch.take(pa.array(keep, pa.int64()))
            place = batch.column("order").to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(np.argsort(place, kind="stable")))
            place = np.sort(place)
            names = batch.column("lang").dictionary_encode()
            of_line = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            codes, starts = _characters(batch.column("text").to_pylist())
            line = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            found, first, count = np.unique(of_line[line] * 0x110000 + codes, return_index=True, return_counts=True)
            langs = pa.concat_arrays([names.dictionary, pa.nulls(1, names.dictionary.type)]).take(pa.array(found // 0x110000))
            columns = [langs, pa.array([chr(c) for c in (found % 0x110000).tolist()], pa.string()), pa.array(count), pa.array(place[line[first]]), pa.array(first - starts[line[first]])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "ch", "cnt", "line", "pos"])

    out = T.StructType([T.StructField("lang", kind), *(T.StructField(c, t) for c, t in (("ch", T.StringType()), ("cnt", T.LongType()), ("line", T.LongType()), ("pos", T.LongType())))])
    counted = frame.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(order).cast("bigint").alias("order")).mapInArrow(run, out)
    # One decimal number for line and position: unlike a struct it can be kept in the buffers of a hash aggregation.
    place = F.col("line").cast("decimal(20,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("pos")
    grouped = counted.groupBy(F.col("lang").alias(lang), "ch").agg(F.sum("cnt").alias("cnt"), F.min(place.cast("decimal(38,0)")).alias("first"))
    return grouped.select(lang, "ch", "cnt", F.floor(F.col("first") / 10**10).cast("bigint").alias("first_line"), (F.col("first") % 10**10).cast("bigint").alias("first_pos"))


def top_characters(frequencies: DataFrame, lang: str, k: int = 20) -> DataFrame:
    """The k most frequent characters of each language, earlier seen ones first among equals."""
    order = Window.partitionBy(lang).orderBy(F.desc("cnt"), "first_line", "first_pos")
    return frequencies.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(lang, F.col("place").cast("bigint").alias("place"), "ch", "cnt")


def corpus_statistics(frame: DataFrame, lang: str, text: str) -> DataFrame:
    """Per language: lines, words, characters with line ends, distinct words and characters, mean word and sentence length.

    Blank lines count as lines only. Means without anything to average are 0. Each text is split once; a task passes on sums
    and its distinct words and characters.
    """
    names = ["lang", "item", "kind", "n_lines", "n_words", "n_chars", "l_words", "n_sentences", "l_sentences"]

    def rows_of(totals: dict, seen: dict) -> pa.RecordBatch:
        rows = [(k, None, "t", *v) for k, v in totals.items()] + [(k, x, kind, *(0,) * 6) for (k, kind), xs in seen.items() for x in xs]
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 3 else pa.int64()) for i, c in enumerate(columns)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        seen: dict = {}
        for batch in batches:
            for name, line in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if (sums := totals.get(name)) is None:
                    sums = totals[name] = [0] * 6
                sums[0] += 1
                words = line.split() if line else []
                if not words:
                    continue
                spans = [n for n in (len(s.split()) for s in _SENTENCE_END.split(line)) if n]
                for i, x in enumerate((len(words), len(line) + 1, sum(map(len, words)), len(spans), sum(spans)), 1):
                    sums[i] += x
                seen.setdefault((name, "w"), set()).update(words)
                seen.setdefault((name, "c"), set()).update(line)
            if sum(map(len, seen.values())) > HELD_WORDS:
                yield rows_of({}, seen)
                seen = {}
        yield rows_of(totals, seen)

    rows = frame.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    schema = "lang string, item string, kind string, " + ", ".join(f"{c} bigint" for c in names[3:])
    once = rows.mapInArrow(run, schema).groupBy("lang", "kind", "item").agg(*(F.sum(c).alias(c) for c in names[3:]))
    one = lambda kind: F.count_if(F.col("kind") == kind)
    ratio = lambda a, b: F.round(F.coalesce(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), F.lit(0.0)), 6)
    return once.groupBy(F.col("lang").cast(frame.schema[lang].dataType).alias(lang)).agg(
        F.sum("n_lines").alias("line_count"), F.sum("n_words").alias("word_count"), F.sum("n_chars").alias("char_count"), one("w").alias("vocab_size"),
        (one("c") + F.when(F.sum("n_words") > 0, 1).otherwise(0)).alias("unique_chars"), ratio("l_words", "n_words").alias("avg_word_length"), ratio("l_sentences", "n_sentences").alias("avg_sentence_length"),
    )
