"""Token rows, packed sequences and training windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bhashaloom.config import Packing
from bhashaloom.functions.text import characters
from bhashaloom.functions.unicode import is_blank, pieces, strip
from bhashaloom.plans.ranking import order_bucket, with_rank

_MODELS: dict = {}


def codepoint_ids(text: Column) -> Column:
    """One id per character: its code point."""
    return F.transform(characters(text), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int"))


def word_ids(text: Column, vocabulary: int = 50304) -> Column:
    """One id per white-space piece, by its digest."""
    return F.transform(pieces(text), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(vocabulary)).cast("int"))


def subword_ids(frame: DataFrame, key: str, text: str, model: str) -> DataFrame:
    """(key, tokens): ids of a SentencePiece model file, without begin and end marks. Null and blank text has none.

    Each worker loads the model once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        if model not in _MODELS:
            _MODELS[model] = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            ids = _MODELS[model].encode([x or "" for x in batch.column("text").to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.list_(pa.int32()))], ["key", "tokens"])

    out = T.StructType([T.StructField("key", frame.schema[key].dataType), T.StructField("tokens", T.ArrayType(T.IntegerType(), False))])
    rows = frame.select(F.col(key).alias("key"), strip(F.col(text)).alias("text")).mapInArrow(run, out)
    return rows.withColumnRenamed("key", key)


def subword_pieces(frame: DataFrame, key: str, text: str, model: str) -> DataFrame:
    """(key, tokens, pieces): ids of a SentencePiece model file and the piece of text that each stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        if model not in _MODELS:
            _MODELS[model] = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids, pieces_ = (_MODELS[model].encode(texts, out_type=kind, num_threads=1) for kind in (int, str))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.list_(pa.int32())), pa.array(pieces_, pa.list_(pa.string()))], ["key", "tokens", "pieces"])

    out = T.StructType([T.StructField("key", frame.schema[key].dataType), T.StructField("tokens", T.ArrayType(T.IntegerType(), False)), T.StructField("pieces", T.ArrayType(T.StringType(), False))])
    rows = frame.select(F.col(key).alias("key"), strip(F.col(text)).alias("text")).mapInArrow(run, out)
    return rows.withColumnRenamed("key", key)


def decode_subwords(frame: DataFrame, key: str, tokens: str, model: str) -> DataFrame:
    """(key, text) of id lists of a SentencePiece model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        if model not in _MODELS:
            _MODELS[model] = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            texts = [None if x is None else _MODELS[model].decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    out = T.StructType([T.StructField("key", frame.schema[key].dataType), T.StructField("text", T.StringType())])
    return frame.select(F.col(key).alias("key"), F.col(tokens).alias("ids")).mapInArrow(run, out).withColumnRenamed("key", key)


def chunked(frame: DataFrame, group: list[str], order: str, chunk_rows: int) -> DataFrame:
    """Frame with ``chunk``: blocks of so many consecutive rows of each group, from 0."""
    ranked = with_rank(frame, group, order_bucket(frame, order), [order], "__nth")
    return ranked.withColumn("chunk", F.floor((F.col("__nth") - 1) / chunk_rows)).drop("__nth")


def pack(frame: DataFrame, group: list[str], order: str, tokens: str, settings: Packing = Packing()) -> DataFrame:
    """(group, chunk, seq, tokens): the tokens of each chunk of lines, one after the other, in rows of a fixed length.

    There is nothing between lines; what is left at the end of a chunk is dropped. Chunks are small, so that one
    task gathers no more than a chunk's lines.
    """
    length = settings.sequence_length
    rows = chunked(frame.select(*group, order, tokens), group, order, settings.chunk_lines)
    gathered = rows.groupBy(*group, "chunk").agg(F.sort_array(F.collect_list(F.struct(order, tokens))).alias("lines"))
    flat = gathered.withColumn("all", F.flatten(F.transform("lines", lambda x: x[tokens]))).withColumn("n", F.floor(F.size("all") / length).cast("int")).where("n > 0")
    numbered = flat.withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return numbered.select(*group, "chunk", "seq", F.slice("all", F.col("seq") * length + 1, length).alias("tokens"))


def shifted(tokens: Column) -> tuple[Column, Column]:
    """Input and target of next-token training: the sequence without its last, and without its first token."""
    return F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens) - 1)


def shifted_repeating(tokens: Column) -> tuple[Column, Column]:
    """Input and target of full length, where the last target repeats the last token."""
    return tokens, F.concat(F.slice(tokens, 2, F.size(tokens) - 1), F.slice(tokens, -1, 1))


def cropped(tokens: Column, most: int) -> Column:
    """The last tokens of a context that is too long."""
    return F.when(F.size(tokens) > most, F.slice(tokens, -most, most)).otherwise(tokens)


def fertility(frame: DataFrame, lang: str, text: str, tokens: Column) -> DataFrame:
    """Mean tokens per character of the non-blank texts of each language, over their true number."""
    rows = frame.where(~is_blank(F.col(text))).select(lang, (F.size(tokens) / F.length(text)).alias("x"))
    return rows.groupBy(lang).agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.avg("x"), 6).alias("fertility"))
