"""Queries on tokens, packed sequences and batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bhashaloom.config import Packing
from bhashaloom.functions.text import shortened
from bhashaloom.functions.unicode import is_blank
from bhashaloom.operators import loader as L
from bhashaloom.operators import sample as S
from bhashaloom.operators import tokens as K
from bhashaloom.plans.session import table
from bhashaloom.plans.skew import ensure_checkpoint_dir
from bhashaloom.sources.sequences import read_sequences, write_sequences

#: Folder of the public vocabularies.
TOKENIZERS = "/opt/tokenizers"
#: Sequences of the packing queries: words are few on a line, so that they are shorter than those of a model.
PACKING = Packing(sequence_length=128, chunk_lines=500)


def _prepared(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "prepared_lines").where("is_test IS NOT NULL").select("line_id", "lang", "is_test", "line")
    return lines.where(~is_blank(F.col("line"))).withColumn("split", F.when(F.col("is_test"), "test").otherwise("train"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "packed_seqs")


def _train(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).where("split_name = 'train'")


def shared_folder(spark: SparkSession) -> str:
    """A new folder within the checkpoint folder that all machines share."""
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def token_lines_codepoint(spark: SparkSession, folder: str) -> DataFrame:
    """Each prepared line as the code points of its characters."""
    return _prepared(spark, folder).select("line_id", K.codepoint_ids(F.col("line")).alias("tokens"))


def token_lines_words(spark: SparkSession, folder: str) -> DataFrame:
    """Each prepared line as one id per word."""
    return _prepared(spark, folder).select("line_id", K.word_ids(F.col("line")).alias("tokens"))


def token_lines_subword(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as ids of a public subword model."""
    return K.subword_ids(table(spark, folder, "documents"), "doc_id", "text", f"{TOKENIZERS}/piece_bpe_32k.model")


def _sequences(spark: SparkSession, folder: str) -> DataFrame:
    tokens = _prepared(spark, folder).select("lang", "split", "line_id", K.word_ids(F.col("line"), PACKING.vocabulary).alias("tokens"))
    return K.pack(tokens, ["lang", "split"], "line_id", "tokens", PACKING)


def pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """The prepared lines packed into sequences."""
    return _sequences(spark, folder).withColumn("seq", F.col("seq").cast("bigint"))


def shift_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Input and target of each packed sequence."""
    x, y = K.shifted(F.col("tokens"))
    return _packed(spark, folder).select("seq_id", x.alias("x"), y.alias("y"))


def shift_windows_repeating(spark: SparkSession, folder: str) -> DataFrame:
    """Target of full length, whose last token is repeated, of each packed sequence."""
    return _packed(spark, folder).select("seq_id", K.shifted_repeating(F.col("tokens"))[1].alias("y"))


def context_crop(spark: SparkSession, folder: str) -> DataFrame:
    """The last 256 tokens of each packed sequence."""
    return _packed(spark, folder).select("seq_id", K.cropped(F.col("tokens"), 256).alias("context"))


def shuffle_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """A new order of the train sequences of each language."""
    return S.shuffled(_train(spark, folder).select("lang", "seq_id", "tokens"), ["lang"], "seq_id")


def buffer_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """The same by shuffled buffers of a hundred sequences."""
    return S.buffer_shuffled(_train(spark, folder).select("lang", "seq_id", "tokens"), "lang", "seq_id", 100)


def language_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of each split and language and their share of the split."""
    return L.language_weights(_packed(spark, folder), ["split_name", "lang"])


def batch_allocation(spark: SparkSession, folder: str) -> DataFrame:
    """Slots of each language in a batch of sixteen."""
    return L.allocation(L.language_weights(_train(spark, folder), ["lang"]), "lang", "weight", 16)


def mixed_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of sixteen over all languages."""
    return L.mixed_batches(_train(spark, folder).select("lang", "seq_id", "tokens"), "lang", "seq_id", 16)


def language_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of sixteen of each split and language."""
    return L.single_batches(_packed(spark, folder).select("split_name", "lang", "seq_id", "tokens"), ["split_name", "lang"], "seq_id", 16)


def padded_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The same, short batches filled up."""
    return L.padded(language_batch(spark, folder), ["split_name", "lang"], 16)


def random_windows(spark: SparkSession, folder: str) -> DataFrame:
    """A hundred windows of 512 tokens of each language."""
    return L.random_windows(_train(spark, folder), "lang", "seq_id", "tokens", 100, 512)


def dataset_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, sequences and tokens of each split and language."""
    packed = _packed(spark, folder)
    return packed.groupBy("split_name", "lang").agg(F.count(F.lit(1)).alias("n_sequences"), F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"), F.count_distinct("file_name").alias("n_files"))


def fertility(spark: SparkSession, folder: str) -> DataFrame:
    """Mean words per character by language."""
    return K.fertility(_prepared(spark, folder), "lang", "line", K.word_ids(F.col("line")))


def fertility_subword(spark: SparkSession, folder: str) -> DataFrame:
    """Mean subwords per character of the documents by language."""
    documents = table(spark, folder, "documents")
    ids = token_lines_subword(spark, folder)
    return K.fertility(documents.join(ids, "doc_id"), "lang", "text", F.col("tokens"))


def shard_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole sequences of each shard file by its size; a partial one at the end doesn't count. Languages by file name."""
    files = table(spark, folder, "bin_files").select("file_name", "n_bytes").distinct()
    return files.select("file_name", F.split_part("file_name", F.lit("_"), F.lit(1)).alias("lang"), F.floor(F.col("n_bytes") / 2048).alias("n_sequences"), (F.col("n_bytes") % 2048).alias("rest"))


def bin_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of named languages written as shard files and read again: sequences and tokens by language."""
    path = shared_folder(spark)
    write_sequences(_packed(spark, folder).where("lang IS NOT NULL").select("lang", "tokens"), path, ".bin")
    read = read_sequences(spark, path, 1024, ".bin")
    return read.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sequences"), F.sum(F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + t)).alias("token_sum"))


#: Stands for a missing language in file names, which end it at the first underscore.
NO_LANGUAGE = "%"


def bin_roundtrip_splits(spark: SparkSession, folder: str) -> DataFrame:
    """All sequences of both splits written as shard files and read again: sequences and tokens by split and language, a missing one too."""
    path = shared_folder(spark)
    read = []
    for split in ("train", "test"):
        some = _packed(spark, folder).where(F.col("split_name") == split)
        write_sequences(some.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "tokens"), path, f"_{split}.bin")
        read.append(read_sequences(spark, path, 1024, f"_{split}.bin").withColumn("split_name", F.lit(split)))
    named = read[0].unionByName(read[1]).withColumn("lang", F.when(F.col("lang") != NO_LANGUAGE, F.col("lang")))
    return named.groupBy("split_name", "lang").agg(F.count(F.lit(1)).alias("n_sequences"), F.sum(F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + t)).alias("token_sum"))


def tokenizer_report(spark: SparkSession, folder: str) -> DataFrame:
    """Ten lines of each language, shortened, with their subword ids and pieces, their number and tokens per character."""
    lines = table(spark, folder, "prepared_lines").where(~is_blank(F.col("line"))).select("lang", "line_id", "line")
    some = S.sample_per_group(lines, "lang", "line_id", 10)
    shown = some.withColumn("line", shortened(F.col("line")))
    ids = K.subword_pieces(shown, "line_id", "line", f"{TOKENIZERS}/piece_bpe_32k.model")
    return shown.join(ids, "line_id").select("lang", "line_id", F.col("line").alias("shown"), "tokens", "pieces", F.size("tokens").alias("n_tokens"), F.round(F.size("tokens") / F.length("line"), 6).alias("per_char"))


QUERIES = {
    f.__name__: f
    for f in (
        token_lines_codepoint, token_lines_words, token_lines_subword, pack_sequences, shift_windows, shift_windows_repeating, context_crop, shuffle_sequences, buffer_shuffle, language_weights,
        batch_allocation, mixed_batch, language_batch, padded_batch, random_windows, dataset_counts, fertility, fertility_subword, shard_counts, bin_roundtrip, bin_roundtrip_splits, tokenizer_report,
    )
}
