"""Problems 5 and 8: token counts and token ids over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bhashaloom.llm.tokenizer import count_tokens, decode_ids, encode_texts, token_budget, token_spans
from bhashaloom.plans.session import table


def p5_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Exact number of tokens of every prepared line and document."""
    lines = table(spark, folder, "prepared_lines").select(
        F.lit("prepared_lines").alias("table_name"), F.col("line_id").alias("row_id"), "source", "lang", "text_domain", F.col("line").alias("text")
    )
    documents = table(spark, folder, "documents").select(
        F.lit("documents").alias("table_name"), F.col("doc_id").alias("row_id"), "source", "lang", "text_domain", "text"
    )
    return count_tokens(lines.unionByName(documents), "text", ["table_name", "row_id", "source", "lang", "text_domain"])


def p5_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of both tables over the cube of source, lang and text_domain."""
    return token_budget(p5_tokens(spark, folder), ["source", "lang", "text_domain"])


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text, encoded and decoded again; null texts come back empty."""
    return decode_ids(p8_ids(spark, folder), "doc_id")


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document with the characters that each touches."""
    return token_spans(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {"p5_tokens": p5_tokens, "p5_budget": p5_budget, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p8_spans": p8_spans}

SQL = {"p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
