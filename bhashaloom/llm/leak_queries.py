"""Problem 9: evaluation texts in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bhashaloom.llm.leaks import _ZEROS, leaked_passages
from bhashaloom.plans.line_sql import SPACE
from bhashaloom.plans.session import spread, table


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_passages(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items of which they hold twelve or more consecutive words."""
    return _leaks(spark, folder).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each item that leaked: documents that hold a passage, and all of it, and the longest passage as a share of the item."""
    leaks = _leaks(spark, folder).groupBy(F.col("item").alias("item_id")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("run") == F.col("item_words")).alias("n_whole"), F.round(F.max(F.col("run") / F.col("item_words")), 6).alias("largest_share")
    )
    return table(spark, folder, "eval_items").select("item_id", "bench", "lang").join(leaks, "item_id")


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}

_ZERO_TO_NINE = "".join(chr(z + i) for z in _ZEROS for i in range(10))
_ALNUM = r"\p{L}\p{M}\p{N}\x{0C5D}\x{0CDD}"


def _windows(table_: str, key: str) -> str:
    """Windows of twelve words of a table's texts, with their places."""
    bare = f"translate(lower(regexp_replace(text, '<[^<>]*>', '', 'g')), '{_ZERO_TO_NINE}', '{'0123456789' * len(_ZEROS)}')"
    words = f"list_filter(string_split_regex(regexp_replace({bare}, '[^{_ALNUM}{SPACE}]+', '', 'g'), '[{SPACE}]+'), lambda w: w <> '')"
    return f"""{table_}_words AS (SELECT {key}, {words} AS w FROM {table_} WHERE text IS NOT NULL),
{table_}_windows AS (SELECT {key}, len(w) AS n, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS passage, unnest(range(1, len(w) - 10)) AS spot FROM {table_}_words WHERE len(w) > 11)"""


_BOTH = f"{_windows('documents', 'doc_id')},\n{_windows('eval_items', 'item_id')}"

SQL = {
    "p9_found": f"WITH {_BOTH} SELECT DISTINCT doc_id, item_id FROM documents_windows d JOIN eval_items_windows e ON d.passage = e.passage",
    "p9_items": f"""WITH {_BOTH},
met AS (SELECT DISTINCT doc_id, item_id, e.n, d.spot, d.spot - e.spot AS apart FROM documents_windows d JOIN eval_items_windows e ON d.passage = e.passage),
placed AS (SELECT *, spot - row_number() OVER (PARTITION BY doc_id, item_id, apart ORDER BY spot) AS island FROM met),
runs AS (SELECT doc_id, item_id, n, max(run) AS run FROM (SELECT doc_id, item_id, n, apart, island, count(*) + 11 AS run FROM placed GROUP BY ALL) GROUP BY ALL),
leaks AS (SELECT item_id, count(*) AS n_docs, count(*) FILTER (WHERE run = n) AS n_whole, round(max(run / n), 6) AS largest_share FROM runs GROUP BY item_id)
SELECT i.item_id, i.bench, i.lang, n_docs, n_whole, largest_share FROM eval_items i JOIN leaks l ON i.item_id = l.item_id""",
}
