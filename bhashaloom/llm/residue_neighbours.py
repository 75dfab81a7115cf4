"""Residue among near-duplicates: trusted labels spread through components (problem 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bhashaloom.llm.components import components
from bhashaloom.llm.near_duplicates import links
from bhashaloom.llm.residue import residue
from bhashaloom.plans.skew import checkpointed


def classes(frame: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of (key, class_id, n_links, trusted, is_residue), one for each text with words.

    class_id: smallest id of the component of near-duplicates, copies included. n_links: links to other texts that were
    verified, 0 for a text without any. trusted: the text itself is residue by rule; is_residue: it or a text
    of its component is. Repeated ids have one row. Null texts and texts without words have none.
    """
    pairs, members = links(frame, key, text)
    pairs, members = checkpointed(pairs), checkpointed(members.distinct())
    grouped = components(pairs, "a", "b").select(F.col("id").alias("first"), "component")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").agg(F.count(F.lit(1)).alias("n_links"))
    placed = members.join(grouped, "first", "left").join(ends, "first", "left").select(
        F.col("id").alias(key), F.coalesce("component", "first").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    seeds = residue(frame, key, text).where(F.col(key).isNotNull()).select(key).distinct().withColumn("trusted", F.lit(True))
    placed = checkpointed(placed.join(seeds, key, "left").withColumn("trusted", F.coalesce("trusted", F.lit(False))))
    bad = placed.where("trusted").select("class_id").distinct().withColumn("is_residue", F.lit(True))
    return placed.join(bad, "class_id", "left").select(key, "class_id", "n_links", "trusted", F.coalesce("is_residue", F.lit(False)).alias("is_residue"))
