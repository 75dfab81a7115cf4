"""Connected components of a graph given by its links (alternating large-star and small-star, Kiveris and others 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bhashaloom.plans.skew import checkpointed, hot_keys, salted_join


def _star(edges: DataFrame, large: bool, links: int) -> DataFrame:
    """One step: each node's neighbours are linked to the least of them and itself. Only minima are gathered of a node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    joined = salted_join(near, least.select("u", "m"), ["u"], hot_keys(least, ["u"], "n", 2 * links), ["v"])
    moved = joined.where("v > u" if large else "true").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of (id, component): every node of a link with the smallest id that it is connected to.

    Nulls and links of a node with itself don't count. Each round is cut by a checkpoint; rounds grow with the
    logarithm of the longest path. No component is gathered in one place.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = checkpointed(edges), None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))).alias("s")).first()
        if before == now:
            break
        before = now
        edges = checkpointed(_star(_star(edges, True, now["n"]), False, now["n"]))
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
