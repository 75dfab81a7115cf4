"""A uniform sample of fixed size from rows that arrive in pieces (problem 1).

Rows fall into leaves: a piece's hash gives the branch, a key's hash the leaf within it, so that a piece of any size is
spread over many leaves, more of them the more rows have come. The leaves are counted once all
pieces are there; k is split down the tree of leaves by hypergeometric draws; and each leaf is read in the order of
its keys and sampled one row after the other with its exact quota. No leaf needs to fit into memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Branches of the tree by piece, fewest and most leaves of each branch by key, and rows of a leaf, about, were all rows of one piece.
BRANCHES, LEAVES, MOST_LEAVES, LEAF_ROWS = 64, 32, 1 << 14, 1_000_000
#: A chosen key table of at most so many rows is broadcast, as k bounds it; a larger one is shuffled.
BROADCAST_ROWS = 500_000


def hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """How many of so many draws without replacement are good, for populations of any size.

    Large ones are drawn by inversion: weights around the mode follow from the ratio of neighbouring probabilities, which is a
    simple fraction, out to fourteen deviations, beyond which less than double precision can tell is left. So memory grows with the root of the draws.
    """
    if good == 0 or bad == 0 or draws == 0:
        return draws if bad == 0 else 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    if 2 * draws > good + bad:
        return good - hypergeometric(good, bad, good + bad - draws, rng)
    total = good + bad
    mode = (draws + 1) * (good + 1) // (total + 2)
    wide = 14 * math.isqrt(draws * good // total * bad // total + 1) + 50
    low, high = max(0, draws - bad, mode - wide), min(good, draws, mode + wide)
    x = np.arange(low, high, dtype=np.float64)  # the ratio of x + 1 to x
    ratio = np.log(good - x) + np.log(draws - x) - np.log(x + 1) - np.log(float(bad - draws) + x + 1)
    weights = np.concatenate([[0.0], np.cumsum(ratio)])
    weights = np.cumsum(np.exp(weights - weights.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def split_quota(counts: Sequence[int], k: int, rng: np.random.Generator) -> list[int]:
    """Splits k over leaves of so many rows, as a uniform sample of k rows would fall; at most all rows.

    The tree halves the list of leaves; at each node the left half's part is a hypergeometric draw.
    """
    sums = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=object))])
    quota = [0] * len(counts)
    todo = [(0, len(counts), min(int(k), int(sums[-1])))]
    while todo:
        a, b, n = todo.pop()
        if n == 0 or a == b:
            continue
        if b - a == 1:
            quota[a] = n
            continue
        m = (a + b) // 2
        left = hypergeometric(int(sums[m] - sums[a]), int(sums[b] - sums[m]), n, rng)
        todo += [(a, m, left), (m, b, n - left)]
    return quota


def select_in_order(rows: int, left: int, quota: int, rng: np.random.Generator) -> list[int]:
    """Positions chosen among the next ``rows`` of ``left`` rows still to come, of which ``quota`` must be chosen."""
    chosen = []
    if quota:
        for i, u in enumerate(rng.random(rows).tolist()):
            if u * (left - i) < quota - len(chosen):
                chosen.append(i)
                if len(chosen) == quota:
                    break
    return chosen


def leaves_for(rows: int) -> int:
    """Leaves of each branch for a table of so many rows."""
    leaves = LEAVES
    while leaves < MOST_LEAVES and leaves * LEAF_ROWS < rows:
        leaves *= 2
    return leaves


def _leaf(piece: str, key: Sequence[str], seed: int, leaves: int):
    branch = F.pmod(F.xxhash64(F.lit(seed), F.col(piece)), F.lit(BRANCHES))
    return (branch * leaves + F.pmod(F.xxhash64(F.lit(seed + 1), *key), F.lit(leaves))).cast("int")


def fixed_size_sample(frame: DataFrame, k: int, piece: str, key: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """k rows of the frame with all its columns, every set of k rows equally likely; all rows if there are fewer.

    piece: column of the arrival piece, of any sizes; null is a piece like any other.
    key: columns that identify a row. Without them all columns do, and repeated rows, which are then alike, count
    as rows of their own: each may be drawn, so that a repeated row can come out several times. The same seed and
    rows give the same sample, however the rows are spread over files and tasks. An empty table or k = 0 gives no
    rows; a negative k is an error.

    Only keys are shuffled. The chosen keys, at most k, are broadcast up to BROADCAST_ROWS, else joined.
    """
    if k < 0:
        raise ValueError("a sample can't have fewer than no rows")
    unique = key is not None
    names = list(key) if unique else list(frame.columns)
    leaves = leaves_for(frame.count())  # reads no column
    keyed = frame.select(_leaf(piece, names, seed, leaves).alias("__leaf"), *(F.col(c).alias(f"__k{i}") for i, c in enumerate(names)))
    if not unique:  # two hashes stand for all columns
        ks = [f"__k{i}" for i in range(len(names))]
        keyed = keyed.select("__leaf", F.xxhash64(F.lit(seed), *ks).alias("__k0"), F.xxhash64(F.lit(seed + 7), *ks).alias("__k1"))
    keys = [c for c in keyed.columns if c != "__leaf"]

    counts = {r["__leaf"]: r["n"] for r in keyed.groupBy("__leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most BRANCHES * MOST_LEAVES rows
    order = sorted(counts)
    quotas = dict(zip(order, split_quota([counts[x] for x in order], k, np.random.default_rng(seed)), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, quota, rng = None, 0, 0, None
        for batch in batches:
            leaves = batch.column("__leaf").to_numpy(zero_copy_only=False)
            borders = [0, *(np.flatnonzero(np.diff(leaves)) + 1).tolist(), len(leaves)] if len(leaves) else [0]
            take: list[int] = []
            for a, b in zip(borders, borders[1:]):
                if leaves[a] != now:
                    now = int(leaves[a])
                    left, quota, rng = counts[now], quotas[now], np.random.default_rng([seed, now])
                chosen = select_in_order(b - a, left, quota, rng)
                take += [a + i for i in chosen]
                left, quota = left - (b - a), quota - len(chosen)
            yield batch.take(pa.array(take, pa.int64())).drop_columns(["__leaf"])

    parts = min(len(counts) or 1, max(1, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sorted_leaves = keyed.repartition(parts, "__leaf").sortWithinPartitions("__leaf", *keys)
    chosen = sorted_leaves.mapInArrow(run, T.StructType([keyed.schema[c] for c in keys]))
    small = F.broadcast if k <= BROADCAST_ROWS else lambda x: x
    if unique:
        on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names)]
        return frame.join(small(chosen), on, "left_semi")
    picked = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("__picked"))
    hashed = frame.withColumn("__h0", F.xxhash64(F.lit(seed), *names)).withColumn("__h1", F.xxhash64(F.lit(seed + 7), *names))
    met = hashed.join(small(picked), [F.col("__h0") == F.col("__k0"), F.col("__h1") == F.col("__k1")])
    alike = met.groupBy(*names, "__picked").agg(F.count(F.lit(1)).alias("__there"))
    return alike.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.least("__picked", "__there")))).select(*names)


def piece_report(frame: DataFrame, sample: DataFrame, piece: str) -> DataFrame:
    """Rows of (piece, n_rows, n_sampled): what came and what was drawn of each piece."""
    there = frame.groupBy(piece).agg(F.count(F.lit(1)).alias("n_rows"))
    drawn = sample.groupBy(F.col(piece).alias("__piece")).agg(F.count(F.lit(1)).alias("n"))
    both = there.join(drawn, F.col(piece).eqNullSafe(F.col("__piece")), "left")
    return both.select(piece, "n_rows", F.coalesce("n", F.lit(0)).cast("long").alias("n_sampled"))
