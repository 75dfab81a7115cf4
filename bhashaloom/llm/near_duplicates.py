"""Near-duplicate texts by partitioned SimHash tables (problem 10).

A text is its set of five-word shingles. Texts of a similarity (Jaccard) of 0.8 share a shingle among the first
fifth of either, in any fixed order; such shingles are the parts of the table, so that no link is lost, and
shingles that very many texts share come last in the order. Within a part texts are compared by their 128-bit SimHash, and by their
shingles if few enough bits differ. A part with many texts is cut into blocks, and each block is held against each by a task of its own,
so that all links are found in parts of any size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bhashaloom.llm.cross_split import normalized
from bhashaloom.llm.leaks import Hasher
from bhashaloom.plans.skew import checkpointed, hot_keys, salted_join

#: Words of a shingle; least similarity; bits of 128 that may differ at that similarity (about seven deviations above what is expected).
SHINGLE, SIMILARITY, BITS = 5, 0.8, 56
#: A part with more texts is cut into blocks of about so many.
LARGE_PART = 200
#: Shingles counted as common, at most, of each task's texts.
COMMON = 2000


_HASHER = Hasher()


def shingles(text: str) -> np.ndarray:
    """Hashes of the distinct shingles of a text; the only one of a shorter text is itself; none without words."""
    words = normalized(text).split(" ")
    if words == [""]:
        return np.zeros(0, np.uint64)
    hashes, width = _HASHER(words), min(SHINGLE, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        out = hashes[:n] + np.uint64(width)
        for i in range(1, width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def simhash(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits: of each, whether most shingles have it. The second half is of the shingles' hashes mixed again."""
    with np.errstate(over="ignore"):
        other = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    out = []
    for h in (hashes, other):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0) * 2 > len(h)
        out.append(int(np.packbits(bits, bitorder="little").view("<u8")[0].astype(np.int64)))
    return out[0], out[1]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _hashed(rows: DataFrame, common: dict[int, int]) -> DataFrame:
    """(id, text) as (id, h1, h2, n, s1, s2, parts, text); texts without words are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(common)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.array(sorted(shared.value), np.uint64)
        for batch in batches:
            take, columns = [], ([], [], [], [], [], [])
            for i, text in enumerate(batch.column("text").to_pylist()):
                sh = shingles(text)
                if not len(sh):
                    continue
                take.append(i)
                content = xxhash.xxh3_128_intdigest(sh.tobytes())
                order = np.lexsort((sh, np.isin(sh, late)))
                parts = sh[order][: len(sh) - math.ceil(SIMILARITY * len(sh) - 1e-9) + 1]
                for c, x in zip(columns, (np.uint64(content & (2**64 - 1)).astype(np.int64), np.uint64(content >> 64).astype(np.int64), len(sh), *simhash(sh), parts.astype(np.int64))):
                    c.append(x)
            kept = batch.take(pa.array(take, pa.int64()))
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([kept.column("id"), *arrays, kept.column("text")], ["id", "h1", "h2", "n", "s1", "s2", "parts", "text"])

    return rows.mapInArrow(run, f"id {kind}, h1 long, h2 long, n int, s1 long, s2 long, parts array<long>, text string")


def _common_shingles(rows: DataFrame) -> dict[int, int]:
    """Shingles that more than a thousandth of some task's texts share, counted over all texts; at most COMMON.

    What comes out only sets an order, the same for all texts, so that a missing one costs time and no link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(shingles(text).tolist())
            if len(seen) > 40 * COMMON:
                seen = Counter({k: v for k, v in seen.items() if v > 1}) if len(seen) > 400 * COMMON else seen
                seen = Counter(dict(seen.most_common(20 * COMMON))) if len(seen) > 40 * COMMON else seen
        top = [(k, v) for k, v in seen.most_common(COMMON) if v > 10]
        yield pa.RecordBatch.from_arrays([pa.array(np.array([k for k, _ in top], np.uint64).view(np.int64)), pa.array([v for _, v in top], pa.int64())], ["shingle", "n"])

    counted = rows.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "shingle").limit(COMMON).collect()  # at most COMMON rows
    return {int(np.int64(r["shingle"]).view(np.uint64)): r["n"] for r in top}


def _verified(pairs: DataFrame) -> DataFrame:
    """Pairs (part, a, b, ta, tb) with their similarity."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            if len(known) > 5000:
                known.clear()
            texts = [batch.column(c).to_pylist() for c in ("ta", "tb")]
            for t in {*texts[0], *texts[1]} - known.keys():
                known[t] = shingles(t)
            found = [similarity(known[x], known[y]) for x, y in zip(*texts)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["part", "a", "b", "similarity"])

    return pairs.mapInArrow(run, f"part long, a {kind}, b {kind}, similarity double")


def _alike(parts: DataFrame) -> DataFrame:
    """Pairs of a table of (part, id, n, s1, s2, texts) in the same part that sizes and bits allow.

    One side of a pair goes to the cells of its block's row, the other to those of its block's column, so that each pair meets in one cell.
    """
    blocked = parts.withColumn("blocks", F.ceil(F.col("texts") / LARGE_PART).cast("int"))
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = blocked.select("part", F.col("block").alias("row"), F.col("other").alias("column"), *(F.col(c).alias(f"{c}_a") for c in ("id", "n", "s1", "s2")))
    y = blocked.select("part", F.col("other").alias("row"), F.col("block").alias("column"), *(F.col(c).alias(f"{c}_b") for c in ("id", "n", "s1", "s2")))
    differ = F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b"))) + F.bit_count(F.col("s2_a").bitwiseXOR(F.col("s2_b")))
    near = (differ <= BITS) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * SIMILARITY - 1e-9)
    return x.join(y, ["part", "row", "column"]).where(near & (F.col("id_a") < F.col("id_b"))).select("part", F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def links(frame: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) between the first ids of different texts that are alike, and (id, first) of every text.

    All texts of similarity SIMILARITY or more are linked; a text with the same shingles as
    another is its copy. Null ids and texts, and texts without words, are in neither. Texts are read whole.
    """
    rows = frame.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    table = checkpointed(_hashed(rows, _common_shingles(rows)).drop("text"))
    first = table.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    hot = hot_keys(first, ["h1", "h2"], "copies", table.count())
    members = salted_join(table.select("id", "h1", "h2"), first.select("h1", "h2", "first"), ["h1", "h2"], hot, ["id"]).select("id", "first")
    firsts = table.join(first.select(F.col("first").alias("id")), "id", "left_semi")
    parts = firsts.select("id", "n", "s1", "s2", F.explode("parts").alias("part"))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    parts = checkpointed(parts.join(sizes, "part"))  # parts of one text are gone

    def with_text(pairs: DataFrame) -> DataFrame:
        a, b = (rows.select(F.col("id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        return pairs.join(a, "a").join(b, "b").select("part", "a", "b", "ta", "tb")

    close = _alike(parts).groupBy("a", "b").agg(F.min("part").alias("part")).select("part", "a", "b")
    return _verified(with_text(close)).where(F.col("similarity") >= SIMILARITY - 1e-9).select("a", "b", "similarity"), members
