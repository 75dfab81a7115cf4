"""Records of evaluation splits that stand, exactly or nearly, in the training split (problem 2).

Two lines overlap if, in order, they share at least 0.8 of the words of the longer one. The n-grams by which hits
are found are pairs of words, not neighbours but the rarest: lines that share 0.8 of their words share at least
two among the rarest 0.2 of either and two more, for any fixed order of words, so no overlap is lost, even where
every third word was changed and no longer run of neighbours is left. Rare words make pairs that few lines hold.
The evaluation split gives the order of the words and a bitmap of its pairs, as large as their number demands; the training split
is scanned against the bitmap, the hashes of what hits it are joined on the pairs, and only then are texts fetched, by
their hashes, and the share of words computed exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bhashaloom.plans.skew import checkpointed, hot_keys, salted_join

#: Words of the evaluation split whose counts order the words; others count as rarer than any of them.
VOCABULARY = 50_000
#: Bits of the bitmap for each key of the evaluation split, and most bits of it (32 MB). It passes one foreign key in seventy, one in
#: seven where it is as large as it may be and holds four times the keys; for more keys none is made, and all keys are joined.
KEY_BITS, MOST_BITS = 16, 1 << 28
#: Lines of up to so many words are found by pairs, longer ones by single rare words, so that keys grow with length only. Lines that may
#: overlap with some on the other side of this length have both kinds, so that nothing is lost at it.
PAIR_WORDS = 48
_M = (1 << 64) - 1
_OTHER = regex.compile(r"[^\p{L}\p{M}\p{N}\s\x1c-\x1f]+")


def shared_in_order(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = state = (1 << len(a)) - 1
    for y in b:
        hit = state & at.get(y, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Keys:
    """The join keys of a line's words."""

    def __init__(self, counts: dict[int, int], share: float):
        self.counts, self.share, self.known = counts, share, {}

    def _word(self, lang: str, word: str, nth: int) -> tuple[int, int]:
        if len(self.known) > 500_000:
            self.known.clear()
        if (found := self.known.get((lang, word, nth))) is None:
            plain = xxhash.xxh64_intdigest(f"{lang}\x1f{word}")
            hashed = plain if nth == 0 else xxhash.xxh64_intdigest(f"{lang}\x1f{word}\x1f{nth}")
            found = self.known[lang, word, nth] = (self.counts.get(_signed(plain), 0), hashed)
        return found

    def of(self, lang: str, words_: list[str]) -> list[int]:
        """Keys of which lines that overlap share at least one. Equal lines have equal keys."""
        n, nth, ranked = len(words_), Counter(), []
        if not n:
            return []
        for w in words_:
            ranked.append(self._word(lang, w, nth[w]))
            nth[w] += 1
        ranked.sort()
        apart = n - math.ceil(self.share * n - 1e-9)  # words that the other line may lack
        keys: set[int] = set()
        if n == 1:
            keys.add(ranked[0][1])
        elif n <= PAIR_WORDS:
            keys.update((x * 0x9E3779B97F4A7C15 + y) & _M for (_, x), (_, y) in combinations(ranked[: apart + 2], 2))
        if n >= self.share * PAIR_WORDS:
            keys.update((x ^ 0xA5A5A5A5A5A5A5A5) for _, x in ranked[: apart + 1])
        return sorted(map(_signed, keys))


def _positions(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    bits = keys.view(np.uint64)
    return bits % np.uint64(size), (bits >> np.uint64(32)) % np.uint64(size)


def normalized(line: str) -> str:
    """The words of a line between single spaces: white-space pieces reduced to letters and digits, lower case."""
    return " ".join(_OTHER.sub("", line.lower()).split())


def _hash(lang: str, norm: str) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(f"{lang}\x1f{norm}")
    return _signed(both & _M), _signed(both >> 64)


def _with_keys(lines: DataFrame, counts, share: float, bitmap=None) -> DataFrame:
    """Lines (id, lang, line) with words as (id, h1, h2, n, norm, keys); n is the number of words.

    With a bitmap, keys are left out that it lacks, and the text of lines without any other.
    """
    id_type = lines.schema["id"].dataType
    out = T.StructType([
        T.StructField("id", id_type), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("n", T.IntegerType()),
        T.StructField("norm", T.StringType()), T.StructField("keys", T.ArrayType(T.LongType(), False)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, bits = Keys(counts.value, share), None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            norms = [normalized(x) for x in batch.column("line").to_pylist()]
            take = [i for i, x in enumerate(norms) if x]
            norms, langs = [norms[i] for i in take], batch.column("lang").take(pa.array(take, pa.int64()))
            named = langs.to_pylist()
            hashes = [_hash(a, t) for a, t in zip(named, norms)]
            keys = [made.of(a, t.split(" ")) for a, t in zip(named, norms)]
            if bits is not None:
                flat = np.fromiter((k for ks in keys for k in ks), np.int64)
                hit = np.ones(len(flat), bool)
                for at in _positions(flat, 8 * len(bits)):
                    hit &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                hits, at, kept = hit.tolist(), 0, []
                for ks in keys:
                    kept.append([k for k, h in zip(ks, hits[at : at + len(ks)]) if h])
                    at += len(ks)
                keys = kept
            texts = [t if ks else None for t, ks in zip(norms, keys)]
            counted = pa.array([t.count(" ") + 1 for t in norms], pa.int32())
            columns = [pa.array([h[0] for h in hashes], pa.int64()), pa.array([h[1] for h in hashes], pa.int64()), counted, pa.array(texts, pa.string()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(take, pa.int64())), *columns], out.names)

    return lines.mapInArrow(run, out)


def _bitmap(keys: DataFrame) -> bytes | None:
    """The bitmap of all keys, put together from words of 64 bits, of MOST_BITS at most; none where it would be too full to be of use."""
    there = keys.agg(F.approx_count_distinct("key")).first()[0] or 0
    if 4 * there > MOST_BITS:
        return None
    bits = 1 << 12
    while bits < MOST_BITS and bits < KEY_BITS * there:
        bits *= 2
    low = F.expr(f"CAST(pmod(key, {bits}) AS BIGINT)")  # a power of two, so signs don't matter
    high = F.pmod(F.shiftrightunsigned("key", 32), F.lit(bits))
    both = keys.select(F.explode(F.array(low, high)).alias("bit"))
    merged = both.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits"))
    found = merged.toPandas()  # at most MOST_BITS / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.tobytes()


def _keyed(lines: DataFrame, side: str) -> DataFrame:
    """(key, h1, h2, n) of each text and key once, named by their side; copies within a task are merged before the shuffle."""
    return lines.select(F.explode("keys").alias("key"), F.col("h1").alias(f"{side}1"), F.col("h2").alias(f"{side}2"), F.col("n").alias(f"n{side}")).distinct()


def _texts(lines: DataFrame, side: str) -> DataFrame:
    """(h1, h2, text) of each text with keys once, named by their side."""
    return lines.where("norm IS NOT NULL").select(F.col("h1").alias(f"{side}1"), F.col("h2").alias(f"{side}2"), F.col("norm").alias(side)).distinct()


def overlap_classes(frame: DataFrame, key: str, text: str, is_test: str, lang: str, share: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overlaps between distinct texts, and the lines of both splits.

    First (t1, t2, r1, r2, shared, longer): hashes of a test and a train text that overlap, with the number of
    words shared in order and of the longer text. Then (id, h1, h2) of the test and of the train lines.
    Lines with null is_test, id, text or lang, or without words, are in none.
    """
    spark = frame.sparkSession
    whole = F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull()
    rows = frame.where(whole).select(F.col(key).alias("id"), F.col(is_test).alias("test"), F.col(lang).alias("lang"), F.col(text).alias("line"))
    tests, trains = (rows.where(F.col("test") == x).drop("test") for x in (True, False))

    def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter((a, w) for a, x in zip(batch.column("lang").to_pylist(), batch.column("line").to_pylist()) for w in set(normalized(x).split(" ")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[k[0] for k in seen], [k[1] for k in seen], list(seen.values())], (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    counted = tests.select("lang", "line").mapInArrow(spoken, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "lang", "word").limit(VOCABULARY).collect()  # at most VOCABULARY rows
    counts = spark.sparkContext.broadcast({_signed(xxhash.xxh64_intdigest(f"{r['lang']}\x1f{r['word']}")): r["n"] for r in top})

    tests = checkpointed(_with_keys(tests, counts, share))
    bits = _bitmap(tests.select(F.explode("keys").alias("key")))
    trains = checkpointed(_with_keys(trains, counts, share, None if bits is None else spark.sparkContext.broadcast(bits)))

    # Only hashes are joined; a key's hash holds its language.
    two = checkpointed(_keyed(trains, "r"))
    held = two.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    near = F.least("nt", "nr") >= F.greatest("nt", "nr") * F.lit(share) - F.lit(1e-9)
    met = salted_join(two, _keyed(tests, "t"), ["key"], hot_keys(held, ["key"], "n", two.count()), ["r1"]).where(near)
    met = checkpointed(met.select("t1", "t2", "r1", "r2").distinct())
    met = met.join(_texts(tests, "t"), ["t1", "t2"]).join(_texts(trains, "r"), ["r1", "r2"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(t.split(" "), r.split(" ")) for t, r in zip(batch.column("t").to_pylist(), batch.column("r").to_pylist())]
            shared = [shared_in_order(t, r) for t, r in pairs]
            longer = [max(len(t), len(r)) for t, r in pairs]
            good = [i for i, (s, x) in enumerate(zip(shared, longer)) if s >= share * x - 1e-9]
            kept = batch.take(pa.array(good, pa.int64()))
            counts_ = [pa.array([x[i] for i in good], pa.int32()) for x in (shared, longer)]
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("t1", "t2", "r1", "r2")), *counts_], ["t1", "t2", "r1", "r2", "shared", "longer"])

    checked = met.mapInArrow(verify, "t1 long, t2 long, r1 long, r2 long, shared int, longer int")
    return checked, tests.select("id", "h1", "h2"), trains.select("id", "h1", "h2")


def overlaps(frame: DataFrame, key: str, text: str, is_test: str, lang: str, share: float = 0.8) -> DataFrame:
    """Rows of (test_id, train_id, shared, longer): every pair of a test and a train line of a lang that overlap.

    Lines with null is_test, id, text or lang are never cases, nor are lines without words. Copies of a line are
    found once and come out as every pair they are part of; a text with many copies is spread over many tasks.
    An empty table or split gives no rows.
    """
    out, tests, trains = overlap_classes(frame, key, text, is_test, lang, share)
    for side, lines in (("t", tests), ("r", trains)):
        own = lines.select(F.col("id").alias(f"{side}_id"), F.col("h1").alias(f"{side}1"), F.col("h2").alias(f"{side}2"))
        sizes = own.groupBy(f"{side}1", f"{side}2").agg(F.count(F.lit(1)).alias("n"))
        out = salted_join(own, out, [f"{side}1", f"{side}2"], hot_keys(sizes, [f"{side}1", f"{side}2"], "n", lines.count()), [f"{side}_id"])
    return out.select(F.col("t_id").alias("test_id"), F.col("r_id").alias("train_id"), "shared", "longer")
