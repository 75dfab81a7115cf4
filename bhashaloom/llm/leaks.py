"""Passages of evaluation texts inside of a corpus (problem 9), by MinHash containment search.

Plain MinHash compares sets of like size; a short item in a long document has hardly any similarity with it. So
the documents are partitioned down to the size of what is sought: every window of twelve words, of either side, is
a set of eight five-word shingles, and its MinHash is the least of their hashes. Where a passage of an item is
contained in a document, both have the same window, hence the same MinHash: no passage is lost. Neighbouring
windows mostly share their MinHash, so that a document has about two values for nine words. Values met by an item
are verified on the words: the shingles must follow one another, in both, for twelve words or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bhashaloom.functions.unicode import ALNUM, SPACE
from bhashaloom.plans.skew import checkpointed, hot_keys, salted_join

#: Words of a passage, and of a shingle.
PASSAGE, SHINGLE = 12, 5
#: Items of so many words in all, 2 MB or so, are broadcast and searched for as the documents are read; more of them are joined by MinHash.
BROADCAST_WORDS = 200_000

#: First digits of the decimal scripts in the Basic Multilingual Plane, as fixed values of Unicode.
_ZEROS = (
    0x0660, 0x06F0, 0x07C0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0DE6, 0x0E50, 0x0ED0, 0x0F20, 0x1040, 0x1090,
    0x17E0, 0x1810, 0x1946, 0x19D0, 0x1A80, 0x1A90, 0x1B50, 0x1BB0, 0x1C40, 0x1C50, 0xA620, 0xA8D0, 0xA900, 0xA9D0, 0xA9F0, 0xAA50, 0xABF0, 0xFF10,
)


def plain_words(text: Column) -> Column:
    """Text as words between single spaces: without tags, lower case, letters and digits, digits of any script as ASCII."""
    bare = F.lower(F.regexp_replace(text, "<[^<>]*>", ""))
    digits = F.translate(bare, "".join(chr(z + i) for z in _ZEROS for i in range(10)), "0123456789" * len(_ZEROS))
    kept = F.regexp_replace(digits, f"[^{ALNUM}{SPACE}]+", "")
    return F.trim(F.regexp_replace(kept, f"[{SPACE}]+", " "))


class Hasher:
    """Hashes of words, in a table of bounded size."""

    def __init__(self, most: int = 500_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def window_minima(hashes: np.ndarray) -> np.ndarray:
    """The MinHash of each window of PASSAGE words in a row of word hashes; none if the row is shorter."""
    if len(hashes) < PASSAGE:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        n = len(hashes) - SHINGLE + 1
        shingles = hashes[:n].copy()
        for i in range(1, SHINGLE):
            shingles = shingles * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
        shingles ^= shingles >> np.uint64(29)
        shingles *= np.uint64(0xBF58476D1CE4E5B9)
        shingles ^= shingles >> np.uint64(32)
    width = PASSAGE - SHINGLE + 1  # shingles of a window
    least, have = shingles, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def _chosen(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows whose MinHash differs from that of the window before, and those values."""
    least = window_minima(hashes)
    if not len(least):
        return np.zeros(0, np.int64), least
    at = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return at, least[at]


def common_run(a: list[str], i: int, b: list[str], j: int) -> tuple[int, int]:
    """How many consecutive words before a[i] and b[j], and how many from them on, are the same; none if these two differ."""
    if a[i] != b[j]:
        return 0, 0
    back = 0
    while back < i and back < j and a[i - back - 1] == b[j - back - 1]:
        back += 1
    ahead = 1
    while i + ahead < len(a) and j + ahead < len(b) and a[i + ahead] == b[j + ahead]:
        ahead += 1
    return back, ahead


class Index:
    """Items by the MinHash of their windows."""

    def __init__(self, items: list[tuple[object, str]]):
        self.hasher = Hasher()
        self.words = [(i, t.split(" ")) for i, t in items]
        by: dict[int, list[tuple[int, int]]] = {}
        for k, (_, ws) in enumerate(self.words):
            for at, value in enumerate(window_minima(self.hasher(ws)).tolist()):
                by.setdefault(value, []).append((k, at))
        self.by = by
        self.values = np.sort(np.fromiter(by, np.uint64, len(by)))

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(position of the text, position of the item, words of the longest passage, passages' windows) of each hit."""
        split = [t.split(" ") if t else [] for t in texts]
        flat = self.hasher([w for ws in split for w in ws])
        out, start = [], 0
        for d, ws in enumerate(split):
            hashes, start = flat[start : start + len(ws)], start + len(ws)
            at, value = _chosen(hashes)
            if not len(value) or not len(self.values):
                continue
            place = np.minimum(np.searchsorted(self.values, value), len(self.values) - 1)
            best: dict[int, int] = {}
            seen: dict[tuple[int, int], int] = {}  # how far a run with the same lag has been followed
            for k in np.flatnonzero(self.values[place] == value):
                # The windows that share this MinHash follow one another from here on.
                for item, j in self.by[int(value[k])]:
                    last = int(at[k + 1]) if k + 1 < len(at) else len(ws) - PASSAGE + 1
                    for i in range(int(at[k]), last):
                        if i < seen.get((item, i - j), 0):
                            continue
                        back, ahead = common_run(ws, i, self.words[item][1], j)
                        seen[item, i - j] = i + ahead
                        if back + ahead >= PASSAGE:
                            best[item] = max(best.get(item, 0), back + ahead)
            out += [(d, item, run, len(self.words[item][1])) for item, run in best.items()]
        return out


def leaked_passages(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """Rows of (doc, item, run, item_words): documents that hold PASSAGE or more consecutive words of an item.

    run: words of the longest such passage; item_words: words of the item. Words are white-space pieces reduced to
    letters and digits, lower case; tags are left out, and digits are the same in every script. Null and shorter texts
    hold nothing; null ids stay null. Repeated items and documents come out for each of their rows' ids once.
    Documents are read once. Where the items are few enough to be broadcast, none is shuffled; else the MinHashes of documents and items are joined,
    hot ones spread over many tasks, and only the pairs that meet fetch their words.
    """
    named = items.select(F.col(item_key).alias("item"), plain_words(F.col(item_text)).alias("words")).where("words IS NOT NULL").distinct()
    total = named.agg(F.sum(F.size(F.split("words", " ")))).first()[0] or 0
    rows = documents.select(F.col(key).alias("doc"), plain_words(F.col(text)).alias("words"))
    found = _searched(rows, named) if total <= BROADCAST_WORDS else _joined(rows, named)
    return found.groupBy("doc", "item").agg(F.max("run").alias("run"), F.max("item_words").alias("item_words"))


def _searched(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, item, run, item_words) by an index of all items in each task; BROADCAST_WORDS words at most."""
    shared = rows.sparkSession.sparkContext.broadcast([(r["item"], r["words"]) for r in items.collect()])
    out = T.StructType([rows.schema["doc"], items.schema["item"], T.StructField("run", T.IntegerType()), T.StructField("item_words", T.IntegerType())])
    arrow_item = pa.int64() if isinstance(out["item"].dataType, (T.LongType, T.IntegerType)) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = index.search(part.column("words").to_pylist())
                docs = part.column("doc").take(pa.array([x[0] for x in found], pa.int64()))
                ids = pa.array([index.words[x[1]][0] for x in found], arrow_item)
                yield pa.RecordBatch.from_arrays([docs, ids, pa.array([x[2] for x in found], pa.int32()), pa.array([x[3] for x in found], pa.int32())], out.names)

    return rows.mapInArrow(run, out)


def _values(rows: DataFrame, name: str) -> DataFrame:
    """(text, value) of rows (name, words): a text's hash with the MinHashes of all its windows, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                texts = [t for t in batch.column("words").slice(at, 1000).to_pylist() if t]
                minima = [np.unique(window_minima(hasher(t.split(" ")))) for t in texts]
                hashes = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, len(texts))
                flat = np.concatenate([*minima, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(hashes, [len(m) for m in minima]).view(np.int64)), pa.array(flat)], [name, "value"])

    return rows.select("words").mapInArrow(run, f"{name} long, value long").distinct()


def _joined(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, item, run, item_words) by a join of the MinHashes; texts are known by their hashes until they are verified."""
    values = checkpointed(_values(rows, "d"))
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, ["value"], "n", values.count())
    met = checkpointed(salted_join(values, _values(items, "i"), ["value"], hot, ["d"]).select("d", "i").distinct())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("words").to_pylist()
            hashes = np.fromiter((xxhash.xxh64_intdigest(t or "") for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), *batch.columns], ["h", *batch.schema.names])

    named = lambda frame, name: frame.mapInArrow(hashed, T.StructType([T.StructField("h", T.LongType()), *frame.schema])).withColumnRenamed("h", name)
    docs, wanted = named(rows, "d"), named(items, "i")
    texts = lambda frame, name: frame.join(met.select(name).distinct(), name, "left_semi").select(name, F.col("words").alias(f"w{name}")).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Index] = {}
        for batch in batches:
            runs = []
            for doc, item in zip(batch.column("wd").to_pylist(), batch.column("wi").to_pylist()):
                if len(known) > 1000:
                    known.clear()
                if item not in known:
                    known[item] = Index([(0, item)])
                found = known[item].search([doc])
                runs.append((found[0][2], found[0][3]) if found else (0, 0))
            columns = [pa.array([x[k] for x in runs], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("i"), *columns], ["d", "i", "run", "item_words"])

    pairs = met.join(texts(docs, "d"), "d").join(texts(wanted, "i"), "i").select("d", "i", "wd", "wi")
    runs = checkpointed(pairs.mapInArrow(verify, "d long, i long, run int, item_words int").where("run > 0"))
    of_doc, of_item = docs.select("doc", "d").join(runs.select("d").distinct(), "d", "left_semi").distinct(), wanted.select("item", "i").distinct()
    copies = of_doc.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return salted_join(of_doc, runs.join(of_item, "i"), ["d"], hot_keys(copies, ["d"], "n", of_doc.count()), ["doc"]).select("doc", "item", "run", "item_words")
