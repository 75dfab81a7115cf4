"""Encoding with a public byte-level tokenizer, over Arrow batches (problems 5 and 8).

A byte-level BPE never merges across a white-space border: a text falls into chunks, each a run of
non-space characters with at most one space before it, or white space, and the ids of the text are
those of its chunks in order. Natural text repeats its words, so each distinct chunk of a batch goes
through the tokenizers library once and the ids of all texts are gathered by index arithmetic. A
bounded table keeps the chunks between batches. Tokenizers of another kind encode whole texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bhashaloom.functions.unicode import is_blank

#: Folder of the public vocabularies, a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k.json"

_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by character."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """A tokenizer of the tokenizers library with its chunk table, bounded by chunks and characters; one per worker."""

    def __init__(self, path: str, max_chunks: int = 200_000, max_chars: int = 20_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        kind = json.loads(self.tokenizer.to_str())
        before = kind.get("pre_tokenizer") or {}
        self.byte_level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
        self.chunked = self.byte_level and before.get("use_regex", True) and not kind.get("normalizer")
        self.max_chunks, self.max_chars = max_chunks, max_chars
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.length = np.zeros(1024, np.int64)
        self.start = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.int32)
        self.used = self.chars = 0

    def _add(self, chunks: list[str]) -> None:
        """Puts chunks that the table lacks into it."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        n, first = np.fromiter(map(len, ids), np.int64, len(ids)), len(self.index)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
        while first + len(ids) > len(self.length):
            self.length, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.length, self.start))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.length[first : first + len(ids)] = n
        self.start[first : first + len(ids)] = self.used + np.cumsum(n) - n
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.chars += sum(map(len, chunks))
        self.index.update(zip(chunks, range(first, first + len(chunks)), strict=True))

    def _codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Table positions of all chunks, and how many each text has."""
        if len(self.index) > self.max_chunks or self.chars > self.max_chars:
            self._reset()
        chunks = [_CHUNK.findall(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        flat = list(chain.from_iterable(chunks))
        if new := [c for c in dict.fromkeys(flat) if c not in self.index]:
            self._add(new)
        return np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat)), counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the borders between texts. None and "" have no ids."""
        if not self.chunked:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())), _borders(n)
        codes, counts = self._codes(texts)
        n = self.length[codes]
        ends = np.cumsum(n)
        values = self.pool[np.arange(int(n.sum())) + np.repeat(self.start[codes] - (ends - n), n)]
        return values, np.concatenate([[0], ends])[_borders(counts)]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        if not self.chunked:
            return np.diff(self.encode(texts)[1])
        codes, counts = self._codes(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self.length[codes])])[_borders(counts)])

    def bytes_of_ids(self) -> list[bytes]:
        """The bytes that each id stands for, in a byte-level vocabulary."""
        alphabet = byte_alphabet()
        table = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            known = all(c in alphabet for c in token)
            table[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        return table

    def decode(self, ids: list[int] | None) -> str | None:
        """Text of ids. Bytes that end up as half a character, as at a cut, become U+FFFD."""
        if ids is None:
            return None
        if not hasattr(self, "_bytes"):
            self._bytes = self.bytes_of_ids()
        return b"".join([self._bytes[i] for i in ids]).decode("utf-8", "replace")

    def spans(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with the first character and the one after the last that each touches.

        Several ids may share a character whose bytes were split between them.
        """
        ids, _ = self.encode([text])
        if not hasattr(self, "_bytes"):
            self._bytes = self.bytes_of_ids()
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        char_of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(np.fromiter((len(self._bytes[i]) for i in ids), np.int64, len(ids)))
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return ids, char_of_byte[starts].astype(np.int32), (char_of_byte[ends - 1] + 1).astype(np.int32)


def _borders(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded on first use."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _pieces(batch: pa.RecordBatch, text: str, chars: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each; a longer text has a slice of its own."""
    sizes = np.fromiter((len(x) if x else 0 for x in batch.column(text).to_pylist()), np.int64, batch.num_rows)
    group = np.cumsum(sizes) // chars
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encode_texts(frame: DataFrame, key: str, text: str, *, folder: str = TOKENIZERS, vocabulary: str = DEFAULT, ids: str = "ids") -> DataFrame:
    """Rows of (key, ids): the token ids of each text, without special tokens.

    Empty and null texts, and only they, have an empty list. White space is text. Repeated rows and null keys
    come out as they went in; other columns are left out, so their names cannot clash.
    """
    path = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path)
        for whole in batches:
            for batch in _pieces(whole, "text", 500_000):
                values, ends = one.encode(batch.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("key"), lists], ["key", "ids"])

    kind = frame.schema[key].dataType
    out = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    rows = frame.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, out)
    return rows.select(F.col("key").alias(key), F.col("ids").alias(ids))


def decode_ids(frame: DataFrame, key: str, ids: str = "ids", *, folder: str = TOKENIZERS, vocabulary: str = DEFAULT, text: str = "text") -> DataFrame:
    """Rows of (key, text): the text of each id list of a byte-level vocabulary. Null lists give null, empty ones ""."""
    path = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path)
        for batch in batches:
            texts = [one.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    out = T.StructType([T.StructField("key", frame.schema[key].dataType), T.StructField("text", T.StringType())])
    rows = frame.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, out)
    return rows.select(F.col("key").alias(key), F.col("text").alias(text))


def token_spans(frame: DataFrame, key: str, text: str, *, folder: str = TOKENIZERS, vocabulary: str = DEFAULT) -> DataFrame:
    """Rows of (key, ids, starts, ends): ids with the characters that each touches, end exclusive.

    A character whose bytes are split between ids belongs to each of them. Empty and null texts have empty lists.
    """
    path = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path)
        for whole in batches:
            for batch in _pieces(whole, "text", 500_000):
                three = [one.spans(x) for x in batch.column("text").to_pylist()]
                ends = pa.array(_borders(np.fromiter((len(x[0]) for x in three), np.int64, len(three))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in three]).astype(np.int32))) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), *lists], ["key", "ids", "starts", "ends"])

    numbers = T.ArrayType(T.IntegerType(), False)
    out = T.StructType([T.StructField("key", frame.schema[key].dataType), *(T.StructField(c, numbers, False) for c in ("ids", "starts", "ends"))])
    rows = frame.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, out)
    return rows.select(F.col("key").alias(key), "ids", "starts", "ends")


def count_tokens(frame: DataFrame, text: str, keep: list[str], *, folder: str = TOKENIZERS, vocabulary: str = DEFAULT, count: str = "n_tokens") -> DataFrame:
    """The kept columns and the exact number of tokens of each text.

    Null, empty and blank texts (white space only) count nothing. One row per input row, repeated rows too.
    """
    path = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path)
        for whole in batches:
            for batch in _pieces(whole, "__text", 1_000_000):
                n = one.count(batch.column("__text").to_pylist())
                kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "__text"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64())], names)

    names = [*keep, count]
    out = T.StructType([*(frame.schema[c] for c in keep), T.StructField(count, T.LongType(), False)])
    return frame.select(*keep, F.when(~is_blank(F.col(text)), F.col(text)).alias("__text")).mapInArrow(run, out)


def token_budget(counted: DataFrame, dimensions: list[str], count: str = "n_tokens") -> DataFrame:
    """Totals over the cube of the dimensions: n_rows, n_texts (with tokens) and n_tokens of each combination.

    ``level`` has a bit for each dimension that is summed over, so that its null differs from a null in the
    data. An empty table gives no rows, as there is no combination.
    """
    return counted.cube(*dimensions).agg(
        F.grouping_id().cast("long").alias("level"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(count) > 0).alias("n_texts"),
        F.sum(count).cast("long").alias("n_tokens"),
    )
