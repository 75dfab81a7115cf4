"""Text read in a wrong character encoding (problem 6).

UTF-8 read in a single-byte encoding turns each letter into two to four signs, whose bytes give it back. Every
chain of one or two such readings is tried on each run of suspicious signs, and a smoothed character trigram
model, trained on all clean lines, scores what comes out against what is there. The likeliest chain is accepted if it
is likelier by a margin, which is set on all clean lines: by foreign words put before each of their words, and by each of their signs garbled on purpose.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings in which UTF-8 may have been read, most likely ones first; where two give the same, the first counts.
CODECS = (
    "cp1252", "latin_1", "mac_roman", "cp1251", "cp437", "koi8_r", "cp850", "cp1250", "cp1254", "iso8859_15", "iso8859_2", "cp1253", "cp866", "cp852",
    "iso8859_5", "koi8_u", "mac_cyrillic", "cp1257",
)
#: Lines whose characters are counted at once, and places of a sign that are judged at once; all lines and places come in turn.
TRAINING_LINES, HELD_LINES = 12_000, 3_000
#: Characters from which on fewer lines are counted at once.
_CHARACTERS = 4_000_000
#: Signs before and after a line, bits of a character in a number of several, and steps to a nat in which gains are counted, up to 1024 nats.
_START, _END, _BITS, _STEPS = 2, 3, 21, 1024
_MOST = 1024 * _STEPS
#: How often doubtful runs are looked for: those that the first round takes out may have spoken for others.
ROUNDS = 2
#: What a sign that is garbled weighs over all its places, as a whole number so that sums don't depend on their order.
_UNIT = 1 << 40
#: What a decoder puts for bytes that it cannot read.
LOST = "\uFFFD"
#: Signs that no encoding above has beyond ASCII: the Indic blocks, spaces and joiners. Two others in a row, or U+FFFD, make a line suspicious.
_HARMLESS = "\\x00-\\x7F\u0900-\u0DFF\u2000-\u200F\u202F\u3000\uFEFF"
SUSPICIOUS = f"[^{_HARMLESS}]{{2}}|{LOST}"
_RUN = regex.compile(f"[^{_HARMLESS}{LOST}]{{2,}}")
#: Nats that a character of what looks like foreign text costs, as if each of some 3000 letters and marks of those scripts were as likely: foreign letters are no sign of damage,
#: though the model has not seen them. What the model takes for any sign that it has not seen after the two characters before comes on top, as for the signs of rereadings.
FOREIGN = 8.0
#: What looks like foreign text: a word of the Latin, Greek or Cyrillic script, in lower case, in capitals or with a capital first, or several
#: joined by hyphens or apostrophes, between signs that open and close; or such signs alone. The masculine and feminine signs are no letters of words.
_WORDS = "|".join(
    rf"(?:(?:{upper})?(?:{lower})+|(?:{upper})(?:{upper}|\p{{M}})*)(?:[-\u2010\u2011’·](?:{lower}|{upper})+)*"
    for upper, lower in ((rf"[\p{{Lu}}&&{s}]", rf"[[\p{{Ll}}\p{{Lo}}\p{{M}}]&&[{s}\p{{M}}]--[ªº]]") for s in (r"\p{Latin}", r"\p{Greek}", r"\p{Cyrillic}"))
)
_SHAPED = regex.compile(rf"[«“„‘’—–•€£]*(?:{_WORDS})?[»”“’…—–]*|[\u2010-\u2015\u2018-\u2019\u201C-\u201D\u2022\u2026\u2190-\u21FF\u25A0-\u25FF\u2600-\u27BF\U0001F000-\U0001FAFF°€]+", regex.V1)
#: Blocks of 128 characters: those of the corpus's scripts, which may be read whether or not a clean line holds them, and their number.
_SCRIPTS, _BLOCKS = frozenset(range(0x900 >> 7, 0xE00 >> 7)), 0x110000 >> 7


def _high_half(codec: str) -> dict[str, int]:
    """The characters of an encoding beyond ASCII with their bytes; bytes that it leaves open stand for themselves."""
    out = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


_BYTES = {c: _high_half(c) for c in CODECS}
_CHARS = {c: {b: ch for ch, b in sorted(t.items(), key=lambda x: ord(x[0]))} for c, t in _BYTES.items()}


#: By encoding, the character of each byte as a character of that number, and the others of those numbers as one that is none.
_AS_BYTES = {c: {b: "\uFFFF" for b in range(0x80, 0x100)} | {ord(ch): chr(b) for ch, b in t.items()} for c, t in _BYTES.items()}
#: A character beyond ASCII in UTF-8, as bytes that are characters of their numbers.
_UTF8 = re.compile(
    "[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
)


def reread(text: str, codec: str) -> tuple[str, int]:
    """Text whose signs, as bytes of an encoding, are read as UTF-8 wherever they are valid; and how many letters came out."""
    out, at = [], 0
    for m in _UTF8.finditer(text.translate(_AS_BYTES[codec])):
        out += [text[at : m.start()], m.group().encode("latin-1").decode("utf-8")]
        at = m.end()
    return ("".join([*out, text[at:]]), len(out) // 2) if out else (text, 0)


def garble(text: str, codec: str) -> str:
    """Text written as UTF-8 and read in a single-byte encoding."""
    table = _CHARS[codec]
    return "".join(chr(b) if b < 0x80 else table[b] for b in text.encode("utf-8", "replace"))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _packed(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Three characters as one number."""
    return first << 2 * _BITS | second << _BITS | third


@dataclass
class Places:
    """Where a sign or run stands: the two characters before it and the one after it, _END for none."""

    first: np.ndarray
    second: np.ndarray
    after: np.ndarray

    @classmethod
    def of(cls, before: str, after: str) -> "Places":
        first, second = _codes(f"\x02\x02{before}"[-2:])
        return cls(np.array([first]), np.array([second]), _codes(f"{after}\x03"[:1]))


Stretches = list[tuple[int, int]]


def count_signs(lines: list[str], only: list[Stretches] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each character of lines, their ends included, with the two before it and the one after it packed into a number, and how often.

    only: by line, stretches of it; if given, only their characters are counted and those that they stand before.
    """
    if not lines:
        return (np.zeros(0, np.int64),) * 3
    codes = _codes("".join([f"\x02\x02{x}\x03" for x in lines]) + "\x02")
    ends = np.cumsum([len(x) + 3 for x in lines])
    inside = np.full(len(codes) - 3, only is None)
    inside[np.concatenate([ends[:-1] - 2, ends[:-1] - 1])] = False  # what stands before the next line is no character of it
    for line, end, stretches in zip(lines, ends.tolist(), only or ()):
        for start, stop in stretches:
            inside[end - len(line) - 3 + start : min(end - 2, end - len(line) - 1 + stop)] = True
    present = np.zeros(0x110000, bool)
    present[codes] = True
    chars = np.flatnonzero(present)
    size = len(chars)
    if size**4 < 1 << 63:
        dense = np.cumsum(present)[codes] - 1
        keys, n = np.unique((((dense[:-3] * size + dense[1:-2]) * size + dense[2:-1]) * size + dense[3:])[inside], return_counts=True)
        first, second, sign, after = (chars[keys // size**i % size] for i in (3, 2, 1, 0))
    else:
        found, n = np.unique(np.lib.stride_tricks.sliding_window_view(codes, 4)[inside], axis=0, return_counts=True)
        first, second, sign, after = found.T
    return sign, _packed(first, second, after), n


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their weights and their number; a last one that no key equals has neither."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(weights, at) if len(keys) else weights
    return np.append(keys[at], np.int64((1 << 63) - 1)), np.append(sums, 0), np.append(np.diff(np.append(at, len(keys))), 0)


class Trigrams:
    """A character trigram model, smoothed by the shorter ones (Witten and Bell 1991).

    Made of distinct trigrams, each packed into a number, and their counts. Takes 16 bytes for each, and 40 for each distinct pair of characters.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, blocks: Iterable[int] = ()) -> None:
        self.counts, self.after = [], []
        for n in range(3):
            shorter, sums, _ = _sums(grams & ((1 << _BITS * (n + 1)) - 1), counts)
            self.counts.append((shorter, sums))
            self.after.append(_sums(shorter[:-1] >> _BITS, sums[:-1]))
        self.blocks = _SCRIPTS.union(blocks)
        self.memo: dict[str, float] = {}

    def logs(self, grams: np.ndarray, less: int = 0) -> np.ndarray:
        """Log-probabilities of the last of three characters after the two before; less: how many occurrences of these trigrams are left out."""
        p = np.full(len(grams), 1 / 0x20000)
        for n, ((known, counts), (befores, sums, numbers)) in enumerate(zip(self.counts, self.after)):
            gram = grams & ((1 << _BITS * (n + 1)) - 1)
            at = np.searchsorted(known, gram)
            count = np.where(known[at] == gram, counts[at], 0)
            at = np.searchsorted(befores, gram >> _BITS)
            there = befores[at] == gram >> _BITS
            after, kinds = np.where(there, sums[at], 0), np.where(there, numbers[at], 0)
            if less:
                gone = np.minimum(count, less)
                after, kinds, count = after - gone, kinds - ((count > 0) & (count == gone)), count - gone
            p = np.where(kinds > 0, (count + kinds * p) / np.maximum(after + kinds, 1), p)
        return np.log(p)

    def learn(self, grams: Iterable[str]) -> None:
        """Keeps the log-probabilities of trigrams for the next time."""
        if len(self.memo) > 500_000:
            self.memo.clear()
        new = list(set(grams).difference(self.memo))
        if new:
            codes = _codes("".join(new)).reshape(-1, 3)
            self.memo.update(zip(new, self.logs(_packed(*codes.T)).tolist()))

    def log_probability(self, text: str, start: int = 0) -> float:
        """Of the characters of text from a position on, given those before."""
        grams = trigrams(text, start)
        try:
            return sum(map(self.memo.__getitem__, grams))
        except KeyError:
            self.learn(grams)
            return sum(map(self.memo.__getitem__, grams))

    def escapes(self, places: Places) -> np.ndarray:
        """Log-probabilities that what stands at places has been seen neither after the two characters before nor after the one."""
        p = np.ones(len(places.first))
        for n, before in ((1, places.second), (2, places.first << _BITS | places.second)):
            befores, sums, numbers = self.after[n]
            at = np.searchsorted(befores, before)
            p *= np.where(befores[at] == before, numbers[at] / np.maximum(sums[at] + numbers[at], 1), 1)
        return np.log(p)

    def scores(self, text: str, places: Places, less: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of a text at places and of what stands after it there."""
        codes, many = _codes(text), len(places.first)
        second = codes[-2] if len(codes) > 1 else places.second
        grams = [_packed(places.first, places.second, codes[0]), _packed(second, codes[-1], places.after)]
        if len(codes) > 1:
            grams.append(_packed(places.second, codes[0], codes[1]))
        found = self.logs(np.concatenate([*grams, _packed(codes[:-2], codes[1:-1], codes[2:])]), less)
        own = found[:many] + found[many * len(grams) :].sum() + (found[2 * many : 3 * many] if len(codes) > 1 else 0)
        return own, np.where(places.after == _END, 0, found[many : 2 * many])


def trigrams(text: str, start: int = 0) -> list[str]:
    """Each character of text from a position on, with the two before it."""
    padded = f"\x02\x02{text}"
    return [padded[i : i + 3] for i in range(start, len(text))]


@dataclass
class Repair:
    """The model with its margin, the share of garbled signs that it misses and, by script, that of foreign words that it takes for garbled."""

    model: Trigrams
    margin: float = 8.0
    missed: float = 0.0
    mistaken: dict[str, float] = field(default_factory=dict)
    known: dict[tuple[str, str, str, int], tuple[float, str, tuple[str, ...]]] = field(default_factory=dict)
    readings: dict[str, dict[str, tuple[str, ...]]] = field(default_factory=dict)

    def best(self, before: str, run: str, after: str, less: int = 0) -> tuple[float, str, tuple[str, ...]]:
        """The likeliest rereading of a run between its neighbours: by how much it is likelier, its text and its chain.

        Garbled words come again as other words do, so that runs with the same neighbours are judged once.
        less: how many occurrences of the run the model has from the line that is judged; they are left out.
        """
        place = (before[-2:], run, after[:1], less)
        if place not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[place] = self._best(*place)
        return self.known[place]

    def _options(self, run: str) -> dict[str, tuple[str, ...]]:
        """What one or two rereadings make of a run, with the chain of each, whatever stands around it."""
        if (found := self.readings.get(run)) is not None:
            return found
        if len(self.readings) > 50_000:
            self.readings.clear()
        options = self.readings[run] = {}
        for codec in CODECS:
            text, found = reread(run, codec)
            if found and text not in options:
                options[text] = (codec,)
        for once, chain in list(options.items()):
            for codec in CODECS if _RUN.search(once) else ():
                text, found = reread(once, codec)
                if found and text not in options:
                    options[text] = (*chain, codec)
        return options

    def _allowed(self, run: str) -> dict[str, tuple[str, ...]]:
        """Rereadings of a run without signs of a script that no clean line of the whole table holds: foreign letters read by accident."""
        return {text: chain for text, chain in self._options(run).items() if {ord(c) >> 7 for c in set(text).difference(run)} <= self.model.blocks}

    def gains(self, run: str, places: Places, truth: str | None = None, scored: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """By how much the likeliest rereading of a run is likelier, at each of some places.

        truth: what stands there in the lines that the model was trained on; it is judged without this occurrence.
        scored: scores at these places, which are kept there.
        """
        if not (options := self._allowed(run)):
            return np.zeros(len(places.first))
        scored = {} if scored is None else scored
        for text in (run, *options):
            if text not in scored:
                scored[text] = self.model.scores(text, places, int(text == truth))
        own, after = scored[run]
        base = (np.maximum(own, self.model.escapes(places) - FOREIGN * len(run)) if shaped(run) else own) + after
        return np.maximum(np.max([sum(scored[text]) for text in options], axis=0) - base, 0)

    def _best(self, context: str, run: str, after: str, less: int) -> tuple[float, str, tuple[str, ...]]:
        if not (options := self._allowed(run)):
            return 0.0, run, ()
        self.model.learn(gram for text in (run, *options) for gram in trigrams(context + text + after, len(context)))
        if less:
            own, then = (float(x[0]) for x in self.model.scores(run, Places.of(context, after), less))
        else:
            own, then = self.model.log_probability(context + run, len(context)), self.model.log_probability(context + run + after, len(context + run))
        foreign = float(self.model.escapes(Places.of(context, after))[0]) - FOREIGN * len(run) if shaped(run) else own
        base = then + max(own, foreign)
        top = (0.0, run, ())
        for text, chain in options.items():
            gain = self.model.log_probability(context + text + after, len(context)) - base
            if gain > top[0]:
                top = (gain, text, chain)
        return top

    def line(self, line: str) -> tuple[str, list[str], float]:
        """The line as far as it can be restored, the chains used, and the largest gain."""
        out, chains, largest, at = [], [], 0.0, 0
        for found in _RUN.finditer(line):
            gain, text, chain = self.best(line[max(0, found.start() - 2) : found.start()], found.group(), line[found.end() : found.end() + 2])
            if chain and gain > self.margin:
                out += [line[at : found.start()], text]
                at, largest = found.end(), max(largest, gain)
                chains.append("+".join(chain))
        return "".join([*out, line[at:]]), list(dict.fromkeys(chains)), largest


def shaped(run: str) -> bool:
    """Whether signs look like foreign text, or are those of print alone."""
    return _SHAPED.fullmatch(run) is not None


def _clean(line: str) -> bool:
    """No sign is lost, and all that look suspicious have the shape of foreign text, whether or not some encoding makes letters of them."""
    return LOST not in line and all(map(shaped, _RUN.findall(line)))


def doubtful(repair: Repair, line: str) -> Stretches:
    """Where a clean line has runs that some rereading is likelier than, by a model of all clean lines without the run's occurrences in this one.

    They have been garbled into the shape of a word, or are rare words that can be misread.
    """
    runs = list(_RUN.finditer(line))
    times = Counter(m.group() for m in runs)
    return [m.span() for m in runs if repair.best(line[max(0, m.start() - 2) : m.start()], m.group(), line[m.end() : m.end() + 1], times[m.group()])[0] > 0]


def sign_counts(rows: DataFrame, text: str, judge: Broadcast[Repair] | None = None) -> DataFrame:
    """Rows of (sign, place, n): how often each character of all clean lines, ends of lines included, stands between the same others.

    place: the two characters before and the one after, packed into a number. judge: the model of all that; if given, what its doubtful runs
    have added comes out, as negative numbers.
    """
    columns = ["sign", "place", "n"]

    def counted(lines: list[str], only: list[Stretches]) -> pa.RecordBatch:
        sign, place, n = count_signs(lines, only if judge else None)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (sign, place, -n if judge else n)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, only, size = [], [], 0
        for batch in batches:
            for line, suspicious in zip(batch.column("text").to_pylist(), batch.column("suspicious").to_pylist()):
                if suspicious and not _clean(line):
                    continue
                if judge:
                    if not (found := doubtful(judge.value, line)):
                        continue
                    only.append(found)
                lines.append(line)
                size += len(line)
                if len(lines) >= TRAINING_LINES or size >= _CHARACTERS:
                    yield counted(lines, only)
                    lines, only, size = [], [], 0
        yield counted(lines, only)

    found = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(text).rlike(SUSPICIOUS).alias("suspicious"))
    found = found.where("suspicious") if judge else found
    return found.mapInArrow(run, "sign long, place long, n long").groupBy("sign", "place").agg(F.sum("n").alias("n"))


def clean_blocks(rows: DataFrame, text: str) -> list[int]:
    """Blocks of 128 characters that the clean ones of all lines hold; at most _BLOCKS rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(_BLOCKS, bool)
        for batch in batches:
            column = batch.column("text")
            plain = column.filter(pc.invert(batch.column("suspicious"))).to_pylist()
            seen[np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32) >> 7] = True
            for line in column.filter(batch.column("suspicious")).to_pylist():
                blocks = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) >> 7
                if not seen[blocks].all() and _clean(line):  # few lines have a block that no line before them had
                    seen[blocks] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], ["block"])

    found = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(text).rlike(SUSPICIOUS).alias("suspicious")).mapInArrow(run, "block int")
    return sorted(r["block"] for r in found.distinct().collect())


#: Letters of which foreign words are made up to try the margin on, by script, how many words, and the signs around them.
_FOREIGN_LETTERS = {
    "Greek": "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώ", "Cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "Latin": "abcdefghilmnoprstuvzàâäåæçèéêëíîñóôöøúüßœš", "Latin beyond": "aeioustāąćčďēęěğīłńňōőřśşţťūůźż",
}
FOREIGN_WORDS = 300
_AROUND = (("", ""), ("", ""), ("«", "»"), ("“", "”"), ("„", "“"), ("— ", " —"), ("", "…"), ("‘", "’"), ("€", ""), ("• ", ""))


def _foreign(rng: random.Random, letters: str) -> str:
    """A made-up word of a script, as it may stand in a line."""
    word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    word = rng.choice((word, word, word.capitalize(), word.upper()))
    first, last = rng.choice(_AROUND)
    return f"{first}{word}{last}"


def _foreign_gains(repair: Repair, word: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The largest gain of the runs of a word that is put after two characters, of many, and before a space."""
    largest = np.zeros(len(first))
    for m in _RUN.finditer(word):
        before = [first, second, *(np.full(len(first), ord(c)) for c in word[: m.start()])][-2:]
        after = np.full(len(first), ord(f"{word} "[m.end()]))
        largest = np.maximum(largest, repair.gains(m.group(), Places(*before, after)))
    return largest


def _garbled_gains(repair: Repair, signs: np.ndarray, places: np.ndarray, n: np.ndarray) -> Counter:
    """What signs garbled by each encoding at their places weigh by their gain, in steps, rounded down.

    A sign weighs _UNIT for each encoding over all its places. One that stands only once keeps its occurrence: no margin finds signs that the model doesn't know.
    """
    out = Counter()
    order = np.argsort(signs, kind="stable")
    signs, places, n = signs[order], places[order], n[order]
    known, counts = repair.model.counts[0]
    for begin, end in zip(at := np.flatnonzero(np.diff(signs, prepend=-1)), [*at[1:], len(signs)]):
        sign = chr(signs[begin])
        total = counts[np.searchsorted(known, signs[begin])]
        for i in range(begin, end, HELD_LINES):
            here, some = places[i : min(end, i + HELD_LINES)], n[i : min(end, i + HELD_LINES)]
            mask, scored = (1 << _BITS) - 1, {}
            where = Places(here >> 2 * _BITS, here >> _BITS & mask, here & mask)
            weights = np.round(some / total * _UNIT).astype(np.int64)
            for run, times in Counter(garble(sign, codec) for codec in CODECS).items():
                steps = np.minimum(_MOST, repair.gains(run, where, sign if total > 1 else None, scored) * _STEPS).astype(np.int64)
                distinct, back = np.unique(steps, return_inverse=True)
                sums = np.zeros(len(distinct), np.int64)
                np.add.at(sums, back, weights * times)
                out.update(dict(zip(distinct.tolist(), sums.tolist())))
    return out


def _shares(values: np.ndarray, weights: np.ndarray, tried: np.ndarray) -> np.ndarray:
    """What share of the weights values up to each of those tried have."""
    order = np.argsort(values, kind="stable")
    sums = np.concatenate([[0], np.cumsum(weights[order])])
    return sums[np.searchsorted(values[order], tried, side="right")] / max(sums[-1], 1e-300)


def _margin(
    right: Iterable[float], wrong: Iterable[float], least: float = 3.0, right_weights: Iterable[float] | None = None, wrong_weights: Iterable[float] | None = None
) -> tuple[float, float]:
    """The margin, and the share of garbled signs under it, for which the shares of garbled signs missed and of foreign words mistaken
    have the smallest sum; a quarter of the way from where that begins to where it ends."""
    right_, wrong_ = np.array(right, float), np.array(wrong, float)
    tried = np.unique(np.concatenate([[least], right_[right_ > least], wrong_[wrong_ > least]]))
    missed = _shares(wrong_, np.ones(len(wrong_)) if wrong_weights is None else np.array(wrong_weights), tried)
    errors = missed + 1 - _shares(right_, np.ones(len(right_)) if right_weights is None else np.array(right_weights), tried)
    at = int(errors.argmin())
    end = tried[at + 1] if at + 1 < len(tried) else tried[at]
    return float(tried[at] + (end - tried[at]) / 4), float(missed[at])


def set_margin(repair: Repair, garbled: Counter, seed: int = 42) -> None:
    """Sets the margin by what the signs of clean lines gain when garbled, and what foreign words do that are put before each word of those lines.

    It is at least 3 nats, and stays without garbled signs.
    """
    if not garbled:
        return
    rng = random.Random(seed)
    befores, counts, _ = repair.model.after[2]
    starts = np.flatnonzero(np.isin(befores & ((1 << _BITS) - 1), (ord(" "), _START)) & (counts > 0))
    first, second, often = befores[starts] >> _BITS, befores[starts] & ((1 << _BITS) - 1), counts[starts] / counts[starts].sum()
    foreign: dict[str, Counter] = {}
    for script, letters in _FOREIGN_LETTERS.items():
        found = foreign.setdefault(script, Counter())
        for _ in range(FOREIGN_WORDS):
            distinct, back = np.unique(np.minimum(_MOST, np.ceil(_foreign_gains(repair, _foreign(rng, letters), first, second) * _STEPS)), return_inverse=True)
            for steps, share in zip(distinct.tolist(), np.bincount(back, often).tolist()):
                found[steps] += share
    words = sum(foreign.values(), Counter())
    steps = sorted(garbled)
    repair.margin, repair.missed = _margin(
        np.array([*words]) / _STEPS, np.array(steps) / _STEPS, right_weights=[*words.values()], wrong_weights=[float(garbled[x]) for x in steps]
    )
    repair.mistaken = {script: sum(share for x, share in found.items() if x / _STEPS > repair.margin) / FOREIGN_WORDS for script, found in foreign.items()}


def model_of(parts: list[tuple[np.ndarray, np.ndarray]], blocks: Iterable[int]) -> Trigrams:
    """The model of trigrams with their counts, which are added up."""
    grams, counts, _ = _sums(*map(np.concatenate, zip(*parts)))
    return Trigrams(grams[counts > 0], counts[counts > 0], blocks)


def fit(lines: list[str], seed: int = 42) -> Repair:
    """The model of the clean ones of some lines that are in memory, and the margin between clean lines and lines garbled on purpose.

    Lines count as clean by the shape of their signs and not by what the encodings make of them. What their doubtful runs have added to the model is taken
    out of it again. The margin is tried on words of other scripts put before each word of the clean lines, and on each
    of their signs, garbled wherever it stands by each encoding; signs weigh the same, so that rare ones count as much as common ones, and are judged without the
    occurrence that is garbled, unless it is the only one. The margin is at least 3 nats. Without lines the model knows nothing and the margin stays.
    """
    clean = [x for x in lines if _clean(x)]
    blocks = {ord(c) >> 7 for x in clean for c in x}
    signs, places, counted = count_signs(clean)
    judge = Repair(model_of([(places >> _BITS << _BITS | signs, counted)], blocks))
    for _ in range(ROUNDS):
        less = count_signs(clean, [doubtful(judge, x) for x in clean])
        judge = Repair(model_of([(places >> _BITS << _BITS | signs, counted), (less[1] >> _BITS << _BITS | less[0], -less[2])], blocks))
    keys, back = np.unique(np.stack([np.concatenate([signs, less[0]]), np.concatenate([places, less[1]])]), axis=1, return_inverse=True)
    (signs, places), n = keys, np.zeros(keys.shape[1], np.int64)
    np.add.at(n, back, np.concatenate([counted, -less[2]]))
    repair = Repair(judge.model)
    beyond = (signs > 0x7F) & (n > 0)
    set_margin(repair, _garbled_gains(repair, signs[beyond], places[beyond], n[beyond]), seed)
    repair.readings.clear()
    return repair


def fit_all(rows: DataFrame, text: str) -> tuple[Broadcast[Repair], Repair]:
    """What fit gives for all lines of a column: the model as it was broadcast, and with its margin.

    The distinct trigrams of the clean lines come to the driver, 16 bytes each, and are broadcast; the places of signs, of which there are more, stay where they were counted.
    """
    spark = rows.sparkSession
    blocks = clean_blocks(rows, text)
    gram = F.shiftleft(F.shiftright("place", _BITS), _BITS).bitwiseOR(F.col("sign"))

    def grams(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = counts.groupBy(gram.alias("gram")).agg(F.sum("n").alias("n")).toArrow()
        return found.column("gram").to_numpy(), found.column("n").to_numpy()

    counts = sign_counts(rows, text).persist(StorageLevel.DISK_ONLY)
    first = grams(counts)
    repair = Repair(model_of([first], blocks))
    less = counts.limit(0)
    for _ in range(ROUNDS):
        less.unpersist()
        judge = spark.sparkContext.broadcast(repair)
        less = sign_counts(rows, text, judge).persist(StorageLevel.DISK_ONLY)
        repair = Repair(model_of([first, grams(less)], blocks))
    shared = spark.sparkContext.broadcast(repair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _garbled_gains(shared.value, *(batch.column(x).to_numpy() for x in ("sign", "place", "n")))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (found.keys(), found.values())], ["steps", "n"])

    beyond = counts.unionByName(less).where(F.col("sign") > 0x7F).groupBy("sign", "place").agg(F.sum("n").alias("n")).where("n > 0").repartition(spark.sparkContext.defaultParallelism, "sign").sortWithinPartitions("sign")
    garbled = beyond.mapInArrow(run, "steps long, n long").groupBy("steps").agg(F.sum("n").alias("n")).collect()
    counts.unpersist()
    less.unpersist()
    judge.unpersist()
    set_margin(repair, Counter({r["steps"]: r["n"] for r in garbled}))
    return shared, repair


def repairs(frame: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of (key, restored, chains, gain, whole) for each text that is garbled, in whole or in part.

    restored: the text as far as it can be had back; whole: nothing of it stayed lost. A text with U+FFFD, which a
    decoder puts for what it can't read, is garbled, whether or not any of it can be restored; so is one that
    turns likelier by more than the margin. Null and empty texts are not. Repeated rows each come out.
    The model, its margin and the blocks of characters that may come out are taken from all lines (fit_all). A lone
    sign of a block that no clean line holds, beyond the corpus's scripts, is not restored.
    """
    rows = frame.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    shared, fitted = fit_all(rows, "text")
    margin = fitted.margin

    out = T.StructType([
        T.StructField("key", rows.schema["key"].dataType), T.StructField("restored", T.StringType()), T.StructField("chains", T.ArrayType(T.StringType(), False)),
        T.StructField("gain", T.DoubleType()), T.StructField("whole", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = replace(shared.value, margin=margin)
        for batch in batches:
            done = [repair.line(x) for x in batch.column("text").to_pylist()]
            take = [i for i, (x, chains, _) in enumerate(done) if chains or LOST in x]
            made = [done[i] for i in take]
            columns = [
                pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.list_(pa.string())),
                pa.array([x[2] for x in made], pa.float64()), pa.array([LOST not in x[0] for x in made], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(take, pa.int64())), *columns], out.names)

    return rows.where(F.col("text").rlike(SUSPICIOUS)).mapInArrow(run, out).withColumnRenamed("key", key)
