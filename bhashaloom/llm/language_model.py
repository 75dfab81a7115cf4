"""A sparse multinomial logistic regression for languages, on TF-IDF of character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties (McMahan and others 2013), calibrated by a
temperature (Guo and others 2017). Texts are rows of words; a word's n-grams are hashed with its borders, and the
features of a text are those of its words one after the other, divided by their common length. So a text's logits
are sums over its words, which are worked out once for each distinct word.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import regex
import xxhash

#: Longest n-gram, and hashed features.
LONGEST, FEATURES = 4, 1 << 17
#: The least probability that a word leaves to a class, and how much words by themselves count in a text.
FLOOR, WORD_WEIGHT = 1e-3, 0.5

WORD = regex.compile(r"[\p{L}\p{M}]+")
_TAG, _FORMAT = regex.compile(r"<[^<>]*>"), regex.compile(r"\p{Cf}+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and marks in lower case, without tags and format characters."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _FORMAT.sub("", text)
    return WORD.findall(text.lower())


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words one after the other, and how many each word has: up to LONGEST characters, and the
    whole word. The hash is the upper 17 bits. Words of any length are read whole."""
    padded = [f"\x02{w}\x03" for w in words]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(padded)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from here to the word's end
    rolling, hashes, owners = np.zeros(len(codes), np.uint64), [], []
    with np.errstate(over="ignore"):
        for n in range(1, LONGEST + 1):
            if len(codes) < n:
                break
            rolling = rolling[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
            mixed = rolling * np.uint64(0x9E3779B97F4A7C15)
            keep = left[: len(rolling)] >= n
            hashes.append((mixed[keep] >> np.uint64(47)).astype(np.int64))
            owners.append(word[: len(rolling)][keep])
    long_ = [i for i, w in enumerate(padded) if len(w) > LONGEST]
    hashes.append(np.fromiter((xxhash.xxh32_intdigest(padded[i]) >> 15 for i in long_), np.int64, len(long_)))
    owners.append(np.array(long_, np.int64))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(hashes)[order], np.bincount(owner, minlength=len(words))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of so many rows each; 0 for none."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _repeated(values: np.ndarray, counts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values, of so many each, in an order that may repeat them; and the runs' lengths."""
    n = counts[order]
    ends = np.cumsum(n)
    return values[np.arange(int(n.sum())) + np.repeat((np.cumsum(counts) - counts)[order] - (ends - n), n)], n


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """Weights by feature and class, and what texts need to become features."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0
    text_temperature: float = 1.0
    known: dict[str, int] = field(default_factory=dict)
    most_known: int = 400_000

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "parts", "squares")} | {"known": {}}

    def parts_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word: its part of the logits before division, and the square of its length."""
        if len(self.known) > self.most_known or not hasattr(self, "parts"):
            self.known.clear()
            self.parts, self.squares = np.zeros((0, len(self.classes)), np.float32), np.zeros(0, np.float32)
        if new := [w for w in dict.fromkeys(words) if w not in self.known]:
            hashes, counts = ngrams(new)
            value = self.idf[hashes]
            parts = _sums(self.weights[hashes] * value[:, None], counts).astype(np.float32)
            first, end = len(self.known), len(self.known) + len(new)
            if end > len(self.squares):
                grow = max(end, 2 * len(self.squares)) - len(self.squares)
                self.parts = np.concatenate([self.parts, np.zeros((grow, parts.shape[1]), np.float32)])
                self.squares = np.concatenate([self.squares, np.zeros(grow, np.float32)])
            self.parts[first:end], self.squares[first:end] = parts, _sums(value * value, counts)
            self.known.update(zip(new, range(first, end)))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return self.parts[at], self.squares[at]

    def logits(self, parts: np.ndarray, squares: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Calibrated logits of texts of so many words each."""
        return (_sums(parts, counts) / np.sqrt(np.maximum(_sums(squares, counts), 1e-9))[:, None] + self.bias) / self.temperature

    def word_scores(self, parts: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """Log-probabilities of each word by itself; none falls below FLOOR, so that no word decides alone."""
        if not len(parts):
            return np.zeros(parts.shape)
        return np.log(np.maximum(softmax(self.logits(parts, squares, np.ones(len(parts), np.int64))), FLOOR))

    def text_logits(self, parts: np.ndarray, squares: np.ndarray, counts: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Calibrated logits of texts by all their features together and by their words one by one: in a long text, whose
        features are divided by a great length, a few telling words would else hardly count."""
        together = self.logits(parts, squares, counts) * self.temperature
        return (together + WORD_WEIGHT * _sums(scores, counts)) / self.text_temperature

    def predict(self, texts: list[list[str]]) -> np.ndarray:
        """Probabilities of each class for texts given as words."""
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        parts, squares = self.parts_of(list(chain.from_iterable(texts)))
        return softmax(self.text_logits(parts, squares, counts, self.word_scores(parts, squares)))


def train(texts: list[list[str]], labels: list[str], *, epochs: int = 2, batch: int = 128, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.3, l2: float = 1e-4, held_out: float = 0.1, seed: int = 42) -> Model:
    """Fits a model; texts given as words, those without words left out. The held-out part sets the temperature.

    Each text is also seen as a stretch of one to six of its words, so that the model learns to judge short ones.
    """
    rng = np.random.default_rng(seed)
    known = [i for i, t in enumerate(texts) if t]
    classes = sorted({labels[i] for i in known})
    if len(classes) < 2:
        return Model(classes or ["unknown"], np.zeros((FEATURES, max(1, len(classes))), np.float32), np.zeros(max(1, len(classes))), np.ones(FEATURES))
    number = {c: k for k, c in enumerate(classes)}
    order = rng.permutation(known)
    cut = int(len(order) * held_out)
    held, used = order[:cut], order[cut:]

    rows, targets = [], []
    for i in used:
        t = texts[i]
        rows.append(t)
        n = int(rng.integers(1, 7))
        at = int(rng.integers(0, max(1, len(t) - n + 1)))
        rows.append(t[at : at + n])
        targets += [number[labels[i]]] * 2
    targets = np.array(targets)
    spoken = list(chain.from_iterable(rows))
    place = {w: i for i, w in enumerate(dict.fromkeys(spoken))}
    flat, per_word = _repeated(*ngrams(list(place)), np.fromiter(map(place.__getitem__, spoken), np.int64, len(spoken)))
    words = np.fromiter(map(len, rows), np.int64, len(rows))
    features = _sums(per_word.astype(np.float64), words).astype(np.int64)
    ends = np.cumsum(features)
    pairs = np.sort(np.repeat(np.arange(len(rows)), features) * FEATURES + flat)
    seen = pairs[np.diff(pairs, prepend=-1) != 0] % FEATURES  # each feature once for each row
    having = np.bincount(seen, minlength=FEATURES)
    idf = np.where(having > 0, np.log((1 + len(rows)) / (1 + having)) + 1, 0).astype(np.float32)  # features never seen say nothing

    k = len(classes)
    z, n2 = np.zeros((FEATURES, k), np.float32), np.zeros((FEATURES, k), np.float32)
    bias = np.zeros(k)

    def weights(at: np.ndarray) -> np.ndarray:
        a, b = z[at], n2[at]
        return np.where(np.abs(a) <= l1, 0, -(a - np.sign(a) * l1) / ((beta + np.sqrt(b)) / alpha + l2))

    for _ in range(epochs):
        shuffled = rng.permutation(len(rows))
        for start in range(0, len(shuffled), batch):
            some = shuffled[start : start + batch]
            at = np.concatenate([np.arange(ends[i] - features[i], ends[i]) for i in some])
            hashes, owner = flat[at], np.repeat(np.arange(len(some)), features[some])
            value = idf[hashes]
            length = np.sqrt(np.bincount(owner, value * value, minlength=len(some)))
            value = value / np.maximum(length[owner], 1e-9)
            by_hash = np.argsort(hashes, kind="stable")
            first = np.flatnonzero(np.diff(hashes[by_hash], prepend=-1))
            touched, back = hashes[by_hash[first]], np.empty(len(hashes), np.int64)
            back[by_hash] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(hashes))))
            w = weights(touched)
            wrong = softmax(np.add.reduceat(value[:, None] * w[back], np.cumsum(features[some]) - features[some], axis=0) + bias)
            wrong[np.arange(len(some)), targets[some]] -= 1
            g = np.add.reduceat((value[:, None] * wrong[owner])[by_hash], first, axis=0)
            old = n2[touched]
            new = old + g * g
            z[touched] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n2[touched] = new
            bias -= 0.05 * wrong.mean(axis=0)
    model = Model(classes, weights(np.arange(FEATURES)).astype(np.float32), bias, idf)
    if len(held):
        own, goal = [texts[i] for i in held], np.array([number[labels[i]] for i in held])
        counts = np.fromiter(map(len, own), np.int64, len(own))
        parts, squares = model.parts_of(list(chain.from_iterable(own)))
        model.temperature = _temperature(model.logits(parts, squares, counts), goal)
        model.text_temperature = _temperature(model.text_logits(parts, squares, counts, model.word_scores(parts, squares)), goal)
    return model


def _temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The temperature under which the held-out labels are likeliest; labels may be wrong, so each class keeps a hundredth."""

    def loss(t: float) -> float:
        p = softmax(logits / t)[np.arange(len(targets)), targets]
        return -np.log(0.99 * p + 0.01 / logits.shape[1]).mean()

    return float(min(np.geomspace(0.05, 8, 70), key=loss))


#: How names of letters are written in Latin letters; other letters keep their Unicode name's spelling. Fixed values.
_SPELLING = {
    "c": "ch", "ch": "chh", "tt": "t", "tth": "th", "dd": "d", "ddh": "dh", "nn": "n", "nnn": "n", "ll": "l", "lll": "zh", "rr": "r", "ss": "sh", "ny": "ny", "ng": "ng",
    "aa": "aa", "ii": "ee", "uu": "oo", "ee": "e", "oo": "o", "vocalic r": "ri", "candra e": "e", "candra o": "o", "rra": "r", "ddd": "d", "dddh": "dh",
}
_SCRIPTS = ("DEVANAGARI", "GUJARATI", "MALAYALAM", "KANNADA", "ORIYA", "BENGALI", "TAMIL", "TELUGU", "GURMUKHI")
#: Scripts whose words lose a final inherent vowel in speech.
_SILENT = ("DEVANAGARI", "GUJARATI", "GURMUKHI", "BENGALI")
_TABLE: dict[str, tuple[str, str, str]] = {}


def _letter(ch: str) -> tuple[str, str, str]:
    """(kind, Latin spelling, script) of a character, by its Unicode name."""
    if ch not in _TABLE:
        name = unicodedata.name(ch, "")
        script, _, rest = name.partition(" ")
        kind, said = "", ch
        if script in _SCRIPTS:
            if rest.startswith("LETTER CHILLU "):
                kind, said = "vowel", rest.split()[-1].lower()
                said = _SPELLING.get(said, said)
            elif rest == "SIGN NUKTA":
                kind, said = "dot", ""
            elif rest.startswith("LETTER ") and rest != "LETTER YYA":
                sound = rest[7:].lower()
                if sound.endswith("a") and sound not in ("a", "aa"):
                    kind, said = "consonant", _SPELLING.get(sound[:-1], sound[:-1])
                else:
                    kind, said = "vowel", _SPELLING.get(sound, sound.rpartition(" ")[2])
            elif rest.startswith("VOWEL SIGN "):
                kind, said = "sign", _SPELLING.get(rest[11:].lower(), rest[11:].lower().rpartition(" ")[2])
            elif rest == "SIGN VIRAMA":
                kind, said = "virama", ""
            elif rest in ("SIGN ANUSVARA", "SIGN CANDRABINDU"):
                kind, said = "nasal", "n"
            else:
                kind, said = "mark", "h" if rest == "SIGN VISARGA" else ""
        _TABLE[ch] = (kind, said, script)
    return _TABLE[ch]


def romanised(word: str) -> str:
    """An Indic word as people type it in Latin letters; other words stay as they are."""
    out, open_, last = [], False, ""
    for ch in word:
        kind, said, script = _letter(ch)
        if open_ and kind not in ("sign", "virama", "mark"):
            out.append("a")
        if kind != "mark" or said:
            out.append(said)
        open_ = kind == "consonant" or (open_ and kind == "mark" and not said)
        last = script
    if open_ and last not in _SILENT:
        out.append("a")
    return "".join(out)
