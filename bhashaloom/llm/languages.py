"""Languages of lines and of the stretches of mixed lines (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bhashaloom.functions.unicode import LETTER, pieces, strip
from bhashaloom.llm.language_model import Model, romanised, softmax, train, words_of

#: The model is fitted on about so many labelled lines of each language, at most twice as many.
LINES_PER_LANGUAGE = 1500
#: Words that a stretch needs to count as a part of a mixed line, and that a line needs to be judged.
STRETCH_WORDS, LINE_WORDS = 5, 6
#: What a change of language within a line costs, in nats.
CHANGE = 7.0
#: How much likelier a language is where the line's label names it: most labels are right, so a label is doubted
#: only if the text speaks clearly against it.
LABEL_ODDS = 2.0


@dataclass(frozen=True)
class Language:
    """A language with the code points of its script and the spellings of its label."""

    name: str
    lo: int
    hi: int
    aliases: tuple[str, ...]


def read_languages(table: DataFrame, most: int = 10_000) -> list[Language]:
    """The languages of a table, which must be small: a model has a row of weights for each."""
    rows = table.select("lang", "lo", "hi", "aliases").where("lang IS NOT NULL").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} languages")
    return [Language(r["lang"], r["lo"], r["hi"], tuple(r["aliases"] or ())) for r in rows]


def label_language(label: Column, languages: list[Language]) -> Column:
    """The language that a label names: trimmed, without regard to case; null if it names none."""
    known = {a.strip().lower(): x.name for x in languages for a in (*x.aliases, x.name)}
    if not known:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*(F.lit(v) for kv in sorted(known.items()) for v in kv)), F.lower(strip(label)))


def fit(frame: DataFrame, text: str, label: str, languages: list[Language], key: str, per_language: int = LINES_PER_LANGUAGE) -> Model:
    """A model from a bounded sample of the labelled lines, by a hash of key and text.

    Lines count whose letters are mostly of the label's script; the rest are taken to be labelled wrong. Lines in
    a script of their own are learnt in Latin spelling, too, as nobody labels those reliably.
    """
    by_name = {x.name: x for x in languages}
    named = frame.select(F.col(key).alias("key"), F.col(text).alias("text"), label_language(F.col(label), languages).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(chance)
    uniform = F.pmod(F.xxhash64(F.lit(42), "key", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = named.where(uniform < chance).orderBy(uniform, "text").limit(2 * per_language * max(1, len(counts))).collect()
    texts, labels = [], []
    for r in sorted(sample, key=lambda r: (str(r["key"]), r["text"])):
        words, spec = words_of(r["text"]), by_name[r["lang"]]
        if sum(sum(spec.lo <= ord(c) <= spec.hi for c in w) * 2 > len(w) for w in words) * 4 < len(words) * 3:
            continue
        texts.append(words)
        labels.append(spec.name)
        if spec.lo > 0x24F:
            texts.append([romanised(w) for w in words])
            labels.append(spec.name)
    return train(texts, labels)


def stretches(scores: np.ndarray) -> list[tuple[int, int, int]]:
    """(language, first word, word after the last) of the likeliest sequence, given each word's log-probabilities."""
    n, k = scores.shape
    best, came = scores[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        top = int(best.argmax())
        change = best[top] - CHANGE
        came[i] = np.where(best >= change, np.arange(k), top)
        best = np.maximum(best, change) + scores[i]
    state, path = int(best.argmax()), [0] * n
    for i in range(n - 1, -1, -1):
        path[i] = state
        state = int(came[i][state])
    out = []
    for i, s in enumerate(path):
        if out and out[-1][0] == s:
            out[-1] = (s, out[-1][1], i + 1)
        else:
            out.append((s, i, i + 1))
    return out


def judge(model: Model, texts: list[list[str]], labels: list[str | None] | None = None) -> list[list[tuple[int, float, int, int]]]:
    """For each text the stretches (language, confidence, first word, word after the last).

    One stretch over all words, unless two languages have STRETCH_WORDS words in a row. None without words.
    The language that a label names counts LABEL_ODDS times for the whole line.
    """
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    parts, squares = model.parts_of(list(chain.from_iterable(texts)))
    scores = model.word_scores(parts, squares)
    whole = softmax(model.text_logits(parts, squares, counts, scores)) if len(texts) else np.zeros((0, len(model.classes)))
    if labels is not None and len(texts):
        number = {c: k for k, c in enumerate(model.classes)}
        for i, label in enumerate(labels):
            if label in number:
                whole[i, number[label]] *= LABEL_ODDS
        whole /= whole.sum(axis=1, keepdims=True)
    top = whole.argmax(axis=1) if len(texts) else np.zeros(0, np.int64)
    other = (scores.max(axis=1) - scores[np.arange(len(scores)), np.repeat(top, counts)] > 0.2) if len(parts) else np.zeros(0, bool)
    ends = np.cumsum(counts)
    against = np.concatenate([[0], np.cumsum(other)])
    against = against[ends] - against[ends - counts]
    out = []
    for i, (n, a, b) in enumerate(zip(counts.tolist(), (ends - counts).tolist(), ends.tolist())):
        if not n:
            out.append([])
            continue
        found = [(int(top[i]), float(whole[i, top[i]]), 0, n)]
        if n >= 2 * STRETCH_WORDS and against[i] >= 2:
            long_ = [x for x in stretches(scores[a:b]) if x[2] - x[1] >= STRETCH_WORDS]
            if len({x[0] for x in long_}) > 1:
                sure = softmax(np.concatenate([model.text_logits(parts[a + s : a + e], squares[a + s : a + e], np.array([e - s]), scores[a + s : a + e]) for _, s, e in long_]))
                found = [(lang, float(p[lang]), s, e) for (lang, s, e), p in zip(long_, sure)]
        out.append(found)
    return out


def identify(frame: DataFrame, key: str, text: str, label: str, languages: DataFrame) -> DataFrame:
    """Rows of (key, n_words, labelled, mixed, stretch, lang, confidence, first_word, end_word), one per stretch.

    A line in one language has one stretch. n_words counts white-space pieces with a letter; first_word and
    end_word count runs of letters. labelled is the language that the label names, or null. Null texts and texts
    without letters have one row whose lang and confidence are null. Repeated rows each have theirs. Without any
    labelled line there is nothing to learn from: lang is then "unknown".
    """
    known = read_languages(languages)
    model = frame.sparkSession.sparkContext.broadcast(fit(frame, text, label, known, key))
    has_letter = f"[{LETTER}]"
    rows = frame.select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.size(F.filter(pieces(F.col(text)), lambda p: p.rlike(has_letter))).cast("int").alias("n_words"),
        label_language(F.col(label), known).alias("labelled"),
    )
    kind = frame.schema[key].dataType.simpleString()
    out = f"key {kind}, n_words int, labelled string, mixed boolean, stretch int, lang string, confidence double, first_word int, end_word int"
    names = [x.split(" ")[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                judged = judge(own, [words_of(t) for t in batch.column("text").to_pylist()], batch.column("labelled").to_pylist())
                take, cells = [], []
                for i, found in enumerate(judged):
                    for s, x in enumerate(found or [None]):
                        take.append(i)
                        cells.append((len({y[0] for y in found}) > 1, s, *((own.classes[x[0]], x[1], x[2], x[3]) if x else (None,) * 4)))
                kept = batch.take(pa.array(take, pa.int64()))
                columns = list(zip(*cells)) or [()] * 6
                kinds = [pa.bool_(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([kept.column("key"), kept.column("n_words"), kept.column("labelled"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    return rows.mapInArrow(run, out).withColumnRenamed("key", key)


def mislabelled(identified: DataFrame, key: str) -> DataFrame:
    """Rows of (key, lang): lines of LINE_WORDS words or more whose label is missing or names another language, or that
    are mixed; one row for each language of the line."""
    wrong = (F.col("n_words") >= LINE_WORDS) & F.col("lang").isNotNull() & (F.col("mixed") | F.col("labelled").isNull() | (F.col("labelled") != F.col("lang")))
    return identified.where(wrong).groupBy(key, "lang").agg(F.count(F.lit(1)).alias("n")).select(key, "lang")
