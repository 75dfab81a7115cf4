"""Cleaning against pinned cases and a plain row-by-row oracle."""

from __future__ import annotations

import itertools
import random
import re
import unicodedata

import pytest

from bhashaloom.config import REPLACEMENTS, SCRIPT_RANGES, Cleaning
from bhashaloom.operators.clean import clean, counters, process

PINNED = [
    ("Hindi", "", ""),
    ("Hindi", None, ""),
    ("Hindi", "  　", ""),
    ("other", "<b>abcdefghij</b>", "abcdefghij"),
    ("other", "abcde < fghij", "abcde < fghij"),
    ("other", "<script>abcdefgh</script>", "abcdefgh"),
    ("other", "abcd", ""),
    ("other", "abcde", "abcde"),
    ("other", "abcaaaaab", "abcaaaaab"),
    ("other", "abcaaaaaab", ""),
    ("other", "abcdefghij" + "\U0001f600" * 6, ""),
    ("other", "abc123", "abc123"),
    ("other", "abc1234", ""),
    ("Hindi", "कखगab", ""),
    ("Hindi", "कखगघa", "कखगघa"),
    ("Kannada", "ನೝನೝನ", "ನೝನೝನ"),
    ("other", "ﬁeld ① abcdef…", "field 1 abcdef..."),
    ("other", "abc  def", "abc  def"),
    ("Hindi", "कखगघ१॰‍", "कखगघ1."),
    ("Gujarati", "કખગઘ્ਾઙ", "કખગઘાઙ"),
    ("other", "\x1fabcdef　", "abcdef"),
    ("other", "abc\x01def\x7fgh", "abcdef\x7fgh"),
    ("other", "abc\t\n  def", "abc def"),
]


def by_hand(line: str | None, lang: str) -> str:
    if line is None or not line.strip():
        return ""
    text = re.sub("<[^>]+>", "", line)
    text = re.sub(" +", " ", re.sub("[\t\n\r]+", " ", text)).strip()
    text = "".join(c for c in text if c in "\n\t" or ord(c) >= 32)
    text = unicodedata.normalize("NFKC", text)
    for source, target in REPLACEMENTS.get(lang, {}).items():
        text = text.replace(source, target)
    letters = [c for c in text if c.isalpha()]
    longest = max((len(list(g)) for _, g in itertools.groupby(text)), default=0)
    if len(text) < 5 or longest > 5 or len(letters) / max(1, len(text)) < 0.5:
        return ""
    if lang in SCRIPT_RANGES and letters:
        lo, hi = SCRIPT_RANGES[lang]
        if sum(lo <= ord(c) <= hi for c in letters) / len(letters) <= 0.6:
            return ""
    return text.strip()


def cleaned(spark, rows, settings=Cleaning()):
    frame = spark.createDataFrame([(i, lang, line) for i, (lang, line) in enumerate(rows)], "id long, lang string, line string")
    return {r["id"]: r["text"] for r in clean(frame, "line", "lang", settings).collect()}


def test_pinned(spark):
    got = cleaned(spark, [(lang, line) for lang, line, _ in PINNED])
    assert [got[i] for i in range(len(PINNED))] == [x for _, _, x in PINNED]


def test_random_lines(spark):
    rng = random.Random(5)
    signs = list("aab<>/ \t\r1.  　‌‍ﬁ…") + [chr(c) for lo, hi in SCRIPT_RANGES.values() for c in range(lo + 5, hi, 3) if unicodedata.category(chr(c)) != "Cn"]
    langs = [*SCRIPT_RANGES, "unknown"]
    rows = [(lang, "".join(rng.choices(signs[: 19 if rng.random() < 0.1 else None], k=rng.randint(0, 25)))) for lang in langs for _ in range(300)]
    own = []
    for lang in SCRIPT_RANGES:
        lo, hi = SCRIPT_RANGES[lang]
        letters = [chr(c) for c in range(lo, hi + 1) if chr(c).isalpha()] + list("  ab1")
        own += [(lang, "".join(rng.choices(letters, k=rng.randint(3, 20)))) for _ in range(200)]
    got = cleaned(spark, rows + own)
    assert [got[i] for i in range(len(rows + own))] == [by_hand(line, lang) for lang, line in rows + own]


def test_switches(spark):
    assert cleaned(spark, [("Hindi", "12345")], Cleaning(remove_low_quality=False))[0] == "12345"  # no letters pass the script filter
    assert cleaned(spark, [("Hindi", "abcde")], Cleaning(script_filtering=False))[0] == "abcde"
    assert cleaned(spark, [("other", "ﬁelds")], Cleaning(clean_unicode=False))[0] == "ﬁelds"


@pytest.mark.parametrize("deduplicate", [True, False])
def test_deduplication_and_counts(spark, deduplicate):
    rows = [(1, "x", "same line"), (2, "x", " same  line"), (3, "y", "same line"), (4, "x", "no"), (5, "x", None)]
    frame = spark.createDataFrame(rows, "id long, lang string, line string")
    settings = Cleaning(deduplicate=deduplicate)
    kept = {(r["lang"], r["id"]) for r in process(frame, "line", "lang", "id", settings).collect()}
    assert kept == ({("x", 1), ("y", 3)} if deduplicate else {("x", 1), ("x", 2), ("y", 3)})
    for r in counters(frame, "line", "lang", settings).collect():
        assert r["n_read"] == r["n_kept"] + r["n_skipped"]
        assert r["n_kept"] == len([k for k in kept if k[0] == r["lang"]])


def test_empty_table(spark):
    frame = spark.createDataFrame([], "id long, lang string, line string")
    assert process(frame, "line", "lang", "id").count() == 0
    assert counters(frame, "line", "lang").count() == 0
