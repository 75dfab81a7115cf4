"""The model of problem 6 and its margin come from all lines."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from bhashaloom.llm import encoding as G

CLEAN = [f"{a} {b} है और {c} में {n}" for a in ("नदी", "गाँव", "पानी") for b in ("सड़क", "बारिश", "जंगल") for c in ("शहर", "स्कूल", "घर – café") for n in range(20)]
LINES = [*CLEAN, "Трамка naïve", "", "x\u0002", "lost �", "fairÔäó", "™ road", *(G.garble(x, c) for x, c in zip(CLEAN[::50], G.CODECS))]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([*enumerate(LINES), (-1, None)], "line_id long, line string").repartition(3)


def test_batches_change_nothing(frame, monkeypatch):
    found = []
    for training, held, size in ((12_000, 3_000, 4_000_000), (20, 5, 4_000_000), (12_000, 3_000, 100)):
        monkeypatch.setattr(G, "TRAINING_LINES", training)
        monkeypatch.setattr(G, "HELD_LINES", held)
        monkeypatch.setattr(G, "_CHARACTERS", size, raising=False)
        found.append(sorted(map(tuple, G.repairs(frame, "line_id", "line").drop("chains").collect())))
    assert len(found[0]) > 10 and found[0] == found[1] == found[2]


def test_a_table_is_fitted_like_its_lines(frame):
    shared, table = G.fit_all(frame.where("line IS NOT NULL"), "line")
    lines = G.fit(LINES)
    assert (table.margin, table.missed, table.mistaken) == (lines.margin, lines.missed, lines.mistaken)
    for repair in (shared.value, table):
        assert repair.model.blocks >= lines.model.blocks
        for a, b in zip(repair.model.counts + repair.model.after, lines.model.counts + lines.model.after):
            assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_every_clean_line_is_counted(frame):
    got = {(r["sign"], r["place"]): r["n"] for r in G.sign_counts(frame, "line").collect()}
    want = Counter()
    for x in filter(G._clean, LINES):
        padded = f"\x02\x02{x}\x03\x02"
        for i in range(len(x) + 1):
            a, b, sign, after = map(ord, padded[i : i + 4])
            want[sign, a << 42 | b << 21 | after] += 1
    assert got == dict(want)
    signs, places, n = G.count_signs(["ab cd", "x"], [[(1, 2)], [(0, 1)]])
    assert sorted(zip(map(chr, signs), n.tolist())) == [("\x03", 1), (" ", 1), ("b", 1), ("c", 1), ("x", 1)]


def test_more_characters_than_can_be_packed():
    text = "".join(map(chr, [*range(0x100, 0xD800), *range(0xE000, 0x14000)]))
    signs, places, n = G.count_signs([text, "ab", ""])
    assert len(signs) == len(text) + 1 + 3 + 1 and n.tolist() == [1] * len(signs)
    assert (ord("a"), 2 << 42 | 2 << 21 | ord("b")) in set(zip(signs.tolist(), places.tolist()))


def test_scores_agree():
    model = G.fit(LINES).model
    for before, text, after in (("", "नदी", " "), ("ab", "é", ""), (" ", "Ω™", "x"), ("द", "ी ", "क")):
        own, then = model.scores(text, G.Places.of(before, after))
        assert own[0] == pytest.approx(model.log_probability(before + text, len(before)))
        assert then[0] == pytest.approx(model.log_probability(before + text + after, len(before + text)))


def test_garbled_into_a_word_is_found():
    lines = [f"{a} {b} road{end}" for a in ("village", "market", "fair") for b in ("water", "field", "farmer") for end in (" now", "™ now", "™", "") for _ in range(40)]
    repair = G.fit([*lines, "market fairÔäó now"])
    assert repair.line("market fairÔäó now")[0] == "market fair™ now"


def test_foreign_words_that_can_be_misread_are_learned():
    russian = "город паром рама драма река слово окно".split()  # cp866 makes Indic letters of some
    lines = [f"{a} नगर सड़क {b} पानी" for a in russian for b in russian for _ in range(4)] + ["गोத தமிழ்"] * 20
    repair = G.fit(lines)
    for text in lines[::9]:
        assert repair.line(text)[0] == text
    for codec in ("cp1251", "cp1252", "latin_1"):
        text = "город नगर паром река"
        assert repair.line(G.garble(text, codec))[0] == text
