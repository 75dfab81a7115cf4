"""Foreign text is not taken for garbled text, and the margin is validated on it (problem 6)."""

from __future__ import annotations

import random

import pytest

from bhashaloom.llm import encoding as E

WORDS = "नगर बाजार किसान सड़क पानी village market farmer road water काम शहर नदी पर्वत the and with".split()
FOREIGN = ["Ελληνικά και Русский текст", "naïve café, señor", "Đồng đội", "«слово» — Москва", "L’été à l’école", "Größe ‘müde’ …", "Ł Ž Ő", "Ωρία"]


@pytest.fixture(scope="module")
def repair():
    rng = random.Random(4)
    lines = [" ".join(rng.choices([*WORDS, "é", "“शहर”", "—", "किसान’s"], weights=[9] * len(WORDS) + [1] * 4, k=10)) for _ in range(3000)]
    return E.fit([*lines, *FOREIGN])


def test_foreign_lines_are_clean(repair):
    assert all(map(E._clean, FOREIGN))
    for text in FOREIGN:
        assert repair.line(f"{WORDS[0]} {text} {WORDS[1]}") == (f"{WORDS[0]} {text} {WORDS[1]}", [], 0.0)


def test_margin_is_validated(repair):
    assert repair.margin >= 3 and set(repair.mistaken) == {"Greek", "Cyrillic", "Latin", "Latin beyond"}
    assert max(repair.mistaken.values()) <= 0.02 and repair.missed <= 0.05
    assert E._margin([0.0, 1.0, 50.0], [10.0, 20.0, 30.0])[0] == 3 + 7 / 4


@pytest.mark.parametrize("codec", ["cp1252", "latin_1", "mac_roman", "cp1251", "cp437"])
def test_garbled_lines_are_found(repair, codec):
    text = "नगर बाजार village पानी"
    assert not E._clean(E.garble(text, codec)) and repair.line(E.garble(text, codec))[0] == text


def test_shapes():
    assert all(map(E.shaped, ["é", "Ωρία", "«слово»", "ΑΒΓ", "été", "—", "…", "Đồ"]))
    assert not any(map(E.shaped, ["â€“", "Ã©", "РџСЂ", "в„ў", "‚Äì", "ª", "аґ†"]))
