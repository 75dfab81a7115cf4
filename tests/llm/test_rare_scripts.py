"""Garbled lines in scripts that the sample of the model doesn't hold."""

from __future__ import annotations

from bhashaloom.llm import encoding as G

CLEAN = [f"{a} {b} है और {c} में {n}" for a in ("नदी", "गाँव", "पानी") for b in ("सड़क", "बारिश", "जंगल") for c in ("शहर", "स्कूल", "घर") for n in range(60)]


def test_scripts_outside_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(G, "TRAINING_LINES", 400)
    monkeypatch.setattr(G, "HELD_LINES", 100)
    garbled = {5000: "தமிழ் மொழி", 5001: "ভাষা নদী", 5002: "नदी 😀 पानी"}
    rows = list(enumerate(CLEAN)) + [(4000, "the clean 😃 one")] + [(i, G.garble(x, "cp1251")) for i, x in garbled.items()] + [(6000, "Đồng Трамка Ωρία")]
    frame = spark.createDataFrame(rows, "line_id long, line string")
    got = {r["line_id"]: r["restored"] for r in G.repairs(frame, "line_id", "line").collect()}
    assert got == garbled


def test_blocks_of_clean_lines(spark):
    lines = [None, "", "abc", "नदी", "a 😀", "Ж x", G.garble("தமிழ்", "cp1252")]
    assert set(G.clean_blocks(spark.createDataFrame([(x,) for x in lines], "line string"), "line")) == {ord(c) >> 7 for c in "aन😀Ж"}
