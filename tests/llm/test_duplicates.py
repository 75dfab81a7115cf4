"""Formatting duplicates, overlaps of splits, leaked passages, near-duplicates and components."""

from __future__ import annotations

import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from bhashaloom.llm import components as C
from bhashaloom.llm import cross_split as O
from bhashaloom.llm import format_duplicates as D
from bhashaloom.llm import leaks as E
from bhashaloom.llm import near_duplicates as N

SAME = [
    "name: Ada Rose | place: Home | year: 1990",
    "place=home;NAME=ada rose;year=1990",
    '{"year": "1990", "name": "ada rose", "place": "home"}',
    "Year - 1990 | Name - ADA  ROSE | Place - home !",
    "﻿{\"place\":\"home\",　\"year\":1990, \"name\":\"Ada​ Rose\"}",
]


def found(spark, lines, ids=None):
    frame = spark.createDataFrame([(i, x, 1, "z") for i, x in zip(ids or range(len(lines)), lines)], "line_id long, line string, copies int, h1 string")
    return {(r["keep_id"], r["dup_id"]) for r in D.format_duplicates(frame, "line_id", "line").collect()}


def test_forms_of_a_record(spark):
    assert found(spark, SAME) == {(0, i) for i in range(1, 5)}
    swapped = "name: Home | place: Ada Rose | year: 1990"
    assert found(spark, [SAME[0], swapped]) == set()
    assert found(spark, ["a: 12 | b: 3", "a: 1 | b: 23"]) == set()
    assert found(spark, ["a: 1 | a: 1 | b: 2", "a: 1 | b: 2 | b: 2", "b: 2 | a: 1 | a: 1"]) == {(0, 2)}


def test_prose(spark):
    lines = ["Hello, world 12!", "hello　WORLD\t12", "hello world 1 2", "<b>hello world 12</b>", "hello world", None, "", "?!", "?!", "Hello, world 12!"]
    assert found(spark, lines) == {(0, 1), (0, 2), (0, 9)}
    assert found(spark, []) == set()


def test_long_and_null_ids(spark):
    assert found(spark, ["x" * 200_000, "X " * 200_000, "y", "y"], [5, 3, None, 4]) == {(3, 5)}


def test_hot_group_and_counts(spark):
    lines = ["the same line"] * 3000 + [f"line {i}" for i in range(100)]
    frame = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    assert D.format_duplicates(frame, "line_id", "line").count() == 2999
    got = Counter({r["keep_id"]: r["copies"] for r in D.collapsed(frame, "line_id", "line").collect()})
    assert got[0] == 3000 and len(got) == 101


def by_hand(rows, share=0.8):
    def words(t):
        return [w for p in (t or "").split() if (w := "".join(c for c in p if unicodedata.category(c)[0] in "LMN").lower())]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
        return row[-1]

    split = defaultdict(list)
    for i, lang, test, text in rows:
        if None not in (i, lang, test) and words(text):
            split[test].append((i, lang, words(text)))
    return {(i, j) for i, a, x in split[True] for j, b, y in split[False] if a == b and lcs(x, y) >= share * max(len(x), len(y)) - 1e-9}


def overlapping(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, lang string, test boolean, text string, n int, h1 string")
    return {(r["test_id"], r["train_id"]) for r in O.overlaps(frame, "id", "text", "test", "lang").collect()}


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(160):
        n = rng.choice([1, 2, 3, 5, 8, 12, 20, 45, 60])
        base = [rng.choice(vocabulary) for _ in range(n)]
        for test in (True, False):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, n // 4))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary + ["ए", "NEW,"])
            if rng.random() < 0.3 and len(copy) > 1:
                copy.insert(rng.randrange(len(copy)), copy.pop())
            rows.append((len(rows), rng.choice(["a", "b"]) if rng.random() < 0.2 else "a", test, " ".join(copy)))
    want = by_hand(rows)
    assert len(want) > 50 and overlapping(spark, rows) == want


def test_overlaps_edges(spark):
    line = "one two three four five"
    rows = [(1, "a", True, line), (2, "a", False, "One, two three FOUR five!"), (3, "b", False, line), (4, "a", None, line), (None, "a", False, line), (5, None, False, line), (6, "a", False, None),
            (7, "a", False, ""), (8, "a", True, "?!"), (9, "a", False, "?!"), (10, "a", False, "x " * 50_000), (11, "a", False, line)]
    assert overlapping(spark, rows) == {(1, 2), (1, 11)}
    assert overlapping(spark, []) == set()
    assert overlapping(spark, [r for r in rows if r[2] is not True]) == set()
    many = [(i, "a", i % 2 == 0, line) for i in range(120)]
    assert len(overlapping(spark, many)) == 3600


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(1, 12))] for _ in "xy")
        want = len(by_hand([(1, "x", True, " ".join(a)), (2, "x", False, " ".join(b))], O.shared_in_order(a, b) / max(len(a), len(b)) if O.shared_in_order(a, b) else 2))
        assert want == (1 if O.shared_in_order(a, b) else 0)


def leaked(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item int")
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc int")
    return {(r["doc"], r["item"]): r["run"] for r in E.leaked_passages(d, "doc_id", "text", q, "item_id", "text").collect()}


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(8, 40)))) for i in range(20)]
    docs = []
    for i in range(60):
        ws = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        own = rng.choice(items)[1].split()
        at, n = rng.randrange(len(own)), rng.randint(5, 25)
        k = rng.randint(0, len(ws))
        docs.append((i, " ".join(ws[:k] + own[at : at + n] + ws[k:])))
    want = set()
    for d, t in docs:
        grams = {tuple(t.split()[k : k + 12]) for k in range(len(t.split()) - 11)}
        want |= {(d, i) for i, u in items for k in range(len(u.split()) - 11) if tuple(u.split()[k : k + 12]) in grams}
    assert len(want) > 10 and set(leaked(spark, docs, items)) == want
    monkeypatch.setattr(E, "BROADCAST_WORDS", 100)
    assert set(leaked(spark, docs, items)) == want


def test_leaks_edges(spark):
    words = "a b c d e f g h i j k 9"
    docs = [(1, "x " + words.upper().replace("9", "९") + " y"), (2, "a <b>b</b> c, d e f g h<br> i j! k\n9"), (3, "a b c d e f g h i j k"), (4, None), (5, ""), (None, words), (6, words + " z " * 100_000), (1, words)]
    got = leaked(spark, docs, [(1, words), (2, None), (3, ""), (4, "short"), (1, words)])
    assert set(got) == {(1, 1), (2, 1), (None, 1), (6, 1)} and set(got.values()) == {12}
    assert leaked(spark, [], [(1, words)]) == {} and leaked(spark, docs, []) == {}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)] + [(300, 301 + i) for i in range(1500)]
    rng.shuffle(links)
    got = {r["id"]: r["component"] for r in C.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 100} | {300 + i: 300 for i in range(1501)}
    assert C.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def texts_and_links(rng):
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 30, 80]))]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy) + ("." if rng.random() < 0.5 else ""))
    sets = [{tuple(t.replace(".", "").split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in texts]
    return texts, sets


def near(spark, texts):
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, n int, first int")
    pairs, members = N.links(frame, "doc_id", "text")
    return pairs.cache(), {r["id"]: r["first"] for r in members.collect()}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    texts, sets = texts_and_links(random.Random(6))
    for large in (200, 2):  # with and without holding large parts against one text first
        monkeypatch.setattr(N, "LARGE_PART", large)
        pairs, first = near(spark, texts)
        joined = {r["id"]: r["component"] for r in C.components(pairs, "a", "b").collect()}
        place = {i: joined.get(first[i], first[i]) for i in first}
        for i in range(len(texts)):
            for j in range(i):
                alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if alike >= 0.8:
                    assert place[i] == place[j]
        found = {(r["a"], r["b"]): r["similarity"] for r in pairs.collect()}
        assert all(abs(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) - s) < 1e-9 and s >= 0.8 for (a, b), s in found.items())
        if large == 200:
            firsts = sorted(set(first.values()))
            assert set(found) == {(a, b) for a in firsts for b in firsts if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}


def test_near_duplicates_edges(spark):
    pairs, first = near(spark, [None, "", "?!", "same words here", "Same, words here!", "x " * 60_000])
    assert pairs.count() == 0 and first == {3: 3, 4: 3, 5: 5}
    assert near(spark, [])[1] == {}
    assert N.similarity(np.array([1, 2, 3]), np.array([2, 3, 4])) == 0.5


def test_plain_words(spark):
    text = spark.createDataFrame([("<i>A</i>b, २०೩  C",)], "t string").select(E.plain_words(F.col("t")).alias("w")).first()["w"]
    assert text == "ab 203 c"
