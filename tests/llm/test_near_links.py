"""Links of near-duplicates are all found in parts of any size."""

from __future__ import annotations

import random

from bhashaloom.llm import near_duplicates as N
from bhashaloom.llm import residue_neighbours as RN


def test_links_within_large_parts(spark, monkeypatch):
    rng = random.Random(5)
    body = [f"w{i}" for i in range(160)]
    texts = []
    for i in range(60):  # alike, mostly; all share nearly all parts
        own = list(body)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(160)] = f"x{i}"
        texts.append(" ".join(own))
    texts += [" ".join(body[:80] + [f"y{i}_{j}" for j in range(80)]) for i in range(10)]  # share parts, not alike
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    firsts = sorted(first.values())
    want = {(a, b) for a in firsts for b in firsts if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert len(want) > 500
    for large in (7, 200):
        monkeypatch.setattr(N, "LARGE_PART", large)
        found = [(r["a"], r["b"]) for r in N.links(frame, "doc_id", "text")[0].collect()]
        assert len(found) == len(set(found)) and set(found) == want
    monkeypatch.setattr(N, "LARGE_PART", 7)
    links = {r["doc_id"]: r["n_links"] for r in RN.classes(frame, "doc_id", "text").collect()}
    assert all(links[i] == sum(i in p for p in want) for i in firsts)
