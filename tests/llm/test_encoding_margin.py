"""The margin is set by signs garbled by every encoding."""

from __future__ import annotations

from bhashaloom.llm import encoding as G

LINES = [f"{a} {b} है और {c} में {n} – café" for a in ("नदी", "गाँव") for b in ("सड़क", "बारिश") for c in ("शहर", "स्कूल") for n in range(20)]


def test_every_encoding_counts(monkeypatch):
    tried, garble = set(), G.garble
    monkeypatch.setattr(G, "garble", lambda text, codec: tried.add(codec) or garble(text, codec))
    G.fit(LINES)
    assert tried == set(G.CODECS)
