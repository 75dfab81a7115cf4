"""Words of any length are read whole by the language model."""

from __future__ import annotations

from bhashaloom.llm import language_model as M


def test_long_words_with_one_beginning():
    start = "abcdefgh" * 8
    one, two = (M.ngrams([start + end])[0].tolist() for end in ("river", "street"))
    assert one != two and M.ngrams(["x" * 100_000])[1].tolist() == [sum(100_003 - n for n in range(1, M.LONGEST + 1)) + 1]
