"""The quick filters before the rules of residue pass over nothing that a rule finds."""

from __future__ import annotations

import re
from itertools import product
from re import _parser as P

import pytest

from bhashaloom.llm import residue as R


def written(tree) -> list[str]:
    """Texts that a parsed pattern matches: every alternative, the least and one more of every repetition."""
    every = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            some = [chr(arg)]
        elif name == "IN":
            some = ["".join(sign(arg))]
        elif name in ("NOT_LITERAL", "ANY"):
            some = ["z"]
        elif name == "BRANCH":
            some = [x for branch in arg[1] for x in written(branch)]
        elif name == "SUBPATTERN":
            some = written(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            some = [x * n for x in written(inner) for n in {least, min(least + 1, int(most))}]
        elif name == "ATOMIC_GROUP":
            some = written(arg)
        else:
            some = [""]  # places
        every = [a + b for a, b in product(every, dict.fromkeys(some))]
    return every


def sign(arg) -> str:
    """A character of a class; of one that is stated by what it is not, any that fits."""
    kinds = {"CATEGORY_DIGIT": "1", "CATEGORY_SPACE": " ", "CATEGORY_WORD": "k", "CATEGORY_NOT_WORD": " ", "CATEGORY_NOT_SPACE": "k"}
    if str(arg[0][0]) == "NEGATE":
        return "k"
    op, value = arg[0]
    return chr(value) if str(op) == "LITERAL" else chr(value[0]) if str(op) == "RANGE" else kinds[str(value)]


def samples(pattern) -> list[str]:
    plain = re.sub(r"\\p\{L\}", "k", pattern.pattern).replace("\\p{M}", "k").replace("\\p{N}", "1")
    found = [x for x in dict.fromkeys(written(P.parse(plain))) if pattern.search(x)]
    assert len(found) > 20
    return found


def test_every_filler_passes():
    assert [x for x in samples(R.FILLERS) if not R.has_filler(x)] == []


def test_every_message_passes():
    assert [x for x in samples(R.MESSAGES) if not R._holds(R._MESSAGE_FINDER, x)] == []


def test_every_field_and_missing_value_passes():
    assert [x for x in samples(R.FIELDS) if not R._FIELD_SIGN.search(x)] == []
    assert [x for x in samples(R.MISSING) if not any(p in x for p in R._MISSING_PARTS)] == []


@pytest.mark.parametrize("text", [
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.", "ullamco laboris nisi ut aliquip ex ea commodo consequat", "Click to edit", "येथे तुमचा नाव लिहा",
    "ut et in ea", "sed “x” do `y` ut et", "Coming“x”soon", "LOREM İPSUM dolor ſit",
])
def test_filler(text):
    assert R.residue_kind(text) == "filler"


def test_no_filler_in_prose():
    assert not R.has_filler("They do sit in the est wing and do not edit the name of a text in any way, in or out.")
    assert not R.has_filler("The road goes in in in, each time.")  # three of the words, and another that begins like a fourth
