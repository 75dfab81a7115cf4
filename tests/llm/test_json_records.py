"""JSON lines with arrays and objects within are compared as a whole."""

from __future__ import annotations

import pytest

from bhashaloom.llm import format_duplicates as D


def found(spark, lines):
    frame = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    return {(r["keep_id"], r["dup_id"]) for r in D.format_duplicates(frame, "line_id", "line").collect()}


DIFFER = [
    ('{"name": "x", "tags": ["red","blue"]}', '{"name": "x", "tags": ["green"]}'),
    ('{"a":{"b":"c"}}', '{"a":"", "b":"c"}'),
    ('{"a":{"b":"c"},"d":{"e":"f"}}', '{"a":{"e":"f"},"d":{"b":"c"}}'),
    ('{"a":[{"b":1,"c":2},{"b":3,"c":4}]}', '{"a":[{"b":1,"c":4},{"b":3,"c":2}]}'),
    ('{"a": [true, 1, null], "b": 1}', '{"a": [false, 1, null], "b": 1}'),
    ('{"a": 1, "b": [1, 2.50]}', '{"a": 1, "b": [1, 2.51]}'),
    ('{"a": "b", c: 5}', '{"a": "b", c: 6}'),
    ('{"a": "b" "c"}', '{"a": "b" "d"}'),
    ('{"a": [1, {"b": 2}, "x"]}', '{"a": [1, {"b": 2}, "y"]}'),
    ('{"a": {"a": 1}}', '{"aa": 1}'),
    ('{"a": ' + "[" * 3000 + "1" + "]" * 3000 + "}", '{"a": ' + "[" * 3000 + "2" + "]" * 3000 + "}"),
]
SAME = [
    ('[{"a":1,"b":2},{"c":3}]', '[{"b":2,"a":1},{"c":3}]'),
    ('{"a":["\\ud800"]}', '{"a": ["\\ud800"]}'),
    ('{"name": "x", "tags": ["red","blue"]}', '{ "TAGS":[ "Red", "Blue" ], "name":"X" }'),
    ('{"a":{"b":"c","d":"e"},"f":1}', '{"f":1,"a":{"d":"e","b":"c"}}'),
    ('{"a":[{"b":1,"c":2},{"b":3}]}', '{"a":[{"c":2,"b":1},{"b":3}]}'),
    ('{"name": "x", "tags": ["red","blue"]}', "name: X | tags: red, blue"),
]


def test_records(spark):
    lines = [x for pair in DIFFER for x in pair]
    assert found(spark, lines) == set()
    for pair in SAME:
        assert found(spark, pair) == {(0, 1)}


@pytest.mark.parametrize("line", [pair[i] for pair in DIFFER for i in (0, 1)])
def test_every_letter_is_in_some_pair(spark, line):
    pairs = D.with_fields(spark.createDataFrame([(line,)], "line string"), "line").first()["pairs"]
    assert all(c in "".join(pairs) for c in line.lower() if c.isalnum())


def test_escapes_and_repeated_fields(spark):
    lines = [
        '{"name": "\\u0905\\u092c", "note": "one\\ntwo"}', '{"note": "one two", "name": "अब"}', '{"a": "x", "b": "y", "a": "x"}', '{"b": "y", "a": "x", "a": "x"}',
        '{"a": "x", "b": "y", "b": "y"}',
    ]
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    assert sorted(map(tuple, D.format_duplicates(frame, "id", "line").collect())) == [(0, 1), (2, 3)]
    assert sorted(map(tuple, D.collapsed(frame, "id", "line").collect())) == [(0, 2), (2, 2), (4, 1)]
