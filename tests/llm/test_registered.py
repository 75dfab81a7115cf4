"""Registered queries: order, columns, and those with SQL against it."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bhashaloom.llm import queries as Q  # noqa: E402
from oracle import connection, rows_of_spark, rows_of_sql  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
FOUND = {
    "p2_found": {"id_a": "bigint", "id_b": "bigint"}, "p4_found": {"keep_id": "bigint", "dup_id": "bigint"}, "p6_found": {"line_id": "bigint"}, "p7_found": {"line_id": "bigint", "lang": "string"},
    "p8_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p9_found": {"doc_id": "bigint", "item_id": "bigint"}, "p10_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, name):
    assert rows_of_spark(Q.queries()[name](spark, FOLDER)) == rows_of_sql(connection(FOLDER), Q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, name):
    got = Q.queries()[name](spark, FOLDER)
    assert got.count() > 0
    if name in FOUND:
        assert dict(got.dtypes) == FOUND[name]


def test_names():
    names = list(Q.queries())
    assert {re.match(r"p(\d+)_", n)[1] for n in names} == {str(n) for n in range(1, 11)}
    assert names.index("p10_method") < names.index("p10_found")


def test_nothing_else_imports_this():
    package = Path(Q.__file__).resolve().parents[1]
    others = [p for p in package.rglob("*.py") if "llm" not in p.relative_to(package).parts]
    assert not [p for p in others if "bhashaloom.llm" in p.read_text() or "import llm" in p.read_text()]
