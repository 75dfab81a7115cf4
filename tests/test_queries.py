"""Every core query against its SQL, and the entry's contract."""

from __future__ import annotations

import pytest

import __spark_entry__
from bhashaloom.plans import catalog
from oracle import connection, rows_of_spark, rows_of_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, db, name):
    assert rows_of_spark(catalog.queries()[name](spark, FOLDER)) == rows_of_sql(db, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
