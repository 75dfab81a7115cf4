"""Compares a query with its SQL, as rows without order."""

from __future__ import annotations

import math
import os

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    out = duckdb.connect()
    for file in os.listdir(folder):
        out.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{file}')")
    return out


def plain(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return repr(value)


def rows_of_spark(frame) -> tuple[list[str], list[tuple[str, ...]]]:
    names = sorted(frame.columns)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())


def rows_of_sql(db, sql: str) -> tuple[list[str], list[tuple[str, ...]]]:
    found = db.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(c) for c in names]
    return names, sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
