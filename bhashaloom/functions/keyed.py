"""Pseudo-random values from keys, the same on every run and in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, key: Column) -> Column:
    """A hexadecimal digest to sort by, which shuffles."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def integer(seed: int, key: Column) -> Column:
    """An integer from 0 to under 2**32."""
    return F.conv(F.substring(order_key(seed, key), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int, key: Column) -> Column:
    """A number from 0 to under 1."""
    return integer(seed, key) / F.lit(4294967296.0)
