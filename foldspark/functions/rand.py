"""Deterministic random source: md5 of ``'<seed>|<key>'``.

md5 is evaluated identically by Spark and DuckDB, so every seeded choice in the
library (fold order, hold-out order, SMOTE partners, permutations, candidate
sampling) can be replayed by an SQL oracle.  All expressions are JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def hash_hex(seed, *keys) -> Column:
    """md5 hex of ``seed|k1|k2...`` (keys cast to string)."""
    parts = [_as_col(seed).cast("string")] + [_as_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def uniform_from_hex(hex_col: Column, start: int = 1) -> Column:
    """Uniform double in [0, 1) from 8 hex digits of an md5 string."""
    return F.conv(F.substring(hex_col, start, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def uniform(seed, *keys) -> Column:
    return uniform_from_hex(hash_hex(seed, *keys))


def hash_bucket(hex_col: Column, digits: int = 4) -> Column:
    """Leading hex digits as an int: a monotone coarsening of the hex order."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("int")
