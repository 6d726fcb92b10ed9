"""Lenient text-to-number cast (B1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the accepted numeric text.  Spark's own cast also reads '12d',
# '12f' and 'NaN'; text outside this pattern becomes NULL instead.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|Infinity)\s*$"


def to_number(c) -> Column:
    """text -> double; unparseable, blank and NULL -> NULL."""
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    return F.when(s.rlike(NUMBER_PATTERN), F.trim(s).try_cast("double"))
