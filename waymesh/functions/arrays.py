"""Array helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_up(first: Column | int, last: Column | int) -> Column:
    """The whole numbers first..last as an array; empty, not descending, if last is less."""
    a, z = (x if isinstance(x, Column) else F.lit(x) for x in (first, last))
    return F.filter(F.sequence(a, F.greatest(a, z)), lambda x: x <= z)


def neighbours(items: Column, first: str, second: str) -> Column:
    """STRUCT(first, second) of each item and the next one."""
    return F.transform(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), lambda b, k: F.struct(F.get(items, k).alias(first), b.alias(second)))
