"""Differences between two copies of a dataset, field by field.

The sides are tagged and united, the rows are grouped once by key, each group keeps one struct per side (its latest row),
and a generated higher-order SQL expression turns the two structs into the list of findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FieldRule:
    """A compared field. With a tolerance, two numbers differ if they are more than that apart; without, if not equal."""

    name: str
    tolerance: float | None = None


def _differs(rule: FieldRule) -> str:
    a, b = f"a.`{rule.name}`", f"b.`{rule.name}`"
    if rule.tolerance is None:
        return f"NOT ({a} <=> {b})"
    return f"CASE WHEN {a} <=> {b} THEN false WHEN {a} IS NULL OR {b} IS NULL THEN true ELSE abs({a} - {b}) > {rule.tolerance!r}D END"


def latest_per_side(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], recency: str) -> DataFrame:
    """One row per key with the structs a and b: the row of either side with the greatest recency.

    Null recency is the earliest; ties go to the greatest values of the fields, in their order. Null keys equal each other.
    Only keys, fields and recency are read, so extra columns never clash. The greatest struct is a map-side combined
    aggregate: a key holding a third of all rows is one row per task before the shuffle.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*keys, F.lit(tag).alias("_side"), F.struct(F.col(recency).alias("_at"), *fields).alias("_row"))

    both = side(left, "a").unionByName(side(right, "b"))
    pick = lambda tag: F.max(F.when(F.col("_side") == tag, F.col("_row"))).alias(tag)
    return both.groupBy(*keys).agg(pick("a"), pick("b"))


def compare_copies(left: DataFrame, right: DataFrame, keys: list[str], rules: list[FieldRule], recency: str) -> DataFrame:
    """Rows (keys..., finding, left_value, right_value): finding only_a, only_b, or the name of a field that differs.

    A field differs if exactly one side is null, or both are present and unequal (beyond the tolerance). NaN equals NaN.
    A key on one side only gives one row, whatever its fields. Empty sides give only_a or only_b for every key.
    """
    sided = latest_per_side(left, right, keys, [r.name for r in rules], recency)
    text = lambda x: f"CAST({x} AS STRING)"
    items = ["named_struct('finding', 'only_a', 'hit', b IS NULL, 'l', CAST(NULL AS STRING), 'r', CAST(NULL AS STRING))", "named_struct('finding', 'only_b', 'hit', a IS NULL, 'l', CAST(NULL AS STRING), 'r', CAST(NULL AS STRING))"]
    for r in rules:
        items.append(f"named_struct('finding', '{r.name}', 'hit', a IS NOT NULL AND b IS NOT NULL AND {_differs(r)}, 'l', {text(f'a.`{r.name}`')}, 'r', {text(f'b.`{r.name}`')})")
    found = sided.select(*keys, F.explode(F.expr(f"filter(array({', '.join(items)}), x -> x.hit)")).alias("x"))
    return found.select(*keys, F.col("x.finding").alias("finding"), F.col("x.l").alias("left_value"), F.col("x.r").alias("right_value"))


def difference_report(left: DataFrame, right: DataFrame, keys: list[str], rules: list[FieldRule], recency: str, by: list[str]) -> DataFrame:
    """How many keys each finding has within each group of the key columns named in by."""
    return compare_copies(left, right, keys, rules, recency).groupBy(*by, "finding").agg(F.count(F.lit(1)).alias("n"))
