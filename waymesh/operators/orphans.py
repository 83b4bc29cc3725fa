"""References to records that do not exist, were deleted or came later than the reference.

Distinct non-null foreign keys are anti-joined with the parent keys; keys whose parent is deleted or may be late are found by
a semi-selective join of the same two (reused) exchanges; the suspicious keys, few, are joined back to the references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for a missing time where the earliest is meant.
_EPOCH = "TIMESTAMP_NTZ'0001-01-01 00:00:00'"


def parent_states(parents: DataFrame, key: str, time: str, visible: str) -> DataFrame:
    """One row per non-null parent key: when it was first seen and whether its latest row deletes it.

    A row deletes if visible is false (null does not). Between rows of one time a row that keeps the record wins. Rows
    without time are the earliest. All four aggregates are primitive, so they stay in the hash aggregate and combine map-side.
    """
    at = F.coalesce(F.col(time), F.expr(_EPOCH))
    gone = F.col(visible).eqNullSafe(False)
    return (
        parents.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("parent_id"))
        .agg(F.min(time).alias("first_seen"), F.max(F.when(gone, at)).alias("_gone"), F.max(F.when(~gone, at)).alias("_kept"))
        .select("parent_id", "first_seen", (F.col("_gone").isNotNull() & (F.col("_kept").isNull() | (F.col("_gone") > F.col("_kept")))).alias("deleted"))
    )


def references(rows: DataFrame) -> DataFrame:
    """Distinct (ref_table, owner_id, owner_time, ref_id) of rows (ref_table, owner_id, at, refs ARRAY).

    owner_time is the earliest time of all rows of the owner, also those without references; null if none has one. Null
    elements, null arrays and empty arrays give no reference. Rows are matched with their owner's time before the arrays are
    opened, so the shuffle carries the compact arrays, and the distinct afterwards needs no further exchange.
    """
    times = rows.groupBy("ref_table", "owner_id").agg(F.min("at").alias("owner_time"))
    rows = rows.where(F.size("refs") > 0).select("ref_table", "owner_id", "refs")
    same = (F.col("r.ref_table") == F.col("t.ref_table")) & F.col("r.owner_id").eqNullSafe(F.col("t.owner_id"))
    opened = rows.alias("r").join(times.alias("t"), same).select("r.ref_table", "r.owner_id", "t.owner_time", F.explode("r.refs").alias("ref_id"))
    return opened.where(F.col("ref_id").isNotNull()).distinct()


def orphan_references(refs: DataFrame, states: DataFrame) -> DataFrame:
    """refs (ref_table, owner_id, owner_time, ref_id) whose parent is missing, deleted or late, with ref_status.

    missing: no parent has the key; else deleted: its latest row deletes it; else late: it was first seen after the owner's
    time (never if either time is null). Without parents every reference is missing.
    """
    keys = refs.groupBy("ref_id").agg(F.min("owner_time").alias("first_need"))
    missing = keys.join(states.select(F.col("parent_id").alias("ref_id")), "ref_id", "left_anti").select("ref_id", F.lit(None).cast("timestamp_ntz").alias("first_seen"), F.lit("missing").alias("state"))
    known = keys.join(states, keys.ref_id == states.parent_id).where(F.col("deleted") | (F.col("first_seen") > F.col("first_need")))
    known = known.select("ref_id", "first_seen", F.when(F.col("deleted"), "deleted").otherwise("late").alias("state"))
    back = refs.join(missing.unionByName(known), "ref_id")
    back = back.where((F.col("state") != "late") | (F.col("first_seen") > F.col("owner_time")))
    return back.select("ref_table", "owner_id", "owner_time", "ref_id", F.col("state").alias("ref_status"))


def local_orphans(rows: DataFrame, ref_table: str, refs: str, keys: str) -> DataFrame:
    """References of rows (owner_id, at, <refs> ARRAY, <keys> ARRAY) to a key that no row of the same owner holds.

    Both key lists are made distinct per owner before the anti-join on (owner_id, key).
    """
    mine = references(rows.select(F.lit(ref_table).alias("ref_table"), "owner_id", "at", F.col(refs).alias("refs")))
    held = rows.select("owner_id", F.explode(keys).alias("key")).where(F.col("key").isNotNull()).distinct()
    on = mine.owner_id.eqNullSafe(held.owner_id) & (mine.ref_id == held.key)
    return mine.join(held, on, "left_anti").select("ref_table", "owner_id", "owner_time", "ref_id", F.lit("missing").alias("ref_status"))


def by_month(found: DataFrame) -> DataFrame:
    """The result with ref_month (yyyy-MM of the owner's time, null if it has none)."""
    return found.select("ref_table", F.date_format("owner_time", "yyyy-MM").alias("ref_month"), "owner_id", "ref_id", "ref_status")


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts of orphan references and of owners with any, per table, month and status."""
    return found.groupBy("ref_table", "ref_month", "ref_status").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("owner_id").alias("n_owners"))
