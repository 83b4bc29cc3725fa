"""The best representative of each group of duplicate records, as a whole and field by field.

Records are ranked with window ordering; the rank filter is pushed below the shuffle (a group limit), so a group with a third
of all rows reaches the window with a few rows per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.columnar import byte_slices, numbers, taken, whole_numbers, xml_nodes
from waymesh.session import broadcast_if_small

COORD = "coord"


def best_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group of equal keys in the given order, whose last columns should make it unique.

    Rows with a null key form one group. Give the order as completeness, trust, recency and a tie-break. Extra columns stay.
    """
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") == 1).drop("_rank")


def completeness(*columns: str) -> Column:
    """How many of the columns are present."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def supplied(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array, pa.Array]:
    """(id of each text, then record, field and value of each field) that the first node of each XML text supplies.

    Fields are the usable coordinates and each tag whose value isn't blank; of a key given twice the last such value counts.
    """
    x = xml_nodes(texts, "node", ("id", "lat", "lon"))
    records, first = np.unique(x.record, return_index=True)
    pick = pa.array(first)
    place = np.full(len(texts), -1)
    place[records] = np.arange(len(records))
    ids = taken(whole_numbers(x.attributes["id"].take(pick)), place)
    lat, lon = x.attributes["lat"].take(pick), x.attributes["lon"].take(pick)
    y, z = numbers(lat).to_numpy(zero_copy_only=False), numbers(lon).to_numpy(zero_copy_only=False)
    spot = np.flatnonzero((np.abs(y) <= 90) & (np.abs(z) <= 180) & ((y != 0) | (z != 0)))
    at = pa.array(spot)
    coord = pc.binary_join_element_wise(pc.ascii_trim_whitespace(lat.take(at)), pc.ascii_trim_whitespace(lon.take(at)), " ")
    of = np.full(len(x.record) + 1, -1)
    of[first] = records
    tag = np.flatnonzero((of[x.tag_element] >= 0) & pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(x.tag_values)), 0).to_numpy(zero_copy_only=False))
    key = x.tag_keys.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[tag]
    both = x.tag_element[tag] * np.int64(key.max(initial=0) + 1) + key
    tag = tag[len(tag) - 1 - np.unique(both[::-1], return_index=True)[1]]
    fields = pa.concat_arrays([pa.array([COORD] * len(spot), pa.string()), x.tag_keys.take(pa.array(tag))])
    return ids, np.concatenate([records[spot], of[x.tag_element[tag]]]).astype(np.int64), fields, pa.concat_arrays([coord, x.tag_values.take(pa.array(tag))])


def _supply_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow kernel: records to one row per supplied field, and one with a null field per record."""
    for b in batches:
        for part in byte_slices(b, "xml"):
            said, record, fields, values = supplied(part["xml"])
            ids, of = pc.coalesce(part["id"], said), pa.array(np.concatenate([np.arange(part.num_rows), record]))
            none = pa.nulls(part.num_rows, pa.string())
            cols = [ids.take(of), *(part[c].take(of) for c in ("rec_id", "trust", "fetched_at")), pa.concat_arrays([none, fields]), pa.concat_arrays([none, values])]
            yield pa.RecordBatch.from_arrays(cols, ["id", "rec_id", "trust", "fetched_at", "field", "value"])


def merge_fields(records: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, field, rec_id, value): the row that supplies each field of each id with two or more rows.

    records: rec_id, id, xml, feed, fetched_at; ranks: feed, trust. A null id is taken from the xml, a row that has neither
    belongs to no group; an id beyond 64 bits is none. Null or malformed xml supplies nothing but counts as a row. A field is supplied by the row with the
    highest trust (0 if unranked or null), then the latest fetched_at (null is earliest), then the largest rec_id. A feed
    ranked several times has its highest trust. A tag called coord would be a field of that name as well.

    Each record also gives a marker (field null). At most two rows per (id, field) pass the limit that runs before the
    shuffle: the winner, and for markers a second one, which shows that the id has several rows.
    """
    trust = ranks.where(F.col("feed").isNotNull()).groupBy("feed").agg(F.max("trust").alias("trust"))
    rows = records.select("rec_id", "id", "xml", "feed", "fetched_at").join(broadcast_if_small(trust), "feed", "left")
    rows = rows.select("id", "rec_id", "xml", F.coalesce("trust", F.lit(0)).cast("int").alias("trust"), "fetched_at")
    opened = rows.mapInArrow(_supply_kernel, "id long, rec_id long, trust int, fetched_at timestamp_ntz, field string, value string").where(F.col("id").isNotNull())
    order = [F.desc("trust"), F.desc_nulls_last("fetched_at"), F.desc("rec_id")]
    top = opened.withColumn("_rank", F.row_number().over(Window.partitionBy("id", "field").orderBy(*order))).where(F.col("_rank") <= 2)
    several = F.max(F.col("field").isNull() & (F.col("_rank") == 2)).over(Window.partitionBy("id"))
    kept = top.where(F.col("field").isNull() | (F.col("_rank") == 1)).withColumn("_several", several)
    return kept.where(F.col("_several") & F.col("field").isNotNull()).select("id", "field", "rec_id", "value")


def survivors(merged: DataFrame) -> DataFrame:
    """One node per id of merge_fields(): lat, lon (null if no row supplies them), tags and the supplying row of each field."""
    tags = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field") != COORD, F.struct("field", "value")))))
    source = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "rec_id"))))
    spot = F.split(F.max(F.when(F.col("field") == COORD, F.col("value"))), " ")
    return merged.groupBy("id").agg(spot[0].cast("double").alias("lat"), spot[1].cast("double").alias("lon"), tags.alias("tags"), source.alias("sources"))
