"""Deeply nested records turned into flat child tables that keep the links to their parents.

A batch of records is held as Arrow buffers. Children come out of the buffers: for typed columns (arrays, maps) the list offsets
give each child its place, for texts (JSON, XML) a structural index over the batch's bytes does; the parent index drives
one vectorised take for each key. No record is parsed by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymesh.functions.columnar import Elements, byte_slices, json_ways, node_elements

CHILD_SCHEMA = "parent_id long, element_id long, child_kind string, child_key string, child_value string"


def open_list(column: pa.ListArray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(parent index, place from 0, value) of every list element; null and empty lists have none."""
    parent, values = pc.list_parent_indices(column), column.flatten()
    count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(count) - count
    return parent, pa.array(np.arange(len(values)) - np.repeat(first, count)), values


def _codes(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """One number per row, the same for the same values."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        out = np.unique(out * np.int64(int(c.max(initial=0)) + 1) + c, return_inverse=True)[1]
    return out


def _children(parents: pa.Array, ids: pa.Array, same: np.ndarray, element: np.ndarray, kind: str, key: pa.Array, value: pa.Array) -> pa.RecordBatch:
    """The children of one kind, each once per element: same numbers the elements, alike for one id in one record."""
    there = pc.and_(key.is_valid(), value.is_valid()).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(there)
    alike = _numbered(same[element[at]], _codes(key.take(pa.array(at))), _codes(value.take(pa.array(at)))) if len(at) else at
    at = at[np.sort(np.unique(alike, return_index=True)[1])]
    of, pick = pa.array(element[at]), pa.array(at)
    cols = [parents.take(of), ids.take(of), pa.array([kind], pa.string()).take(pa.array(np.zeros(len(at), np.int64))), key.take(pick), value.take(pick)]
    return pa.RecordBatch.from_arrays(cols, ["parent_id", "element_id", "child_kind", "child_key", "child_value"])


def child_kernel(decode: Callable[[pa.Array], Elements]):
    """Arrow kernel: rows (parent_id, text[, fallback_id]) to flat children of the elements that decode finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in byte_slices(b, "text"):
                found = decode(part["text"])
                record = pa.array(found.record)
                parents, ids = part["parent_id"].take(record), found.ids
                if "fallback_id" in part.schema.names:
                    ids = pc.coalesce(ids, part["fallback_id"].take(record))
                same = _numbered(found.record, _codes(ids)) if len(ids) else found.record
                yield _children(parents, ids, same, found.ref_element, "nd", pa.array(found.ref_place).cast(pa.string()), found.refs)
                yield _children(parents, ids, same, found.tag_element, "tag", found.tag_keys, found.tag_values)

    return run


def flat_children(df: DataFrame, parent: str, text: str, form: str, fallback: str | None = None) -> DataFrame:
    """Flat children (parent_id, element_id, child_kind, child_key, child_value) of the records in a text column.

    form: "json_ways" or "xml_nodes". child_kind nd: child_key is the place in the element's list, child_value the reference;
    tag: key and value of the element's own tags, decoded, not trimmed. Null values and null keys give no row, empty ones do.
    Null and malformed records give none, however deep the others are nested. An element without a whole number of 64 bits as id
    takes the fallback column, else null. An element given twice in a record gives each child once; repeated records give their
    children again. No shuffle is needed: rows are opened where they are read.
    """
    decode = {"json_ways": json_ways, "xml_nodes": node_elements}[form]
    cols = [F.col(parent).cast("long").alias("parent_id"), F.col(text).alias("text")] + ([F.col(fallback).cast("long").alias("fallback_id")] if fallback else [])
    return df.where(F.col(text).isNotNull()).select(*cols).mapInArrow(child_kernel(decode), CHILD_SCHEMA)


def _typed_kernel(column: str, keys: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b[column]
            if pa.types.is_map(col.type):
                col = pa.ListArray.from_arrays(col.offsets, pa.StructArray.from_arrays([col.keys, col.items], ["key", "value"]), mask=col.is_null()) if col.null_count == 0 or col.offset == 0 else pa.array(col.to_pylist(), pa.list_(pa.struct([("key", col.type.key_type), ("value", col.type.item_type)])))
            at, place, child = open_list(col)
            fields = child.flatten() if pa.types.is_struct(child.type) else [child]
            yield pa.RecordBatch.from_arrays([*(b[k].take(at) for k in keys), place.cast(pa.int32()), *fields], names)

    return run


def open_column(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The child table of an array or map column: keys, place (from 0) and the child's fields.

    An array of structs gives its fields, any other array the field value, a map key and value. A child field named like a
    key is prefixed with the column's name. Null and empty columns give no row; null elements give a row with null fields.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.MapType):
        fields = [("key", kind.keyType), ("value", kind.valueType)]
    elif isinstance(kind.elementType, T.StructType):
        fields = [(f.name, f.dataType) for f in kind.elementType.fields]
    else:
        fields = [("value", kind.elementType)]
    taken = {*keys, "place"}
    fields = [(f"{column}_{n}" if n in taken else n, t) for n, t in fields]
    schema = T.StructType([*(T.StructField(k, df.schema[k].dataType) for k in keys), T.StructField("place", T.IntegerType()), *(T.StructField(n, t) for n, t in fields)])
    return df.select(*keys, column).where(F.size(column) > 0).mapInArrow(_typed_kernel(column, keys, schema.names), schema)
