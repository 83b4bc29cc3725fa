"""Map extracts in XML: reading, bounds, checks, merging and writing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TAGS = "tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"
NODE = f"_id BIGINT, _lat DOUBLE, _lon DOUBLE, _visible STRING, {_TAGS}"
WAY = f"_id BIGINT, _visible STRING, nd ARRAY<STRUCT<_ref: BIGINT>>, {_TAGS}"


def _read(spark: SparkSession, path: str | list[str], tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path if isinstance(path, str) else ",".join(path))


def _tags():
    """Tags as a map; of a key given twice the last counts."""
    t = F.coalesce("tag", F.array().cast("array<struct<_k: string, _v: string>>"))
    last = F.filter(t, lambda x, i: x["_k"].isNotNull() & ~F.exists(F.slice(t, i + 2, F.size(t)), lambda y: y["_k"] == x["_k"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["_k"], x["_v"])))


def read_nodes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, lat, lon, tags, visible) of all node elements; XML files are split, so one extract is read by many tasks."""
    return _read(spark, path, "node", NODE).select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _tags().alias("tags"), F.col("_visible").alias("visible"))


def read_ways(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, nodes, tags, visible) of all way elements; a way without nodes has an empty list."""
    refs = F.coalesce(F.col("nd._ref"), F.array().cast("array<bigint>"))
    return _read(spark, path, "way", WAY).select(F.col("_id").alias("id"), refs.alias("nodes"), _tags().alias("tags"), F.col("_visible").alias("visible"))


def read_bounds(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(min_lat, min_lon, max_lat, max_lon): the bounds element (of several the least), else the box of the nodes; the source is never changed."""
    said = _read(spark, path, "bounds", "_minlat DOUBLE, _minlon DOUBLE, _maxlat DOUBLE, _maxlon DOUBLE").agg(F.min(F.struct("_minlat", "_minlon", "_maxlat", "_maxlon")).alias("x")).select(*(F.col(f"x.{c}").alias(n) for c, n in zip(("_minlat", "_minlon", "_maxlat", "_maxlon"), "abcd")))
    seen = read_nodes(spark, path).agg(F.min("lat").alias("p"), F.min("lon").alias("q"), F.max("lat").alias("r"), F.max("lon").alias("s"))
    return said.join(seen).select(*(F.coalesce(x, y).alias(n) for x, y, n in zip("abcd", "pqrs", ("min_lat", "min_lon", "max_lat", "max_lon"))))


def pois_of(nodes: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """(id, lat, lon, category) of nodes whose amenity is one of the categories."""
    return nodes.where(F.col("tags")["amenity"].isin(*categories)).select("id", "lat", "lon", F.col("tags")["amenity"].alias("category"))


def deduplicated(elements: DataFrame, key: str, order: str, keep: str) -> DataFrame:
    """One row per key of elements that came in several deliveries: keep the last (nodes) or the first (ways) by order."""
    by = F.desc_nulls_last(order) if keep == "last" else F.asc_nulls_first(order)
    return elements.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(by))).where("_k = 1").drop("_k")


def merged(base: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """base with incoming rows replacing or joining those of their key, and added: whether the key is new."""
    b, i = base.withColumn("_b", F.lit(True)).alias("b"), incoming.withColumn("_i", F.lit(True)).alias("i")
    pick = lambda c: F.when(F.col("i._i"), F.col(f"i.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return b.join(i, F.col(f"b.{key}") == F.col(f"i.{key}"), "full").select(*(pick(c) for c in base.columns), F.col("b._b").isNull().alias("added"))


def extract_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row: bounds, nodes, ways and remarks of an extract, and whether it is valid (bounds, both kinds, no remark)."""
    one = lambda tag: _read(spark, path, tag, "_id BIGINT, _minlat DOUBLE, _VALUE STRING").agg(F.count(F.lit(1)).alias(tag))
    all_ = one("bounds").join(one("node")).join(one("way")).join(one("remark"))
    return all_.withColumn("valid", (F.col("bounds") > 0) & (F.col("node") > 0) & (F.col("way") > 0) & (F.col("remark") == 0))


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def to_xml(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(kind, id, value): the elements as XML lines, to be written in the order of kind and id."""
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(F.lit('<tag k="'), _escaped(e["key"]), F.lit('" v="'), _escaped(e["value"]), F.lit('"/>'))), "")
    n = nodes.select(F.lit(0).alias("kind"), "id", F.format_string('<node id="%d" lat="%s" lon="%s">%s</node>', "id", F.col("lat").cast("string"), F.col("lon").cast("string"), F.coalesce(tags, F.lit(""))).alias("value"))
    refs = F.array_join(F.transform("nodes", lambda r: F.concat(F.lit('<nd ref="'), r.cast("string"), F.lit('"/>'))), "")
    w = ways.select(F.lit(1).alias("kind"), "id", F.format_string('<way id="%d">%s%s</way>', "id", refs, F.coalesce(tags, F.lit(""))).alias("value"))
    return n.unionByName(w)


def bounds_line(bounds: DataFrame) -> DataFrame:
    """(kind, id, value) of the bounds element of one row (min_lat, min_lon, max_lat, max_lon); none if a value is null."""
    text = F.format_string('<bounds minlat="%s" minlon="%s" maxlat="%s" maxlon="%s"/>', *(F.col(c).cast("string") for c in ("min_lat", "min_lon", "max_lat", "max_lon")))
    return bounds.dropna().select(F.lit(-1).alias("kind"), F.lit(1).cast("long").alias("id"), text.alias("value"))


def write_xml(nodes: DataFrame, ways: DataFrame, path: str, bounds: DataFrame | None = None) -> None:
    """Publish an extract: text files that together, in name order, are bounds, nodes and ways, each sorted by id, inside <osm>.

    bounds: one row (min_lat, min_lon, max_lat, max_lon), else the box of the nodes. All or nothing: the files are written beside the
    path, read back and checked (extract_counts), and only then take the place of what is there. An extract that is not valid,
    for example without ways, raises ValueError and changes nothing.
    """
    spark = nodes.sparkSession
    if bounds is None:
        bounds = nodes.agg(F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"))
    frame = spark.createDataFrame([(-1, 0, '<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6">'), (2, 0, "</osm>")], "kind int, id bigint, value string")
    lines = to_xml(nodes, ways).unionByName(bounds_line(bounds)).unionByName(frame)
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    files = spark._jvm.org.apache.hadoop.fs.Path(beside).getFileSystem(spark._jsc.hadoopConfiguration())
    at = spark._jvm.org.apache.hadoop.fs.Path
    try:
        lines.repartitionByRange("kind", "id").sortWithinPartitions("kind", "id").select("value").write.mode("error").text(beside)
        said = extract_counts(spark, beside).first()
        if not said.valid:
            raise ValueError(f"not a valid extract: {said.asDict()}")
        files.delete(at(path), True)
        if not files.rename(at(beside), at(path)):
            raise OSError(f"cannot publish {path}")
    finally:
        files.delete(at(beside), True)
