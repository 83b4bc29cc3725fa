"""Road polylines for the legs of routes, with fallbacks.

Paths are ARRAY<STRUCT<lon, lat>>. Candidate graphs are ranked; each leg takes the first candidate whose path fits its ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions import geo

TOLERANCE_M = 250.0
LINE = "array<struct<lon: double, lat: double>>"


def required_legs(legs: DataFrame) -> DataFrame:
    """Distinct (city, from_node, to_node) over all routes."""
    return legs.select("city", "from_node", "to_node").distinct()


def polylines(paths: DataFrame, spots: DataFrame) -> DataFrame:
    """paths (city, source, target, path of node ids) with line, their points in order; spots: city, node_id, lon, lat.

    A path with a node that has no spot has no line.
    """
    steps = paths.where("path IS NOT NULL").select("city", "source", "target", F.size("path").alias("n"), F.posexplode("path").alias("at", "node_id"))
    placed = steps.join(spots, ["city", "node_id"])
    line = placed.groupBy("city", "source", "target", "n").agg(F.array_sort(F.collect_list(F.struct("at", "lon", "lat"))).alias("p"))
    return line.where(F.size("p") == F.col("n")).select("city", "source", "target", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("line"))


def fits(line: Column, a: Column, b: Column) -> Column:
    """The line has two points or more and both its ends lie within the tolerance of a and b."""
    first, last = F.element_at(line, 1), F.element_at(line, -1)
    near = lambda p, q: geo.flat_metres(p["lon"], p["lat"], q["lon"], q["lat"]) <= TOLERANCE_M
    return (F.size(line) >= 2) & near(first, a) & near(last, b)


def materialized(legs: DataFrame, candidates: DataFrame, spots: DataFrame) -> DataFrame:
    """(city, from_node, to_node, line, mode) for every leg; mode road, reversed or straight.

    candidates: city, from_node, to_node, rank, line; spots: city, node, lon, lat of the instance's nodes. The lowest rank that fits
    wins; else the turned line of the opposite leg; else the straight line. A leg whose node has no spot is an error when computed.
    """
    s = spots.select("city", "node", F.struct("lon", "lat").alias("p"))
    ends = lambda df: df.join(s.select("city", F.col("node").alias("from_node"), F.col("p").alias("a")), ["city", "from_node"], "left").join(s.select("city", F.col("node").alias("to_node"), F.col("p").alias("b")), ["city", "to_node"], "left")
    good = ends(candidates).where(fits(F.col("line"), F.col("a"), F.col("b"))).groupBy("city", "from_node", "to_node").agg(F.min_by("line", "rank").alias("line"))
    turned = good.select("city", F.col("from_node").alias("to_node"), F.col("to_node").alias("from_node"), F.reverse("line").alias("back"))
    known = ends(legs)
    whole = known.withColumn("straight", F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a leg's node has no coordinates"))).otherwise(F.array("a", "b")))
    all_ = whole.join(good, ["city", "from_node", "to_node"], "left").join(turned, ["city", "from_node", "to_node"], "left")
    mode = F.when(F.col("line").isNotNull(), "road").when(F.col("back").isNotNull(), "reversed").otherwise("straight")
    return all_.select("city", "from_node", "to_node", F.coalesce("line", "back", "straight").alias("line"), mode.alias("mode"))


def cached_first(cached: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with the known lines (city, from_node, to_node, line) ranked before all others."""
    return candidates.unionByName(cached.select("city", "from_node", "to_node", F.lit(-1).alias("rank"), "line"))


def stitched(lines: Column) -> Column:
    """Lines laid end to end, every line but the first without its first point."""
    return F.flatten(F.transform(lines, lambda s, i: F.when(i == 0, s).otherwise(F.slice(s, F.lit(2), F.greatest(F.lit(0), F.size(s) - 1)))))


def route_lines(legs: DataFrame, lines: DataFrame) -> DataFrame:
    """(city, run, route_idx, line, mode) per route: cached_road if all its legs follow roads, straight_line if none does, else mixed."""
    joined = legs.join(lines, ["city", "from_node", "to_node"])
    per = joined.groupBy("city", "run", "route_idx").agg(F.array_sort(F.collect_list(F.struct("leg", "line"))).alias("parts"), F.max((F.col("mode") == "straight").cast("int")).alias("s"), F.max((F.col("mode") != "straight").cast("int")).alias("r"))
    mode = F.when(F.col("s") == 0, "cached_road").when(F.col("r") == 0, "straight_line").otherwise("mixed")
    return per.select("city", "run", "route_idx", stitched(F.col("parts.line")).alias("line"), mode.alias("mode"))


def feature_collection(points: DataFrame, by: list[str], properties: list[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(by..., geojson): the points of each group as a GeoJSON text, in the order of their properties."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    feature = F.struct(F.struct(*properties).alias("o"), F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")).alias("f"))
    per = points.groupBy(*by).agg(F.array_sort(F.collect_list(feature)).alias("x"))
    return per.select(*by, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("x.f").alias("features"))).alias("geojson"))


def instance_features(nodes: DataFrame, depot_id: int = 1) -> DataFrame:
    """(city, geojson): the nodes (city, instance_node_id, lon, lat, demand, source_tag) of each instance as GeoJSON in the order of their ids.

    Each has model_node_id, its place from 0, and its role. Null demand is 0 and null source_tag unknown. An instance's nodes are one text.
    """
    order = Window.partitionBy("city").orderBy("instance_node_id")
    role = F.when(F.col("instance_node_id") == depot_id, "depot").otherwise("customer")
    rows = nodes.select("city", "instance_node_id", (F.row_number().over(order) - 1).alias("model_node_id"), role.alias("role"), F.coalesce(F.col("demand").cast("long"), F.lit(0)).alias("demand"), F.coalesce("source_tag", F.lit("unknown")).alias("source_tag"), "lon", "lat")
    return feature_collection(rows, ["city"], ["instance_node_id", "model_node_id", "role", "demand", "source_tag"])
