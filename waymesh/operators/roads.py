"""Road graphs of many cities at once, built from map records.

Every step is keyed by city, so one plan builds all graphs. A way's nodes travel as one array; joins on nodes and regrouping by
way are the only shuffles, and higher-order functions do the work along a way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions import geo
from waymesh.functions.arrays import count_up, neighbours
from waymesh.functions.scalars import FREE_KMH, ROAD_CLASSES, lookup
from waymesh.operators.graph import numbered_by

PATH = "array<struct<seq: int, node_id: bigint, x: double, y: double, z: double>>"


def latest_nodes(rows: DataFrame) -> DataFrame:
    """(city, node_id, lat, lon): the last delivered row of each id, if it is visible and usable. Null time is earliest."""
    last = F.max(F.struct("fetched_at", "lat", "lon", "city", "visible")).alias("n")
    one = rows.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("node_id")).agg(last).select("node_id", "n.*")
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0)) & ~F.col("visible").eqNullSafe(False)
    return one.where(ok).select("city", "node_id", "lat", "lon")


def first_ways(rows: DataFrame) -> DataFrame:
    """(city, way_id, nodes, highway, oneway, junction, visible): the first delivered row of each way that has nodes."""
    tag = lambda k: F.element_at("tags", k).alias(k)
    flat = rows.where(F.col("id").isNotNull() & (F.size("nodes") > 0)).select(F.col("id").alias("way_id"), F.struct("fetched_at", "nodes", tag("highway"), tag("oneway"), tag("junction"), tag("visible"), "city").alias("w"))
    return flat.groupBy("way_id").agg(F.min("w").alias("w")).select("w.city", "way_id", "w.nodes", "w.highway", "w.oneway", "w.junction", "w.visible")


def is_road() -> Column:
    """The way is a visible road of a known class."""
    return F.col("highway").isin(*ROAD_CLASSES) & ~F.coalesce(F.col("visible"), F.lit("")).eqNullSafe("false")


def is_one_way() -> Column:
    """The tag says so, or says nothing and the road is a motorway or a roundabout."""
    said = F.coalesce(F.col("oneway"), F.lit(""))
    implied = F.coalesce(F.col("highway").isin("motorway", "motorway_link") | (F.col("junction") == "roundabout"), F.lit(False))
    return F.when(said.isin("false", "no", "0"), False).when(said.isin("-1", "true", "yes", "1"), True).otherwise(implied)


def roadways(ways: DataFrame) -> DataFrame:
    """The ways that are roads, with class, one_way and backward (one way against the node order)."""
    return ways.where(is_road()).select("city", "way_id", "nodes", lookup(ROAD_CLASSES, F.col("highway")).alias("class"), is_one_way().alias("one_way"), F.col("oneway").eqNullSafe("-1").alias("backward"))


def paths(roads: DataFrame, nodes: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Roads with the path of their known nodes in order; null and unknown nodes, and those of removed (city, node_id), drop out."""
    spots = nodes.select("node_id", *(c.alias(n) for c, n in zip(geo.ecef(F.col("lat"), F.col("lon")), "xyz")))
    steps = roads.select("city", "way_id", "class", "one_way", "backward", F.posexplode("nodes").alias("seq", "node_id")).where("node_id IS NOT NULL").join(spots, "node_id")
    if removed is not None:
        steps = steps.join(removed, ["city", "node_id"], "left_anti")
    path = F.array_sort(F.collect_list(F.struct("seq", "node_id", "x", "y", "z"))).alias("path")
    return steps.groupBy("city", "way_id", "class", "one_way", "backward").agg(path)


def without(pathed: DataFrame, removed: DataFrame) -> DataFrame:
    """paths() without the removed nodes (city, node_id), whose neighbours become adjacent; a road that loses all its nodes drops out."""
    keys = ["city", "way_id", "class", "one_way", "backward"]
    steps = pathed.select(*keys, F.explode("path").alias("p")).select("*", F.col("p.node_id").alias("node_id"))
    return steps.join(removed, ["city", "node_id"], "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("path"))


def _length(a: Column, b: Column) -> Column:
    return geo.span3((a["x"], a["y"], a["z"]), (b["x"], b["y"], b["z"]))


def _both_ways(u: str, v: str) -> Column:
    """The directed ends of a stretch: as the nodes run unless backward, against them if backward or not one way."""
    there = F.when(~F.col("backward"), F.array(F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.lit(0).alias("dir")))).otherwise(F.array().cast("array<struct<u: bigint, v: bigint, dir: int>>"))
    back = F.when(F.col("backward") | ~F.col("one_way"), F.array(F.struct(F.col(v).alias("u"), F.col(u).alias("v"), F.lit(1).alias("dir")))).otherwise(F.array().cast("array<struct<u: bigint, v: bigint, dir: int>>"))
    return F.concat(there, back)


def full_edges(pathed: DataFrame) -> DataFrame:
    """(city, u, v, class, length_m, first_pos): an edge per directed neighbour pair; the last way that has it gives the class."""
    n = F.size("path")
    pair = neighbours(F.col("path"), "a", "b")
    opened = pathed.where(n > 1).select("city", "way_id", "class", "one_way", "backward", F.posexplode(pair).alias("j", "p"))
    flat = opened.select("city", "way_id", "class", "one_way", "backward", "j", F.col("p.a.node_id").alias("a"), F.col("p.b.node_id").alias("b"), _length(F.col("p.a"), F.col("p.b")).alias("length_m"))
    edges = flat.select("city", "way_id", "class", "j", "length_m", F.explode(_both_ways("a", "b")).alias("e"))
    place = F.struct("way_id", "j", F.col("e.dir").alias("dir"))
    return edges.groupBy("city", F.col("e.u").alias("u"), F.col("e.v").alias("v")).agg(F.max_by("class", place).alias("class"), F.min("length_m").alias("length_m"), F.min(place).alias("first_pos"))


def node_roles(pathed: DataFrame) -> DataFrame:
    """(city, node_id, crossing) of every node on a road: whether it ends a road or lies inside roads at least twice."""
    seen = pathed.select("city", F.posexplode("path").alias("i", "p"), F.size("path").alias("n"))
    ends = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    per = seen.groupBy("city", F.col("p.node_id").alias("node_id")).agg(F.max(ends).alias("end"), F.sum((~ends).cast("int")).alias("inside"))
    return per.select("city", "node_id", (F.col("end") | (F.col("inside") >= 2)).alias("crossing"))


def intersections(pathed: DataFrame) -> DataFrame:
    """(city, node_id) of nodes that end a road or lie inside roads at least twice."""
    return node_roles(pathed).where("crossing").select("city", "node_id")


def segments(pathed: DataFrame, crossings: DataFrame) -> DataFrame:
    """(city, way_id, j, u, v, class, length_m): directed stretches between intersections, both ways where allowed.

    A stretch ends at an intersection or at the road's end, but never at the node it began with: a loop back to its start goes
    on into the next stretch, with its length.
    """
    steps = pathed.select("city", "way_id", "class", "one_way", "backward", F.posexplode("path").alias("i", "p")).select("*", F.col("p.node_id").alias("node_id"))
    marked = steps.join(crossings.withColumn("cut", F.lit(True)), ["city", "node_id"], "left")
    item = F.struct("i", "node_id", "p.x", "p.y", "p.z", F.coalesce("cut", F.lit(False)).alias("cut"))
    whole = marked.groupBy("city", "way_id", "class", "one_way", "backward").agg(F.array_sort(F.collect_list(item)).alias("path"))
    at = lambda i: F.get("path", i)

    def step(s: Column, j: Column) -> Column:
        far = s["length"] + _length(at(j - 1), at(j))
        done = (at(s["first"])["node_id"] != at(j)["node_id"]) & (at(j)["cut"] | (j == F.size("path") - 1))
        part = F.struct(at(s["first"])["node_id"].alias("a"), at(j)["node_id"].alias("b"), far.alias("length_m"))
        return F.struct(F.when(done, j).otherwise(s["first"]).alias("first"), F.when(done, 0.0).otherwise(far).alias("length"), F.when(done, F.concat(s["parts"], F.array(part))).otherwise(s["parts"]).alias("parts"))

    start = F.struct(F.lit(0).alias("first"), F.lit(0.0).alias("length"), F.array().cast("array<struct<a: bigint, b: bigint, length_m: double>>").alias("parts"))
    cuts = whole.where(F.size("path") > 1).select("city", "way_id", "class", "one_way", "backward", F.aggregate(count_up(1, F.size("path") - 1), start, step, lambda s: s["parts"]).alias("parts"))
    opened = cuts.select("city", "way_id", "class", "one_way", "backward", F.posexplode("parts").alias("j", "s")).select("*", "s.a", "s.b", "s.length_m")
    return opened.select("city", "way_id", "j", "class", "length_m", F.explode(_both_ways("a", "b")).alias("e")).select("city", "way_id", "j", F.col("e.dir").alias("dir"), F.col("e.u").alias("u"), F.col("e.v").alias("v"), "class", "length_m")


def shortest_parallel(parts: DataFrame) -> DataFrame:
    """(city, u, v, class, length_m, first_pos): of parallel stretches the shortest, the first of equals; its class."""
    place = F.struct("way_id", "j", "dir")
    best = F.min(F.struct("length_m", "way_id", "j", "dir", "class")).alias("b")
    return parts.groupBy("city", "u", "v").agg(best, F.min(place).alias("first_pos")).select("city", "u", "v", "b.class", "b.length_m", "first_pos")


def fastest_parallel(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One edge per directed pair: least free-flow time, then least length; no self-loops, no lengths of zero or less."""
    ok = (F.col("u") != F.col("v")) & (F.col("length_m") > 0) & F.col("class").isin(*FREE_KMH)
    time = (F.col("length_m") / lookup(FREE_KMH, F.col("class"))).alias("t")
    best = edges.where(ok).groupBy(*keys, "u", "v").agg(F.min(F.struct(time, "length_m", "class")).alias("b"))
    return best.select(*keys, "u", "v", "b.class", "b.length_m")


def numbered(edges: DataFrame) -> DataFrame:
    """(city, node_id, vertex): the graph's vertices, numbered from 0 by first sight in edge order, the tail before the head."""
    ends = edges.select("city", F.posexplode(F.array("u", "v")).alias("side", "node_id"), "first_pos")
    first = ends.groupBy("city", "node_id").agg(F.min(F.struct("first_pos", "side")).alias("f"))
    return numbered_by(first, "city", ["f", "node_id"], name="vertex").select("city", "node_id", "vertex")


def class_statistics(edges: DataFrame) -> DataFrame:
    """Edges and kilometres per city and class."""
    return edges.groupBy("city", "class").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("length_m") / 1000, 3).alias("km"))


def boundary_point(y1: Column, x1: Column, y2: Column, x2: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """STRUCT(lat, lon) where a step crosses the box (min_lat, min_lon, max_lat, max_lon), east and west sides first; else null."""
    s, w, n, e = box
    between = lambda v, a, b: ((a < v) & (v < b)) | ((a > v) & (v > b))
    side = F.when(between(w, x1, x2), w).when(between(e, x1, x2), e)
    level = F.when(between(s, y1, y2), s).when(between(n, y1, y2), n)
    side_y, level_x = y1 + (y2 - y1) * (side - x1) / (x2 - x1), x1 + (x2 - x1) * (level - y1) / (y2 - y1)
    pair = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    return F.when(side.isNotNull() & side_y.between(s, n), pair(side_y, side)).when(level.isNotNull() & level_x.between(w, e), pair(level, level_x))


def cropped(ways: DataFrame, nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """(city, way_id, seq, node_id, lat, lon, synthetic): the steps of ways cut to the box of their city.

    A way without a node inside drops out. An outside node next to an inside one becomes a point on the box, unless that
    neighbour lies on the box already; the step before counts first. Other outside nodes drop out. Synthetic points have
    negative ids that depend on way and place alone. Longitudes are taken around the box, which may cross the antimeridian.
    """
    box = [F.col(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")]
    boxes = boxes.withColumn("max_lon", F.col("max_lon") + F.when(F.col("min_lon") > F.col("max_lon"), 360.0).otherwise(0.0))
    steps = ways.select("city", "way_id", F.posexplode("nodes").alias("seq", "node_id")).where("node_id IS NOT NULL").join(nodes.select("node_id", "lat", "lon"), "node_id").join(boxes, "city")
    off = F.col("lon") - (F.col("min_lon") + F.col("max_lon")) / 2
    steps = steps.withColumn("lon", F.col("lon") + F.when(off < -180, 360.0).when(off > 180, -360.0).otherwise(0.0))
    s, w, n, e = box
    inside = F.col("lat").between(s, n) & F.col("lon").between(w, e)
    edge = F.col("lat").isin(s, n) | F.col("lon").isin(w, e)
    by_way = Window.partitionBy("city", "way_id").orderBy("seq")
    here = F.struct("lat", "lon", "inside", "edge")
    seen = steps.withColumns({"inside": inside, "edge": edge}).withColumns({"before": F.lag(here).over(by_way), "after": F.lead(here).over(by_way), "any": F.max("inside").over(Window.partitionBy("city", "way_id"))})
    y, x = F.col("lat"), F.col("lon")
    use_before, use_after = F.coalesce(F.col("before.inside"), F.lit(False)), F.coalesce(F.col("after.inside"), F.lit(False))
    from_before = F.when(~F.col("before.edge"), boundary_point(F.col("before.lat"), F.col("before.lon"), y, x, tuple(box)))
    from_after = F.when(~F.col("after.edge"), boundary_point(y, x, F.col("after.lat"), F.col("after.lon"), tuple(box)))
    spot = F.when(F.col("inside"), F.struct("lat", "lon")).when(use_before, from_before).when(use_after, from_after)
    kept = seen.where("any").withColumn("spot", spot).where("spot IS NOT NULL")
    made = -1 - F.pmod(F.xxhash64("way_id", "seq"), F.lit(1 << 62))
    return kept.select("city", "way_id", "seq", F.when(F.col("inside"), F.col("node_id")).otherwise(made).alias("node_id"), "spot.lat", geo.wrapped_lon(F.col("spot.lon")).alias("lon"), (~F.col("inside")).alias("synthetic"))


def city_bounds(nodes: DataFrame) -> DataFrame:
    """The box of each city's nodes; one across the antimeridian has min_lon > max_lon."""
    b = nodes.groupBy("city").agg(F.min("lat").alias("min_lat"), F.min("lon").alias("_w"), F.max("lat").alias("max_lat"), F.max("lon").alias("_e"), F.min(F.when(F.col("lon") >= 0, F.col("lon"))).alias("_w2"), F.max(F.when(F.col("lon") < 0, F.col("lon"))).alias("_e2"))
    turned = (F.col("_e") - F.col("_w") > 180) & (F.col("_e2") + 360 - F.col("_w2") < 180)
    pick = lambda far, plain: F.when(turned, F.col(far)).otherwise(F.col(plain))
    return b.select("city", "min_lat", pick("_w2", "_w").alias("min_lon"), "max_lat", pick("_e2", "_e").alias("max_lon"))


def middle_half(bounds: DataFrame) -> DataFrame:
    """The middle half of each city's box, in both directions."""
    east = F.col("max_lon") + F.when(F.col("min_lon") > F.col("max_lon"), 360.0).otherwise(0.0)
    part = lambda lo, hi, k: F.round(lo + (hi - lo) * k, 7)
    y = lambda k: part(F.col("min_lat"), F.col("max_lat"), k)
    x = lambda k: geo.wrapped_lon(part(F.col("min_lon"), east, k))
    return bounds.select("city", y(0.25).alias("min_lat"), x(0.25).alias("min_lon"), y(0.75).alias("max_lat"), x(0.75).alias("max_lon"))
