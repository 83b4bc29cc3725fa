"""The nearest road node within a box, depots and plain distance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.functions import geo


def nearest_in_box(points: DataFrame, nodes: DataFrame, reach_m: float = 100.0) -> DataFrame:
    """(city, point_id, node_id, d2): the node at the least distance among those within reach_m both east and north.

    points: city, point_id, east, north; nodes: city, node_id, east, north. Nodes go to the cell of their reach_m grid, points to the
    nine around theirs, so the join is on equal cells and carries no more than the neighbourhood. Ties go to the smaller id. A node
    outside the box is never taken, however near by other measures.
    """
    cell = lambda c: F.floor(F.col(c) / reach_m)
    around = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct((cell("east") + i).alias("cx"), (cell("north") + j).alias("cy"))))))
    p = points.select("city", "point_id", F.col("east").alias("px"), F.col("north").alias("py"), around.alias("c")).select("city", "point_id", "px", "py", "c.cx", "c.cy")
    q = nodes.select("city", "node_id", F.col("east").alias("qx"), F.col("north").alias("qy"), cell("east").alias("cx"), cell("north").alias("cy"))
    dx, dy = F.col("px") - F.col("qx"), F.col("py") - F.col("qy")
    hits = p.join(q, ["city", "cx", "cy"]).where((F.abs(dx) <= reach_m) & (F.abs(dy) <= reach_m))
    best = hits.groupBy("city", "point_id").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "node_id")).alias("b"))
    return best.select("city", "point_id", "b.node_id", "b.d2")


def snapped(points: DataFrame, nodes: DataFrame, vertices: DataFrame, reach_m: float = 100.0) -> DataFrame:
    """nearest_in_box, kept only where the nearest node is one of vertices (city, node_id); there is no second choice."""
    return nearest_in_box(points, nodes, reach_m).join(vertices.select("city", "node_id"), ["city", "node_id"], "left_semi")


def in_city_frame(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """points (city, lat, lon, ...) with east, north, up in the frame at the middle of their city's bounds."""
    lat0, lon0 = geo.bounds_center(*(F.col(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")))
    mid = bounds.select("city", lat0.alias("_lat0"), lon0.alias("_lon0"))
    e, n, u = geo.enu(F.col("lat"), F.col("lon"), F.col("_lat0"), F.col("_lon0"))
    return points.join(mid, "city").withColumns({"east": e, "north": n, "up": u}).drop("_lat0", "_lon0")


def depots(vertices: DataFrame, mode: str, seed: int = 7) -> DataFrame:
    """(city, node_id) of one depot per city: nearest to the mean of the vertices (center), to their south-west (corner), or random.

    vertices: city, node_id, lat, lon. Ties go to the smaller id.
    """
    from waymesh.functions.scalars import uniform

    if mode == "random":
        return vertices.groupBy("city").agg(F.min_by("node_id", F.struct(uniform(seed, "depot", F.col("node_id")), "node_id")).alias("node_id"))
    if mode not in ("center", "corner"):
        raise ValueError(f"unknown depot mode {mode}")
    agg = F.avg if mode == "center" else F.min
    aim = vertices.groupBy("city").agg(agg("lat").alias("y0"), agg("lon").alias("x0"))
    d = geo.haversine(F.col("lat"), F.col("lon"), F.col("y0"), F.col("x0"))
    return vertices.join(aim, "city").groupBy("city").agg(F.min_by("node_id", F.struct(F.round(d, 6), "node_id")).alias("node_id"))


def euclid_table(places: DataFrame, rounding: str = "ceil") -> DataFrame:
    """(city, i, j, cost) between the places (city, i, east, north) of each instance: whole metres up, or three decimals."""
    a, b = (places.select("city", F.col("i").alias(k), F.col("east").alias(f"e{k}"), F.col("north").alias(f"n{k}")) for k in "ij")
    d = F.hypot(F.col("ei") - F.col("ej"), F.col("ni") - F.col("nj"))
    return a.join(b, "city").where("i <> j").select("city", "i", "j", rounded_cost(d, rounding).alias("cost"))


def rounded_cost(cost: Column, rounding: str) -> Column:
    """A cost as the next whole number (guarded against noise in the ninth decimal) or with three decimals."""
    return F.ceil(F.round(cost, 6)).cast("long") if rounding == "ceil" else F.bround(cost, 3)
