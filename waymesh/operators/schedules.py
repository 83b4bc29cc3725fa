"""Tours, arrival times, service times and time windows of routing instances.

Costs come in long form: city (the instance), i, j, cost in seconds; node 0 is the depot. What is sequential within a route folds
over the route's array inside one expression; greedy tours run in one task per instance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.arrays import neighbours
from waymesh.functions.scalars import HORIZON, clamp, gauss, repaired_window, uniform, whole_between

# Mean, deviation and bounds of window widths as shares of the horizon.
WIDTHS = {"route_centered": (0.2, 0.08, 0.01, 1.0), "reachable_interval": (0.5, 0.2, 0.01, 1.0), "td-shared": (0.2, 0.08, 0.01, 1.0), "tight": (0.05, 0.02, 0.01, 0.15), "spread": (0.2, 0.08, 0.01, 1.0)}


def legs(routes: DataFrame, depot: int = 0) -> DataFrame:
    """(all other columns, leg, from_node, to_node): consecutive stops with the depot before and after; routes: ..., route ARRAY.

    Null and empty routes have no legs.
    """
    full = F.concat(F.array(F.lit(depot)), F.col("route").cast("array<bigint>"), F.array(F.lit(depot).cast("long")))
    steps = neighbours(full, "a", "b")
    keep = [c for c in routes.columns if c != "route"]
    return routes.where(F.size("route") > 0).select(*keep, F.posexplode(steps).alias("leg", "s")).select(*keep, "leg", F.col("s.a").alias("from_node"), F.col("s.b").alias("to_node"))


def timed_routes(routes: DataFrame, costs: DataFrame, stops: DataFrame) -> DataFrame:
    """One row per route with steps ARRAY<STRUCT<leg, node, travel, service, earliest, latest>>, the last step the depot's.

    routes: city, run, route_idx, route; stops: city, node, service, earliest, latest. A leg without cost has null travel.
    """
    l = legs(routes)
    c = costs.select("city", F.col("i").alias("from_node"), F.col("j").alias("to_node"), F.col("cost").alias("travel"))
    s = stops.select("city", F.col("node").alias("to_node"), "service", "earliest", "latest")
    joined = l.join(c, ["city", "from_node", "to_node"], "left").join(s, ["city", "to_node"], "left")
    step = F.struct("leg", F.col("to_node").alias("node"), F.col("travel").cast("double").alias("travel"), F.coalesce("service", F.lit(0)).cast("double").alias("service"), F.col("earliest").cast("double").alias("earliest"), F.col("latest").cast("double").alias("latest"))
    return joined.groupBy("city", "run", "route_idx").agg(F.array_sort(F.collect_list(step)).alias("steps"))


def arrivals(routes: DataFrame, costs: DataFrame, stops: DataFrame, wait: bool = False, start: float = 0.0) -> DataFrame:
    """(city, run, route_idx, leg, node, arrival, begin): when each stop is reached and served, the return included.

    With wait, service begins no earlier than the window opens, else on arrival.
    """
    def step(s: Column, x: Column) -> Column:
        at = s["clock"] + x["travel"]
        begin = F.greatest(at, x["earliest"]) if wait else at
        return F.struct((begin + x["service"]).alias("clock"), F.concat(s["seen"], F.array(F.struct(x["leg"].alias("leg"), x["node"].alias("node"), at.alias("arrival"), begin.alias("begin")))).alias("seen"))

    zero = F.struct(F.lit(start).cast("double").alias("clock"), F.array().cast("array<struct<leg: int, node: bigint, arrival: double, begin: double>>").alias("seen"))
    timed = timed_routes(routes, costs, stops)
    return timed.select("city", "run", "route_idx", F.inline(F.aggregate("steps", zero, step, lambda s: s["seen"])))


def nearest_tour(cost: np.ndarray) -> list[int]:
    """Customers in the order of always going to the nearest one left, from node 0; ties to the lowest."""
    left, at, tour = np.ones(len(cost), bool), 0, []
    left[0] = False
    while left.any():
        at = int(np.argmin(np.where(left, cost[at], np.inf)))
        left[at] = False
        tour.append(at)
    return tour


def anchor_tours(cost: np.ndarray, demand: np.ndarray, service: np.ndarray, capacity: float, horizon: float = HORIZON) -> list[list[int]]:
    """Routes built greedily: always the nearest customer that fits the load and still allows the return in time."""
    left = np.ones(len(cost), bool)
    left[0] = False
    tours = []
    while left.any():
        at, load, clock, tour = 0, 0.0, 0.0, []
        while True:
            reach = clock + cost[at] + service
            ok = left & (load + demand <= capacity) & (reach + cost[:, 0] <= horizon)
            if not ok.any():
                break
            at = int(np.argmin(np.where(ok, cost[at], np.inf)))
            left[at] = False
            tour.append(at)
            load, clock = load + demand[at], reach[at]
        if not tour:
            raise ValueError(f"customer {int(np.flatnonzero(left)[0])} cannot begin a route that fits capacity and horizon")
        tours.append(tour)
    return tours


def _square(frame: pd.DataFrame) -> np.ndarray:
    n = int(max(frame["i"].max(), frame["j"].max())) + 1
    m = np.full((n, n), np.inf)
    m[frame["i"], frame["j"]] = frame["cost"]
    return m


def nearest_tours(costs: DataFrame) -> DataFrame:
    """(city, route): the nearest-neighbour tour of each instance, blind to capacity. An instance's table is one task's input."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"city": [frame["city"].iloc[0]], "route": [nearest_tour(_square(frame))]})

    return costs.select("city", "i", "j", F.col("cost").cast("double").alias("cost")).groupBy("city").applyInPandas(run, "city string, route array<bigint>")


def anchor_routes(costs: DataFrame, stops: DataFrame) -> DataFrame:
    """(city, route_idx, route): greedy feasible routes; stops: city, node, demand, service, capacity."""

    def run(key, c: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(s):
            return pd.DataFrame(columns=["city", "route_idx", "route"])
        m, s = _square(c), s.sort_values("node")
        demand, service = np.zeros(len(m)), np.zeros(len(m))
        demand[s["node"]], service[s["node"]] = s["demand"], s["service"]
        tours = anchor_tours(m, demand, service, float(s["capacity"].max()))
        return pd.DataFrame({"city": key[0], "route_idx": range(len(tours)), "route": tours})

    left = costs.select("city", "i", "j", F.col("cost").cast("double").alias("cost")).groupBy("city")
    return left.cogroup(stops.select("city", "node", "demand", "service", "capacity").toDF("city", "node", "demand", "service", "capacity").groupBy("city")).applyInPandas(run, "city string, route_idx int, route array<bigint>")


def mean_service_ratio(seed: int, key: Column) -> Column:
    """The instance's mean service time as a share of the horizon."""
    return clamp(0.01 + 0.005 * gauss(seed, "service_mean", key), 0.001, 0.2)


def service_times(nodes: DataFrame, seed: int) -> DataFrame:
    """nodes (city, node) with service: whole seconds, normal around the instance's mean, 1 to twice the mean; 0 at the depot."""
    mean = HORIZON * mean_service_ratio(seed, F.col("city"))
    drawn = F.bround(mean + mean / 2 * gauss(seed, "service", F.col("city"), F.col("node")))
    return nodes.withColumn("service", F.when(F.col("node") == 0, 0).otherwise(clamp(drawn, 1.0, F.greatest(F.lit(1.0), F.floor(mean * 2).cast("double")))).cast("long"))


def drawn_width(kind: str, seed: int, *key: Column) -> Column:
    """A window's width in whole seconds."""
    mean, std, lo, hi = WIDTHS[kind]
    return F.greatest(F.lit(1.0), F.bround(HORIZON * clamp(mean + std * gauss(seed, "width:" + kind, *key), lo, hi)))


def windows(nodes: DataFrame, kind: str, seed: int) -> DataFrame:
    """nodes with earliest, latest and repaired, by method route_centered (centred on arrival) or reachable_interval.

    nodes: city, node, to, back (travel from and to the depot), service and, for route_centered, arrival. The depot's window is the
    horizon. What depot travel doesn't allow is repaired away; a customer that cannot be served gets a point.
    """
    key = (F.col("city"), F.col("node"))
    to, back, service = (F.col(c).cast("long") for c in ("to", "back", "service"))
    w = drawn_width(kind, seed, *key)
    if kind == "route_centered":
        raw = (F.bround(F.col("arrival") - w / 2).cast("long"), F.bround(F.col("arrival") + w / 2).cast("long"))
        pair = repaired_window(*raw, to, back, service)
    else:
        width, lo, hi = w.cast("long"), to, HORIZON - service - back
        a, z = lo + F.floor(width / 2), hi - F.floor(width / 2)
        center = F.when(a > z, F.floor((lo + hi) / 2)).otherwise(whole_between(a, z, uniform(seed, "center", *key)))
        start = (center - F.floor(width / 2)).cast("long")
        point = clamp(lo, 0, HORIZON).cast("long")
        pair = F.when(hi < lo, F.struct(point.alias("earliest"), point.alias("latest"))).otherwise(repaired_window(start, start + width, to, back, service))
    depot = F.struct(F.lit(0).cast("long").alias("earliest"), F.lit(HORIZON).cast("long").alias("latest"))
    first = nodes.withColumn("_w", F.when(F.col("node") == 0, depot).otherwise(pair))
    again = F.when(F.col("node") == 0, F.col("_w")).otherwise(repaired_window(F.col("_w.earliest"), F.col("_w.latest"), to, back, service))
    return first.withColumn("_v", again).withColumns({"earliest": F.col("_v.earliest"), "latest": F.col("_v.latest"), "repaired": F.col("_v") != F.col("_w")}).drop("_w", "_v")


def feasible_bounds(to: Column, back: Column, service: Column) -> tuple[Column, Column]:
    """First and last whole second at which service may begin; last < first if the customer cannot be served."""
    return F.ceil(to).cast("long"), F.floor(HORIZON - back - service).cast("long")


def family_windows(nodes: DataFrame, kind: str, seed: int) -> DataFrame:
    """nodes with earliest and latest of a window set: td-shared and tight around visit, spread around a uniform time.

    nodes: city, node, to, back, service, visit. The end is cut to the feasible bounds, the start only to the day and the end. A
    customer that cannot be served is an error when the row is computed.
    """
    key = (F.col("city"), F.col("node"))
    lo, hi = feasible_bounds(F.col("to"), F.col("back"), F.col("service"))
    w = drawn_width(kind, seed, *key)
    center = lo + uniform(seed, "spread", *key) * (hi - lo) if kind == "spread" else F.col("visit")
    latest = clamp(F.bround(center + w / 2), lo.cast("double"), hi.cast("double"))
    earliest = clamp(F.bround(center - w / 2), 0.0, latest)
    bad = (F.col("node") != 0) & (hi < lo)
    depot = F.col("node") == 0
    out = nodes.withColumns({"earliest": F.when(depot, 0).otherwise(earliest).cast("long"), "latest": F.when(depot, HORIZON).when(bad, F.raise_error(F.concat(F.lit("customer cannot be served within the horizon: "), F.col("node").cast("string")))).otherwise(latest).cast("long")})
    return out


def route_checks(routes: DataFrame, costs: DataFrame, stops: DataFrame, horizon: float = HORIZON) -> DataFrame:
    """(city, run, route_idx, load, capacity, cost, late_stops, returned, ok) of each route against load, windows and horizon.

    stops: city, node, demand, service, earliest, latest, capacity. A leg without cost makes cost null and the route not ok.
    """
    served = arrivals(routes, costs, stops, wait=True)
    s = stops.select("city", "node", "demand", "latest", "capacity")
    travel = timed_routes(routes, costs, stops).select("city", "run", "route_idx", F.aggregate("steps", F.lit(0.0), lambda a, x: a + x["travel"]).alias("cost"))
    joined = served.join(s, ["city", "node"], "left")
    back = F.col("node") == 0
    per = joined.groupBy("city", "run", "route_idx").agg(
        F.sum(F.when(~back, F.col("demand"))).alias("load"), F.max("capacity").alias("capacity"), F.sum((~back & (F.coalesce(F.col("begin") > F.col("latest"), F.lit(True)))).cast("int")).alias("late_stops"), F.max(F.when(back, F.col("begin"))).alias("returned")
    )
    ok = (F.col("load") <= F.col("capacity")) & (F.col("late_stops") == 0) & (F.col("returned") <= horizon) & F.col("cost").isNotNull()
    return per.join(travel, ["city", "run", "route_idx"]).withColumn("ok", F.coalesce(ok, F.lit(False)))


def coverage(routes: DataFrame, stops: DataFrame) -> DataFrame:
    """(city, run, missing, repeated, unknown): customers not visited, visited more than once, and visits to no customer."""
    seen = routes.select("city", "run", F.explode("route").alias("node")).where("node IS NOT NULL").groupBy("city", "run", "node").agg(F.count(F.lit(1)).alias("k"))
    wanted = stops.where("node <> 0").select("city", "node").distinct().join(routes.select("city", "run").distinct(), "city").withColumn("w", F.lit(True))
    both = wanted.join(seen, ["city", "run", "node"], "full")
    return both.groupBy("city", "run").agg(F.sum(F.col("k").isNull().cast("int")).alias("missing"), F.sum((F.coalesce("k", F.lit(0)) > 1).cast("int")).alias("repeated"), F.sum((F.col("w").isNull()).cast("int")).alias("unknown"))


def lifted_windows(needs: DataFrame, stops: DataFrame) -> DataFrame:
    """stops with latest raised to the greatest need, and lift and worst, the traffic that asks most (the first of equals).

    needs: city, node, sub, sub_pos, begin (service begin under the traffic sub).
    """
    need = F.ceil(F.round("begin", 6)).cast("long")
    top = needs.where("node <> 0").groupBy("city", "node").agg(F.max(need).alias("needed"), F.max_by("sub", F.struct(need, -F.col("sub_pos"))).alias("worst"))
    joined = stops.join(top, ["city", "node"], "left")
    lift = F.greatest(F.lit(0), F.coalesce("needed", F.lit(0)) - F.col("latest"))
    return joined.withColumns({"lift": lift.cast("long"), "worst": F.when(lift > 0, F.col("worst"))}).withColumn("latest", F.col("latest") + F.col("lift")).drop("needed")


def lift_statistics(lifted: DataFrame) -> DataFrame:
    """(city, n_lifted, max_lift) of lifted_windows(); 0 where nothing was raised."""
    return lifted.groupBy("city").agg(F.count_if(F.col("lift") > 0).alias("n_lifted"), F.max("lift").alias("max_lift"))


def anchors_or_tours(anchors: DataFrame, costs: DataFrame) -> DataFrame:
    """(city, run, route_idx, route): the recorded anchors (city, route_idx, route) of each instance, else its nearest-neighbour tour."""
    tours = nearest_tours(costs.join(anchors.select("city").distinct(), "city", "left_anti"))
    both = anchors.select("city", F.lit("anchor").alias("run"), F.col("route_idx").cast("int").alias("route_idx"), F.col("route").cast("array<bigint>").alias("route"))
    return both.unionByName(tours.select("city", F.lit("tour").alias("run"), F.lit(0).alias("route_idx"), "route"))


def missing_arcs(needed: DataFrame, arcs: DataFrame) -> DataFrame:
    """Distinct (city, from_node, to_node) of needed legs that no arc (city, i, j) serves."""
    have = arcs.select("city", F.col("i").cast("long").alias("from_node"), F.col("j").cast("long").alias("to_node")).distinct()
    return needed.select("city", "from_node", "to_node").distinct().join(have, ["city", "from_node", "to_node"], "left_anti")
