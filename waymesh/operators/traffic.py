"""Hourly traffic on road graphs: wave and volume-delay speed profiles, trips, flows and travel through changing speeds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions import geo
from waymesh.functions.arrays import neighbours
from waymesh.functions.scalars import CAPACITY_VEH_H, FREE_KMH, clamp, gauss, lookup, rounded_speed, uniform
from waymesh.operators.graph import MAX_EDGES, Net, batches, dealt, numbered_by, shortest_paths, sized, walked

# Fixed values of the traffic models.
BINS, BIN_S = 24, 3600.0
FLOOR = 0.12
AMPLITUDE = {"light": 0.25, "moderate": 0.45, "heavy": 0.65}
TRIPS_PER_VERTEX = {"light": 2.5, "moderate": 5.0, "heavy": 10.0}
JITTER, CENTER_DECAY_M, EDGE_SHARE = 0.08, 3000.0, 0.35
ALPHA, BETA, SLOWEST = 0.15, 4, 6.0


def model_params(model: str, intensity: str) -> dict:
    """The parameters of a traffic model, to be recorded beside its speeds."""
    if model == "wave":
        return {"amplitude": AMPLITUDE[intensity], "jitter": JITTER, "center_decay_m": CENTER_DECAY_M, "floor_share": EDGE_SHARE, "min_speed_factor": FLOOR}
    if model == "bpr":
        times = {"morning": [8.0, 0.75], "evening": [17.5, 1.0], "lunch_return": [12.25, 0.5], "lunch_back": [13.5, 0.5], "lunch_probability": 0.25}
        return {"trips_per_vertex": TRIPS_PER_VERTEX[intensity], "bpr_alpha": ALPHA, "bpr_beta": BETA, "multiplier_cap": SLOWEST, "capacity_veh_h": {str(k): v for k, v in CAPACITY_VEH_H.items()}, "min_speed_factor": FLOOR, "departures": times}
    raise ValueError(f"unknown traffic model {model}")


def free_speed(road_class: Column) -> Column:
    """Free speed of a class in m/s."""
    return lookup(FREE_KMH, road_class) / 3.6


def rush(hour_bin: Column) -> Column:
    """The share of the full rush in an hour of the day, with peaks at 8:15 and 17:45."""
    h = hour_bin + F.lit(0.5)
    peak = lambda at, wide: F.exp(-((h - at) * (h - at)) / (2 * wide * wide))
    return F.least(peak(8.25, 1.1) + 0.85 * peak(17.75, 1.5), F.lit(1.0))


def wave_profiles(edges: DataFrame, vertices: DataFrame, intensity: str, seed: int) -> DataFrame:
    """edges (city, u, v, class) with profile: 24 speeds that dip with the rush, more so near the middle of the vertices.

    vertices: city, node_id, lat, lon. Each edge's jitter depends on seed and edge alone. No loop, no Python: one expression.
    """
    mid = vertices.groupBy("city").agg(F.avg("lat").alias("cy"), F.avg("lon").alias("cx"))
    a = vertices.select("city", F.col("node_id").alias("u"), F.col("lat").alias("uy"), F.col("lon").alias("ux"))
    b = vertices.select("city", F.col("node_id").alias("v"), F.col("lat").alias("vy"), F.col("lon").alias("vx"))
    placed = edges.join(a, ["city", "u"]).join(b, ["city", "v"]).join(mid, "city")
    near = F.exp(-geo.haversine((F.col("uy") + F.col("vy")) / 2, (F.col("ux") + F.col("vx")) / 2, F.col("cy"), F.col("cx")) / CENTER_DECAY_M)
    share = EDGE_SHARE + (1 - EDGE_SHARE) * near
    jitter = 1 + (2 * uniform(seed, "jitter", F.col("city"), F.col("u"), F.col("v")) - 1) * JITTER
    free = free_speed(F.col("class"))
    profile = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: rounded_speed(F.greatest(F.col("_free") * (1 - AMPLITUDE[intensity] * rush(k) * F.col("_share")) * F.col("_jitter"), F.col("_free") * FLOOR)))
    return placed.withColumns({"_free": free, "_share": share, "_jitter": jitter}).select(*edges.columns, profile.alias("profile"))


def volume_delay_profiles(edges: DataFrame, flows: DataFrame) -> DataFrame:
    """edges (city, u, v, class) with profile: free speed slowed by flow over capacity; flows: city, u, v, bin, n.

    Edges and hours without flow keep the free speed. Flows arrive as one small map per edge, so there is no row per hour.
    """
    per = flows.groupBy("city", "u", "v").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_n"))
    free = free_speed(F.col("class"))

    def at(k: Column) -> Column:
        ratio = F.coalesce(F.element_at("_n", k), F.lit(0)) / F.col("_cap")
        return rounded_speed(F.greatest(F.col("_free") / F.least(1 + ALPHA * F.pow(ratio, F.lit(BETA)), F.lit(SLOWEST)), F.col("_free") * FLOOR))

    joined = edges.join(per, ["city", "u", "v"], "left").withColumns({"_free": free, "_cap": lookup(CAPACITY_VEH_H, F.col("class"))})
    return joined.select(*edges.columns, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), at).alias("profile"))


def work_pool(vertices: DataFrame, snapped: DataFrame, least: int = 50) -> DataFrame:
    """(city, node_id): the vertices on which a point of interest snapped, or all of a city's vertices where fewer than `least` did.

    vertices: city, node_id; snapped: city, node_id, possibly repeated, not only vertices.
    """
    v = vertices.select("city", "node_id").distinct()
    hit = v.join(snapped.select("city", "node_id").distinct(), ["city", "node_id"], "left_semi")
    enough = hit.groupBy("city").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).select("city")
    return hit.join(enough, "city", "left_semi").unionByName(v.join(enough, "city", "left_anti"))


def trips(homes: DataFrame, works: DataFrame, intensity: str, seed: int) -> DataFrame:
    """(city, commuter, home, work, departure_s, to_work): a day's trips; homes and works: city, node_id.

    Each city has round(trips per vertex * vertices) commuters. Each goes to work in the morning and back in the evening, every
    fourth also home and back at noon. Home and work are drawn by number from the city's ascending lists; who lives at work stays.
    """
    def ranked(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        w = numbered_by(df.select("city", "node_id").distinct(), "city", ["node_id"], name="_k")
        return w.select("city", F.col("_k").alias(f"_{name}"), F.col("node_id").alias(name)), w.groupBy("city").agg(F.count(F.lit(1)).alias(f"_n_{name}"))

    (home, n_home), (work, n_work) = ranked(homes, "home"), ranked(works, "work")
    size = n_home.join(n_work, "city").withColumn("commuter", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.bround(TRIPS_PER_VERTEX[intensity] * F.col("_n_home")).cast("int")))))
    draw = lambda n: F.floor(uniform(seed, n, F.col("city"), F.col("commuter")) * F.col(f"_n_{n}")).cast("int")
    who = size.select("city", "commuter", draw("home").alias("_home"), draw("work").alias("_work")).join(home, ["city", "_home"]).join(work, ["city", "_work"]).where("home <> work")
    hour = lambda label, mean, std: clamp(mean + std * gauss(seed, label, F.col("city"), F.col("commuter")), 0.25, 23.75) * 3600.0
    leg = lambda t, to: F.struct(t.alias("departure_s"), F.lit(to).alias("to_work"))
    day = F.array(leg(hour("morning", 8.0, 0.75), True), leg(hour("evening", 17.5, 1.0), False))
    noon = F.array(leg(hour("noon_out", 12.25, 0.5), False), leg(hour("noon_back", 13.5, 0.5), True))
    lunch = uniform(seed, "lunch", F.col("city"), F.col("commuter")) < 0.25
    return who.select("city", "commuter", "home", "work", F.inline(F.when(lunch, F.concat(day, noon)).otherwise(day)))


def clock_bin(clock: Column) -> Column:
    """The hour of a clock in seconds; whatever is past midnight counts in the last hour."""
    return clamp(F.floor(clock / BIN_S), 0, BINS - 1).cast("int")


def _flow_kernel(key, edges: pa.Table, trips_: pa.Table) -> pa.Table:
    """Counts of the trips of one chunk. Trees of the workplaces run forward for trips from work and on the turned graph for trips to work."""
    u, v, time = (edges[c].to_numpy() for c in ("u", "v", "time"))
    home, work, clock, to_work = (trips_[c].to_numpy() for c in ("home", "work", "departure_s", "to_work"))
    count = np.zeros(len(u) * BINS, np.int64)
    for turned in (False, True):
        net = Net.of(u, v, time, home, work, turned=turned)
        some = np.flatnonzero(to_work == turned)
        some = some[np.argsort(work[some], kind="stable")]
        h, w, c = np.searchsorted(net.ids, home[some]), np.searchsorted(net.ids, work[some]), clock[some].astype(float)
        for sources, t in batches(net, np.unique(w)):
            mine = np.arange(np.searchsorted(w, sources[0]), np.searchsorted(w, sources[-1], "right"))
            row, goal, now = np.searchsorted(sources, w[mine]), h[mine], c[mine].copy()
            if turned:  # the last edge of the turned tree is the first towards work
                at, left = goal, np.flatnonzero(t.hops[row, goal] > 0)
                while len(left):
                    e = t.via[row[left], at[left]]
                    np.add.at(count, net.edge[e] * BINS + _bins(now[left]), 1)
                    now[left] += net.weight[e]
                    at[left] = net.tail[e]
                    left = left[t.hops[row[left], at[left]] > 0]
            else:
                offset, path = walked(net, t, row, goal)
                size, k = np.diff(offset), 0
                left = np.flatnonzero(size)
                while len(left):
                    e = path[offset[left] + k]
                    np.add.at(count, net.edge[e] * BINS + _bins(now[left]), 1)
                    now[left] += net.weight[e]
                    k += 1
                    left = left[size[left] > k]
    hit = np.flatnonzero(count)
    city = pa.array([key[0].as_py()], pa.string()).take(pa.array(np.zeros(len(hit), np.int64)))
    return pa.table({"city": city, "u": pa.array(u[hit // BINS], pa.int64()), "v": pa.array(v[hit // BINS], pa.int64()), "bin": pa.array((hit % BINS).astype(np.int32)), "n": pa.array(count[hit])})


def _bins(clock: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(clock / BIN_S), 0, BINS - 1).astype(np.int64)


def flows_by_joins(edges: DataFrame, day: DataFrame) -> DataFrame:
    """hourly_flows for graphs of any size: paths by rounds of joins, entry times by a running sum, counts by a hash aggregate.

    As in the kernel, paths to work are those from work on the turned graph.
    """
    one = day.groupBy("city", "home", "work", "departure_s", "to_work").agg(F.count(F.lit(1)).alias("k"))
    light = edges.groupBy("city", "u", "v").agg(F.min("time").alias("time"))
    out = None
    for to_work in (False, True):
        mine = one.where(F.col("to_work") == to_work).withColumnsRenamed({"work": "source", "home": "target"})
        graph = light.select("city", F.col("v").alias("u"), F.col("u").alias("v"), "time") if to_work else light
        paths = shortest_paths(graph, mine.select("city", "source", "target"), "time", with_paths=True, max_edges=0).where("path IS NOT NULL")
        path = F.reverse("path") if to_work else F.col("path")
        steps = mine.join(paths.select("city", "source", "target", path.alias("path")), ["city", "source", "target"])
        part = steps.select("city", "source", "target", "departure_s", "k", F.lit(to_work).alias("to_work"), F.posexplode(neighbours(F.col("path"), "u", "v")).alias("pos", "e"))
        out = part if out is None else out.unionByName(part)
    timed = out.select("city", "source", "target", "departure_s", "to_work", "k", "pos", "e.u", "e.v").join(light, ["city", "u", "v"])
    w = Window.partitionBy("city", "source", "target", "departure_s", "to_work").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    entered = timed.withColumn("bin", clock_bin(F.col("departure_s") + F.coalesce(F.sum("time").over(w), F.lit(0.0))))
    return entered.groupBy("city", "u", "v", "bin").agg(F.sum("k").alias("n"))


def hourly_flows(edges: DataFrame, day: DataFrame, works_per_task: int = 64, max_edges: int = MAX_EDGES) -> DataFrame:
    """(city, u, v, bin, n): how many trips enter each edge in each hour, on fastest free-flow paths; edges: city, u, v, time.

    Trips are grouped by workplace, of which there are few: one tree per workplace and direction. Workplaces are dealt to tasks (graph.dealt),
    so a large city is many tasks; each counts its own trips and a final sum adds the counts. Trips without a path count nowhere. Graphs
    of more than max_edges edges are routed by flows_by_joins.
    """
    light = edges.groupBy("city", "u", "v").agg(F.min("time").cast("double").alias("time"))
    small, large = sized(light, max_edges)
    mine = day.select(F.col("city").cast("string").alias("city"), "home", "work", "departure_s", "to_work")
    far = None
    if large is not None:
        cities = large.select("city").distinct()
        far = flows_by_joins(large, mine.join(cities, "city", "left_semi"))
        mine = mine.join(cities, "city", "left_anti")
    rows, copies = dealt(mine, small, "work", works_per_task)
    part = copies.groupBy("city", "chunk").cogroup(rows.groupBy("city", "chunk")).applyInArrow(_flow_kernel, "city string, u bigint, v bigint, bin int, n bigint")
    found = part.groupBy("city", "u", "v", "bin").agg(F.sum("n").alias("n"))
    return found if far is None else found.unionByName(far)


def known_prefix(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """The steps (keys..., pos, u, v) of each path up to, not including, the first that is no edge; with the edge's columns."""
    keys = [c for c in steps.columns if c not in ("pos", "u", "v")]
    joined = steps.join(edges.withColumn("_is", F.lit(True)), [c for c in ("city", "u", "v") if c in edges.columns and c in steps.columns], "left")
    broken = F.max(F.col("_is").isNull().cast("int")).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("_broken", broken).where("_broken = 0").drop("_broken", "_is")


def entry_bins(steps: DataFrame) -> DataFrame:
    """steps (trip keys..., pos, time, departure_s) with entry_s and bin: when each edge is entered at free flow."""
    keys = [c for c in steps.columns if c not in ("pos", "time", "departure_s", "u", "v")]
    before = F.sum("time").over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return steps.withColumn("entry_s", F.col("departure_s") + F.coalesce(before, F.lit(0.0))).withColumn("bin", clock_bin(F.col("entry_s")))


def overlay(profiles: DataFrame, limits: DataFrame) -> DataFrame:
    """Profiles (city, u, v, profile) of the edges of limits (city, u, v, limit), nowhere above the limit."""
    return limits.join(profiles, ["city", "u", "v"]).select(*limits.columns, F.transform("profile", lambda x: F.least(x, F.col("limit"))).alias("profile"))


def missing_profiles(profiles: DataFrame, limits: DataFrame) -> DataFrame:
    """Edges of limits that have no profile; an overlay is whole if there are none."""
    return limits.join(profiles, ["city", "u", "v"], "left_anti")


def valid_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles with whether they have 24 speeds, all above zero."""
    return profiles.withColumn("valid", (F.size("profile") == BINS) & F.forall("profile", lambda x: F.coalesce(x > 0, F.lit(False))))


def through(clock: Column, length: Column, profile: Column) -> Column:
    """The clock after a stretch entered at clock, with the speed of each hour; speeds repeat daily and none overtakes.

    Hour by hour: what the rest of the hour cannot cover is left for the next one. Of a stretch of more than 48 hours, all whole
    days but the last are taken first: a day covers the same distance from any clock.
    """
    day = F.aggregate(profile, F.lit(0.0), lambda a, x: a + x) * BIN_S
    whole = F.coalesce(F.greatest(F.lit(0.0), F.floor(length / day) - 1.0), F.lit(0.0))
    zero = F.struct((clock + whole * (BIN_S * BINS)).cast("double").alias("t"), F.coalesce(length - whole * day, length).cast("double").alias("rest"))

    def hour(s: Column, _: Column) -> Column:
        k = F.pmod(F.floor(s["t"] / BIN_S), F.lit(BINS)).cast("int")
        speed = F.element_at(profile, k + 1)
        ends = (F.floor(s["t"] / BIN_S) + 1) * BIN_S
        reach = (ends - s["t"]) * speed
        done = s["rest"] <= reach
        return F.struct(F.when(s["rest"] <= 0, s["t"]).when(done, s["t"] + s["rest"] / speed).otherwise(ends.cast("double")).alias("t"), F.when(done, 0.0).otherwise(s["rest"] - reach).alias("rest"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(49)), zero, hour, lambda s: s["t"])


def arrival_after_path(paths: DataFrame, departures: Column) -> DataFrame:
    """paths (keys..., steps ARRAY<STRUCT<pos, length_m, profile>>) with departure and arrival for each of the departures."""
    ride = F.aggregate("steps", F.col("departure").cast("double"), lambda t, s: through(t, s["length_m"], s["profile"]))
    return paths.withColumn("departure", F.explode(departures)).withColumn("arrival", ride)


def _arrival_kernel(departures: list[float]):
    """Arrow kernel of one chunk: arrivals through the trees of free-flow times, level by level, for all sources and departures at once."""

    def run(key, edges: pa.Table, pairs: pa.Table) -> pa.Table:
        source, target = (pairs[c].to_numpy() for c in ("source", "target"))
        net = Net.of(*(edges[c].to_numpy() for c in ("u", "v", "time")), source, target)
        length = edges["length_m"].to_numpy()[net.edge]
        profile = edges["profile"].combine_chunks()
        profile = (profile.chunk(0) if isinstance(profile, pa.ChunkedArray) and profile.num_chunks else profile).flatten().to_numpy() if len(edges) else np.empty(0)
        profile = profile.reshape(-1, BINS)[net.edge] if len(edges) else np.empty((0, BINS))
        s, t = np.searchsorted(net.ids, source), np.searchsorted(net.ids, target)
        order = np.argsort(s, kind="stable")
        s, t = s[order], t[order]
        parts = []
        for some, found in batches(net, np.unique(s)):
            clock = np.full((len(departures), *found.hops.shape), np.nan)
            clock[:, np.arange(len(some)), some] = np.array(departures)[:, None]
            level = found.hops.ravel()
            by_level = np.argsort(level, kind="stable")
            edge = np.searchsorted(level[by_level], np.arange(1, level.max(initial=0) + 2))
            flat = clock.reshape(len(departures), -1)
            for a, z in zip(edge[:-1], edge[1:]):
                at = by_level[a:z]
                e = found.via.ravel()[at]
                before = flat[:, at - at % len(net.ids) + net.tail[e]]
                flat[:, at] = driven(before.ravel(), np.tile(length[e], len(departures)), profile, np.tile(e, len(departures))).reshape(before.shape)
            mine = slice(np.searchsorted(s, some[0]), np.searchsorted(s, some[-1], "right"))
            parts.append(clock[:, np.searchsorted(some, s[mine]), t[mine]].T)
        arrival = np.concatenate(parts) if parts else np.empty((0, len(departures)))
        there = np.isfinite(arrival)
        row, which = np.nonzero(there)
        city = pa.array([key[0].as_py()], pa.string()).take(pa.array(np.zeros(len(row), np.int64)))
        return pa.table({"city": city, "source": pa.array(net.ids[s[row]]), "target": pa.array(net.ids[t[row]]), "departure": pa.array(np.array(departures, float)[which]), "arrival": pa.array(arrival[row, which])})

    return run


def tree_arrivals(edges: DataFrame, pairs: DataFrame, departures: list[float], sources_per_task: int = 64) -> DataFrame:
    """(city, source, target, departure, arrival) along the fastest free-flow paths, for pairs that have one.

    edges: city, u, v, time, length_m, profile (24 speeds), one row for each u and v; pairs: city, source, target. A tree is driven
    once for each departure, so a path costs its last edge, not its length. A path over an edge without profile has no row. As
    arrival_after_path on timed_paths, for graphs that one task can hold (graph.MAX_EDGES).
    """
    wanted = pairs.select(F.col("city").cast("string").alias("city"), "source", "target").dropna().distinct()
    slim = edges.select(F.col("city").cast("string").alias("city"), "u", "v", F.col("time").cast("double").alias("time"), F.col("length_m").cast("double").alias("length_m"), F.coalesce("profile", F.array_repeat(F.lit(float("nan")), BINS)).alias("profile")).where("time >= 0")
    rows, copies = dealt(wanted, slim, "source", sources_per_task)
    return copies.groupBy("city", "chunk").cogroup(rows.groupBy("city", "chunk")).applyInArrow(_arrival_kernel(departures), "city string, source bigint, target bigint, departure double, arrival double")


def simplified(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Places of the points to keep so that straight lines between them are within the tolerance of all others."""
    keep, todo = {0, len(x) - 1}, [(0, len(x) - 1)]
    while todo:
        a, z = todo.pop()
        if z - a < 2:
            continue
        off = np.abs(np.interp(x[a : z + 1], [x[a], x[z]], [y[a], y[z]]) - y[a : z + 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep.add(a + k)
            todo += [(a, a + k), (a + k, z)]
    return np.array(sorted(keep))


def tolerance_for(n: int) -> float:
    """Seconds of tolerance for instances of n customers."""
    return 1.0 if n <= 100 else 2.0


def arrival_functions(arcs: DataFrame, step_s: float = 60.0, tolerance_s: float = 1.0, horizon_s: float = 86400.0) -> DataFrame:
    """arcs (city, i, j, steps) to (city, i, j, departures, arrivals): the arrival-time function as breakpoints of straight pieces.

    The exact ride is sampled every step_s over the day, all departures of an arc at once, and thinned within the tolerance.
    """
    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                x = np.arange(0.0, horizon_s + step_s / 2, step_s)
                t = x.copy()
                for s in sorted(r.steps, key=lambda s: s["pos"]):
                    t = ride_through(t, float(s["length_m"]), np.asarray(s["profile"], float))
                k = simplified(x, t, tolerance_s)
                out.append((r.city, r.i, r.j, x[k], t[k]))
            yield pd.DataFrame(out, columns=["city", "i", "j", "departures", "arrivals"])

    return arcs.select("city", "i", "j", "steps").mapInPandas(run, "city string, i int, j int, departures array<double>, arrivals array<double>")


def ride_through(t: np.ndarray, length: float, profile: np.ndarray) -> np.ndarray:
    """Clocks after a stretch for many entry clocks; the array form of through."""
    return driven(t, np.full(len(t), length), profile.reshape(1, BINS), np.zeros(len(t), np.int64))


def driven(t: np.ndarray, length: np.ndarray, profiles: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Clocks after stretches of the lengths entered at t, each with its own profile; whole days but the last are taken first, as in through."""
    day = profiles.sum(axis=1)[which] * BIN_S
    whole = np.maximum(0.0, np.floor(length / day) - 1.0)
    t, rest = t + whole * (BIN_S * BINS), length - whole * day
    on = np.flatnonzero((rest > 0) & np.isfinite(t))
    while len(on):
        k = np.floor(t[on] / BIN_S)
        speed = profiles[which[on], k.astype(np.int64) % BINS]
        ends = (k + 1) * BIN_S
        room = (ends - t[on]) * speed
        done = rest[on] <= room
        t[on] = np.where(done, t[on] + rest[on] / speed, ends)
        rest[on] = np.where(done, 0.0, rest[on] - room)
        on = on[~done]
    return t


def evaluated(function: DataFrame, at: Column) -> DataFrame:
    """Rows of arrival functions with arrival at the departure at, straight between breakpoints, flat travel time outside."""
    n = F.size("departures")
    k = F.least(F.greatest(F.size(F.filter("departures", lambda d: d <= at)), F.lit(1)), n - 1)
    x0, x1, y0, y1 = (F.get(F.col(c), k - s) for c, s in (("departures", 1), ("departures", 0), ("arrivals", 1), ("arrivals", 0)))
    inner = y0 + (y1 - y0) * (at - x0) / (x1 - x0)
    last_x, last_y = F.element_at("departures", -1), F.element_at("arrivals", -1)
    return function.withColumn("arrival", F.when(at >= last_x, at + last_y - last_x).otherwise(inner))
