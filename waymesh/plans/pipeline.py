"""Whole chains: road graphs with fallbacks, instances of a city, time windows, traffic twins, bulk slices."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.functions.arrays import neighbours
from waymesh.functions.scalars import FREE_KMH, lookup
from waymesh.operators import graph, nearest, roads, sampling, schedules, traffic
from waymesh.session import cut


@dataclass(frozen=True)
class Options:
    """How a road graph is built: edges between intersections only, and only the largest strong component."""

    only_intersections: bool = True
    trim: bool = True


#: The order in which options are tried where the wanted ones give nothing.
FALLBACKS = (Options(True, True), Options(True, False), Options(False, True), Options(False, False))


def road_graph(road_ways: DataFrame, nodes: DataFrame, options: Options = Options()) -> DataFrame:
    """Edges (city, u, v, class, length_m, first_pos) of every city's road graph; roads as of roads.roadways.

    Trimming finds the component on the graph of all nodes, removes the other nodes from the roads, which makes their neighbours
    adjacent, and builds again at the wanted granularity.
    """
    pathed = roads.paths(road_ways, nodes)
    if options.trim:
        pathed = cut(pathed)
        full = roads.full_edges(pathed)
        ends = full.select("city", F.explode(F.array("u", "v")).alias("node_id")).distinct()
        removed = cut(ends.join(graph.largest_component(full), ["city", "node_id"], "left_anti"))
        pathed = roads.without(pathed, removed)
    if not options.only_intersections:
        return roads.full_edges(pathed)
    return roads.shortest_parallel(roads.segments(pathed, roads.intersections(pathed)))


def road_graph_with_fallback(road_ways: DataFrame, nodes: DataFrame, wanted: Options = Options()) -> DataFrame:
    """road_graph with only_intersections and trim columns: each city has the first options, in order, that give it an edge."""
    out, rest = None, road_ways
    for o in dict.fromkeys((wanted, *FALLBACKS)):
        edges = cut(road_graph(rest, nodes, o).withColumns({"only_intersections": F.lit(o.only_intersections), "trim": F.lit(o.trim)}))
        out = edges if out is None else out.unionByName(edges)
        rest = cut(rest.join(edges.select("city").distinct(), "city", "left_anti"))
        if rest.isEmpty():
            break
    return out


def candidate_options(o: Options) -> tuple[Options, ...]:
    """Graphs to try for geometry, best first, each once."""
    return tuple(dict.fromkeys((o, replace(o, only_intersections=False), replace(o, trim=False), Options(False, False))))


def with_time(edges: DataFrame) -> DataFrame:
    """Edges with time, seconds at free speed."""
    return edges.withColumn("time", F.col("length_m") * 3.6 / lookup(FREE_KMH, F.col("class")))


@dataclass(frozen=True)
class Request:
    """What instances to draw: one per city."""

    n: int = 20
    method: str = "parametric"  # parametric, poi or hybrid
    customer_mode: str = "random"  # random, clustered or random_clustered
    depot_mode: str = "center"  # center, corner or random
    demand_kind: int = 2
    route_band: int = 2
    n_seeds: int = 4
    decay_m: float = 800.0
    poi_share: float = 0.5
    seed: int = 7
    strict: bool = False  # a city that gives fewer than n customers is an error

    def __post_init__(self):
        if self.n < 1 or self.method not in ("parametric", "poi", "hybrid") or self.customer_mode not in ("random", "clustered", "random_clustered") or self.depot_mode not in ("center", "corner", "random"):
            raise ValueError(f"bad request {self}")
        if not (1 <= self.demand_kind <= 7 and 1 <= self.route_band <= 7 and self.n_seeds >= 1 and self.decay_m > 0 and 0 <= self.poi_share <= 1):
            raise ValueError(f"bad request {self}")


def vertices_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(city, node_id, lat, lon) of the graph's vertices."""
    ends = edges.select("city", F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return ends.join(nodes.select("node_id", "lat", "lon"), "node_id").select("city", "node_id", "lat", "lon")


def instance_nodes(edges: DataFrame, nodes: DataFrame, pois: DataFrame, r: Request) -> DataFrame:
    """(city, i, node_id, lat, lon, demand, source_tag, route_size): depot 0 and customers 1..n of each city; pois: city, point_id, lat, lon.

    Customers from points that fall on the depot drop out; missing ones are filled up with further vertices.
    """
    verts = cut(vertices_of(edges, nodes))
    depot = cut(nearest.depots(verts, r.depot_mode, r.seed))
    free = verts.join(depot, ["city", "node_id"], "left_anti")
    if r.method == "parametric":
        drawn = {
            "random": lambda: sampling.random_customers(free, r.n, r.seed),
            "clustered": lambda: sampling.clustered_customers(free, r.n, r.n_seeds, r.decay_m, r.seed),
            "random_clustered": lambda: sampling.random_clustered_customers(free, r.n, r.n_seeds, r.decay_m, r.seed),
        }[r.customer_mode]()
    else:
        box = roads.city_bounds(nodes)
        on = nearest.snapped(nearest.in_city_frame(pois, box), nearest.in_city_frame(nodes, box), free)
        drawn = sampling.hybrid_customers(on, free, r.n, 1.0 if r.method == "poi" else r.poi_share, r.seed)
    if r.strict:
        drawn = sampling.required(drawn, r.n)
    customers = drawn.select("city", "node_id", F.col("place").alias("i"), "source_tag").join(verts, ["city", "node_id"])
    sized = sampling.demands(customers, r.demand_kind, r.route_band, r.seed)
    first = depot.join(verts, ["city", "node_id"]).select("city", F.lit(0).alias("i"), "node_id", "lat", "lon", F.lit(0).cast("long").alias("demand"), F.lit("depot").alias("source_tag"), F.lit(None).cast("double").alias("route_size"))
    return first.unionByName(sized.select("city", "i", "node_id", "lat", "lon", "demand", "source_tag", "route_size"))


def cost_tables(edges: DataFrame, places: DataFrame, metrics: tuple[str, ...] = ("shortest", "fastest"), rounding: str = "ceil") -> DataFrame:
    """(city, metric, i, j, cost) between the places (city, i, node_id); an unreachable pair has a null cost."""
    timed = with_time(edges)
    pairs = graph.all_pairs(places)
    a, b = (places.select("city", F.col("node_id").alias(n), F.col("i").alias(k)) for n, k in (("source", "i"), ("target", "j")))
    out = None
    for m in metrics:
        found = graph.shortest_paths(timed, pairs, {"shortest": "length_m", "fastest": "time"}[m])
        part = found.join(a, ["city", "source"]).join(b, ["city", "target"]).select("city", F.lit(m).alias("metric"), "i", "j", nearest.rounded_cost(F.col("cost"), rounding).alias("cost"))
        out = part if out is None else out.unionByName(part)
    return out


def pool_request(r: Request, sizes: list[int]) -> Request:
    """The request that draws the pool of bulk slices: half as many customers again as the largest slice has."""
    return replace(r, n=-(-3 * max(sizes) // 2))


def bulk_slices(costs: DataFrame, places: DataFrame, sizes: list[int], kinds: list[int], bands: list[int], seed: int) -> tuple[DataFrame, DataFrame]:
    """Instances of every size, demand kind and route band out of one pool per city, whose costs are computed once.

    Returns (nodes, costs) keyed by city and slice; the slice names size, kind, band and seed, so no two overwrite each other.
    """
    spark = places.sparkSession
    combos = spark.createDataFrame([(n, k, b, f"n{n}-d{k}-r{b}-s{seed}") for n in sizes for k in kinds for b in bands], "n int, kind int, band int, slice string")
    parts = None
    for k in kinds:
        for b in bands:
            d = sampling.demands(places.where("i > 0"), k, b, seed).select("city", "i", "node_id", "demand", F.lit(k).alias("kind"), F.lit(b).alias("band"))
            parts = d if parts is None else parts.unionByName(d)
    depot = places.where("i = 0").select("city", "i", "node_id", F.lit(0).cast("long").alias("demand")).crossJoin(F.broadcast(combos.select("slice")))
    nodes = parts.join(F.broadcast(combos), ["kind", "band"]).where("i <= n").select("city", "i", "node_id", "demand", "slice").unionByName(depot)
    a, b = (nodes.select("city", "slice", F.col("i").alias(x)) for x in "ij")
    return nodes, costs.join(a, ["city", "i"]).join(b, ["city", "slice", "j"])


def vrptw(nodes: DataFrame, costs: DataFrame, method: str, seed: int) -> DataFrame:
    """nodes (city, node, demand) with service, earliest, latest, repaired by the method, over costs (city, i, j, cost in seconds)."""
    to = costs.where("i = 0").select("city", F.col("j").alias("node"), F.col("cost").alias("to"))
    back = costs.where("j = 0").select("city", F.col("i").alias("node"), F.col("cost").alias("back"))
    timed = schedules.service_times(nodes, seed).join(to, ["city", "node"], "left").join(back, ["city", "node"], "left").na.fill(0, ["to", "back"])
    if method == "route_centered":
        tour = schedules.nearest_tours(costs).select("city", F.lit("tour").alias("run"), F.lit(0).alias("route_idx"), "route")
        stops = timed.select("city", "node", "service", F.lit(0).alias("earliest"), F.lit(86400).alias("latest"))
        seen = schedules.arrivals(tour, costs, stops).where("node <> 0").select("city", "node", "arrival")
        timed = timed.join(seen, ["city", "node"], "left")
    return schedules.windows(timed, method, seed)


def bridge(edges: DataFrame, vertices: DataFrame, model: str, intensity: str, seed: int, snapped: DataFrame | None = None) -> DataFrame:
    """edges (city, u, v, class, length_m) with the 24 speeds of a traffic model: wave or bpr.

    snapped: city, node_id of the points of interest, the workplaces of bpr (traffic.work_pool); without it all vertices are.
    """
    s = 101 * (("bpr", "wave").index(model) + 1) + 10007 * (("light", "moderate", "heavy").index(intensity) + 1) + seed
    clean = roads.fastest_parallel(edges, ["city"])
    if model == "wave":
        return traffic.wave_profiles(clean, vertices, intensity, s)
    works = vertices if snapped is None else traffic.work_pool(vertices, snapped)
    day = traffic.trips(vertices, works, intensity, s)
    return traffic.volume_delay_profiles(clean, traffic.hourly_flows(with_time(clean), day))


def trimmed_graph(edges: DataFrame, places: DataFrame) -> DataFrame:
    """The edges on some fastest path between the places; distances between them are those of the whole graph."""
    paths = graph.shortest_paths(with_time(edges), graph.all_pairs(places), "time", with_paths=True)
    return edges.join(graph.used_edges(paths), ["city", "u", "v"], "left_semi")


def trim_differences(edges: DataFrame, trimmed: DataFrame, places: DataFrame) -> DataFrame:
    """(city, source, target, whole, part): pairs of places whose time differs between the graph and the trimmed one; none, or it was cut wrongly."""
    pairs = graph.all_pairs(places)
    time = lambda e, n: graph.shortest_paths(with_time(e), pairs, "time").withColumnRenamed("cost", n)
    both = time(edges, "whole").join(time(trimmed, "part"), ["city", "source", "target"], "left")
    return both.where(~F.col("whole").eqNullSafe(F.col("part"))).select("city", "source", "target", "whole", "part")


def candidate_lines(road_ways: DataFrame, nodes: DataFrame, need: DataFrame, wanted: Options = Options(), metric: str = "length_m") -> DataFrame:
    """Ranked lines (city, from_node, to_node, rank, line) of legs (city, from_node, to_node, source, target) on each candidate graph in turn.

    A later graph is only built for the legs that no earlier one gives a line.
    """
    from waymesh.operators import geometry

    need = cut(need)
    out, open_ = None, need
    for rank, o in enumerate(candidate_options(wanted)):
        edges = road_graph(road_ways.join(open_.select("city").distinct(), "city", "left_semi"), nodes, o)
        paths = graph.shortest_paths(with_time(edges), open_, metric, with_paths=True)
        spots = nodes.select("city", "node_id", "lon", "lat")
        found = cut(geometry.polylines(paths, spots).join(open_, ["city", "source", "target"]).select("city", "from_node", "to_node", F.lit(rank).alias("rank"), "line"))
        out = found if out is None else out.unionByName(found)
        open_ = cut(open_.join(found.select("city", "from_node", "to_node"), ["city", "from_node", "to_node"], "left_anti"))
        if open_.isEmpty():
            break
    return out


def timed_paths(edges: DataFrame, profiles: DataFrame, places: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(city, i, j, steps): the fastest free-flow path of each pair with every edge's length and speeds, in order.

    pairs (city, source, target) are those wanted, else all pairs of places. A path over an edge without length or profile is left out.
    """
    paths = graph.shortest_paths(with_time(edges), graph.all_pairs(places) if pairs is None else pairs, "time", with_paths=True).where("path IS NOT NULL")
    pair = neighbours(F.col("path"), "u", "v")
    steps = paths.select("city", "source", "target", (F.size("path") - 1).alias("_n"), F.posexplode(pair).alias("pos", "e")).select("city", "source", "target", "_n", "pos", "e.u", "e.v")
    known = steps.join(edges.select("city", "u", "v", "length_m"), ["city", "u", "v"]).join(profiles.select("city", "u", "v", "profile"), ["city", "u", "v"])
    per = known.groupBy("city", "source", "target", "_n").agg(F.array_sort(F.collect_list(F.struct("pos", "length_m", "profile"))).alias("steps")).where(F.size("steps") == F.col("_n"))
    a, b = (places.select("city", F.col("node_id").alias(n), F.col("i").alias(k)) for n, k in (("source", "i"), ("target", "j")))
    return per.join(a, ["city", "source"]).join(b, ["city", "target"]).select("city", "i", "j", "steps")


def audit(routes: DataFrame, arcs: DataFrame, stops: DataFrame) -> DataFrame:
    """(city, run, route_idx, leg, node, arrival, begin): routes driven through traffic, waiting for windows to open.

    routes: city, run, route_idx, route; arcs: timed_paths(); stops: city, node, service, earliest.
    """
    legs = schedules.legs(routes)
    a = arcs.select("city", F.col("i").alias("from_node"), F.col("j").alias("to_node"), "steps")
    s = stops.select("city", F.col("node").alias("to_node"), "service", "earliest")
    joined = legs.join(a, ["city", "from_node", "to_node"]).join(s, ["city", "to_node"], "left")
    item = F.struct("leg", F.col("to_node").alias("node"), "steps", F.coalesce("service", F.lit(0)).cast("double").alias("service"), F.coalesce("earliest", F.lit(0)).cast("double").alias("earliest"))
    per = joined.groupBy("city", "run", "route_idx").agg(F.array_sort(F.collect_list(item)).alias("legs"))

    def drive(state, x):
        at = F.aggregate(x["steps"], state["clock"], lambda t, e: traffic.through(t, e["length_m"], e["profile"]))
        begin = F.greatest(at, x["earliest"])
        return F.struct((begin + x["service"]).alias("clock"), F.concat(state["seen"], F.array(F.struct(x["leg"].alias("leg"), x["node"].cast("bigint").alias("node"), at.alias("arrival"), begin.alias("begin")))).alias("seen"))

    zero = F.struct(F.lit(0.0).alias("clock"), F.array().cast("array<struct<leg: int, node: bigint, arrival: double, begin: double>>").alias("seen"))
    return per.select("city", "run", "route_idx", F.inline(F.aggregate("legs", zero, drive, lambda s: s["seen"])))
