"""Queries of the road, routing and traffic operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymesh.functions import geo, scalars
from waymesh.operators import geometry, graph, nearest, roads, sampling, schedules, solutions, traffic
from waymesh.plans import pipeline
from waymesh.plans.network_sql import ORACLES  # noqa: F401
from waymesh.session import cut, table
from waymesh.sources import acquire, instances, osm

SEED, CUSTOMERS, STOPS = 7, 8, 15


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return roads.latest_nodes(table(spark, sf, "osm_node"))


def _roads(spark: SparkSession, sf: str) -> DataFrame:
    return roads.roadways(roads.first_ways(table(spark, sf, "osm_way")))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return roads.paths(_roads(spark, sf), _nodes(spark, sf))


def geo_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Every node in its city's tangent frame, its distance from the middle, and the way back."""
    n = _nodes(spark, sf)
    framed = nearest.in_city_frame(n, roads.city_bounds(n)).join(roads.city_bounds(n), "city")
    y0, x0 = geo.bounds_center(*(F.col(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")))
    back = geo.lla_of_enu(F.col("east"), F.col("north"), F.col("up"), y0, x0)
    r = lambda c, k: F.round(c, k)
    return framed.select("city", "node_id", r(F.col("east"), 3).alias("east"), r(F.col("north"), 3).alias("north"), r(F.col("up"), 3).alias("up"), r(geo.haversine(F.col("lat"), F.col("lon"), y0, x0), 3).alias("metres"), r(geo.flat_metres(F.col("lon"), F.col("lat"), x0, y0), 3).alias("flat"), (F.abs(back[0] - F.col("lat")) < 1e-6).alias("same_lat"), (F.abs(back[1] - F.col("lon")) < 1e-6).alias("same_lon"))


def names_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Names, keys and seeds made of instance, solver and method."""
    s = table(spark, sf, "solution").select("instance_id", "instance_name", "solver").where("instance_id IS NOT NULL").distinct()
    return s.select("instance_id", "instance_name", "solver", scalars.slug(F.col("instance_name")).alias("slug"), scalars.sha_seed(F.col("instance_id"), F.col("solver")).cast("string").alias("seed"), scalars.short_id(F.col("instance_id"), F.col("instance_name")).alias("short_id"), F.round(scalars.uniform(SEED, "u", F.col("instance_id")), 9).alias("u"), F.round(scalars.gauss(SEED, "g", F.col("instance_id")), 6).alias("g"), scalars.edge_key(F.lit(1), F.col("instance_id")).alias("edge_key"))


def road_ways(spark: SparkSession, sf: str) -> DataFrame:
    """The ways that are roads, with class and direction."""
    return _roads(spark, sf).select("city", "way_id", "class", "one_way", "backward", F.size("nodes").cast("long").alias("n_nodes"))


def road_full_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Directed edges between neighbouring nodes."""
    return roads.full_edges(_paths(spark, sf)).select("city", "u", "v", "class", F.round("length_m", 3).alias("length_m"))


def road_class_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Edges and kilometres per city and class."""
    return roads.class_statistics(roads.full_edges(_paths(spark, sf)))


def road_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """The graph's vertices, numbered by first sight."""
    return roads.numbered(roads.full_edges(_paths(spark, sf))).select("city", "node_id", F.col("vertex").cast("long").alias("vertex"))


def road_intersections(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes where roads end or meet."""
    return roads.intersections(_paths(spark, sf))


def road_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Directed stretches between intersections."""
    p = _paths(spark, sf)
    return roads.segments(p, roads.intersections(p)).select("city", "way_id", "u", "v", "class", F.round("length_m", 3).alias("length_m"))


def road_parallel_min(spark: SparkSession, sf: str) -> DataFrame:
    """The shortest of parallel stretches."""
    p = _paths(spark, sf)
    return roads.shortest_parallel(roads.segments(p, roads.intersections(p))).select("city", "u", "v", "class", F.round("length_m", 3).alias("length_m"))


def road_crop(spark: SparkSession, sf: str) -> DataFrame:
    """Roads cut to the middle half of their city's box."""
    n = _nodes(spark, sf)
    box = roads.middle_half(roads.city_bounds(n))
    return roads.cropped(_roads(spark, sf), n, box).select("city", "way_id", F.col("seq").cast("long").alias("seq"), F.when(F.col("synthetic"), F.lit(-1)).otherwise(F.col("node_id")).cast("long").alias("node_id"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


def giant_component(spark: SparkSession, sf: str) -> DataFrame:
    """The largest strong component of each city's graph of all nodes."""
    return graph.largest_component(roads.full_edges(_paths(spark, sf)))


def road_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The trimmed road graphs between intersections, with fallbacks."""
    g = pipeline.road_graph_with_fallback(_roads(spark, sf), _nodes(spark, sf))
    return g.select("city", "u", "v", "class", F.round("length_m", 3).alias("length_m"), "only_intersections", "trim")


def _bridges(spark: SparkSession, sf: str) -> DataFrame:
    """The latest row of each bridge graph with edges, its city column holding the bridge."""
    b = table(spark, sf, "bridge_graph").where("bridge_id IS NOT NULL AND size(edges) > 0 AND size(vertices) > 0")
    one = b.groupBy("bridge_id").agg(F.max(F.struct("published_at", "osm_file", "num_bins", "bin_seconds", "edges", "vertices")).alias("b"))
    return one.select(F.col("bridge_id").cast("string").alias("city"), "b.osm_file", "b.num_bins", "b.bin_seconds", "b.edges", "b.vertices")


def _bridge_edges(b: DataFrame) -> DataFrame:
    e = b.select("city", F.inline("edges")).where("osm_u IS NOT NULL AND osm_v IS NOT NULL")
    return roads.fastest_parallel(e.select("city", F.col("osm_u").alias("u"), F.col("osm_v").alias("v"), "length_m", F.col("road_class").alias("class")), ["city"])


def _bridge_spots(b: DataFrame) -> DataFrame:
    v = b.select("city", F.inline("vertices")).where("osm_id IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL")
    return v.groupBy("city", F.col("osm_id").alias("node_id")).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))


def _places(spots: DataFrame) -> DataFrame:
    """All vertices of each bridge graph as places 0..n-1, in an order given by hash."""
    w = Window.partitionBy("city").orderBy(scalars.uniform(SEED, "place", F.col("node_id")), "node_id")
    return spots.select("city", (F.row_number().over(w) - 1).alias("i"), "node_id", "lat", "lon")


def _leg_ends(legs: DataFrame, places: DataFrame) -> DataFrame:
    """The distinct legs with source and target, the ids of their ends."""
    ids = lambda k, n: places.select("city", F.col("i").cast("long").alias(k), F.col("node_id").alias(n))
    return geometry.required_legs(legs).join(ids("from_node", "source"), ["city", "from_node"]).join(ids("to_node", "target"), ["city", "to_node"])


def collected_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The fastest representative of parallel edges of each bridge graph."""
    return _bridge_edges(_bridges(spark, sf)).select("city", "u", "v", "class", F.round("length_m", 3).alias("length_m"))


def cost_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """Shortest and fastest costs between places of each bridge graph; unreachable pairs have a null cost."""
    b = _bridges(spark, sf)
    places = _places(_bridge_spots(b))
    return pipeline.cost_tables(_bridge_edges(b), places).select("city", "metric", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "cost")


def cost_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Distances from every vertex of each bridge graph to everything it reaches, by rounds of joins."""
    b = _bridges(spark, sf)
    found = graph.distances_by_rounds(_bridge_edges(b), _bridge_spots(b).select("city", F.col("node_id").alias("source")), "length_m")
    return found.select("city", "source", "node_id", F.round("cost", 3).alias("cost"))


def euclid_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """Plain distances between places of each bridge graph, in its tangent frame."""
    spots = _bridge_spots(_bridges(spark, sf))
    places = nearest.in_city_frame(_places(spots), roads.city_bounds(spots))
    return nearest.euclid_table(places).select("city", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "cost")


def trimmed_sidecar(spark: SparkSession, sf: str) -> DataFrame:
    """The edges on fastest paths between places, re-indexed by id."""
    b = _bridges(spark, sf)
    return graph.reindexed(pipeline.trimmed_graph(_bridge_edges(b), _places(_bridge_spots(b)))).select("city", "osm_u", "osm_v", "u", "v", F.round("length_m", 3).alias("length_m"))


def _pois(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    return table(spark, sf, "poi").where(ok & F.col("poi_id").isNotNull() & F.col("city").isNotNull()).groupBy(F.col("poi_id").alias("point_id")).agg(F.min(F.struct("city", "lat", "lon")).alias("p")).select("p.city", "point_id", "p.lat", "p.lon")


def poi_snap(spark: SparkSession, sf: str) -> DataFrame:
    """Each POI's nearest road node in the 100 m box, if that node is a vertex."""
    roles = cut(roads.node_roles(_paths(spark, sf)))
    n = _nodes(spark, sf)
    box = roads.city_bounds(n)
    on = nearest.in_city_frame(roles.select("city", "node_id").join(n.select("node_id", "lat", "lon"), "node_id"), box)
    snapped = nearest.snapped(nearest.in_city_frame(_pois(spark, sf), box), on, roles.where("crossing"))
    return snapped.select("city", "point_id", "node_id", F.round(F.sqrt("d2"), 3).alias("metres"))


def _depots(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    return nearest.depots(_nodes(spark, sf), mode, SEED)


def depot_center(spark: SparkSession, sf: str) -> DataFrame:
    """The node nearest to the mean of each city's nodes."""
    return _depots(spark, sf, "center")


def depot_corner(spark: SparkSession, sf: str) -> DataFrame:
    """The node nearest to each city's south-west corner."""
    return _depots(spark, sf, "corner")


def depot_random(spark: SparkSession, sf: str) -> DataFrame:
    """A random node of each city."""
    return _depots(spark, sf, "random")


def customers_random(spark: SparkSession, sf: str) -> DataFrame:
    """Random customers of each city."""
    return sampling.random_customers(_nodes(spark, sf), CUSTOMERS, SEED).select("city", "node_id", F.col("place").cast("long").alias("place"), "source_tag")


def cluster_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The drawing weight of every node around its city's seeds."""
    n = _nodes(spark, sf)
    return sampling.cluster_weights(n, sampling.seed_points(n, 4, SEED), 800.0).select("city", "node_id", F.round("weight", 6).alias("weight"))


def customers_clustered(spark: SparkSession, sf: str) -> DataFrame:
    """Clustered customers of each city."""
    return sampling.clustered_customers(_nodes(spark, sf), CUSTOMERS, 3, 800.0, SEED).select("city", "node_id", F.col("place").cast("long").alias("place"))


def customers_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Half random, half clustered customers of each city."""
    return sampling.random_clustered_customers(_nodes(spark, sf), CUSTOMERS, 3, 800.0, SEED).select("city", "node_id", F.col("place").cast("long").alias("place"))


def customers_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Customers from snapped POIs, filled up with random nodes."""
    on = poi_snap(spark, sf).select("city", "point_id", "node_id")
    return sampling.hybrid_customers(on, _nodes(spark, sf), CUSTOMERS, 0.5, SEED).select("city", "node_id", F.col("place").cast("long").alias("place"), "source_tag")


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    """The customer table as routing customers: nation as instance, positions made of the key."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("city"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy(k)).alias("i"), (45 + (k * 7919 % 1009) * 0.0002).alias("lat"), (4 + (k * 104729 % 1013) * 0.0002).alias("lon"))


def _demand_query(kind: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return sampling.demands(_customers(spark, sf), kind, 3, SEED).select("city", F.col("i").cast("long").alias("i"), "demand")

    run.__name__, run.__doc__ = f"demand_kind_{kind}", f"Demands of kind {kind}."
    return run


def fleet_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Capacity and least number of routes of each instance."""
    return sampling.fleet(sampling.demands(_customers(spark, sf), 2, 3, SEED))


def instance_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Depot and customers of one hybrid instance per city on its trimmed road graph."""
    g = cut(pipeline.road_graph(_roads(spark, sf), _nodes(spark, sf)))
    return pipeline.instance_nodes(g, _nodes(spark, sf), _pois(spark, sf), pipeline.Request(n=10, method="hybrid")).drop("route_size")


def _stops(spark: SparkSession, sf: str) -> DataFrame:
    """Instances of a depot and up to 15 customers, with demand, capacity and made-up windows.

    Every customer is dealt: a nation's customers 1..15 are instance `nation`, the next 15 `nation-1` and so on.
    """
    k = F.floor((F.col("i") - 1) / STOPS).cast("long")
    name = F.when(k == 0, F.col("city")).otherwise(F.concat_ws("-", "city", k.cast("string")))
    c = sampling.demands(_customers(spark, sf), 2, 3, SEED).where("city IS NOT NULL").select(name.alias("city"), (F.col("i") - k * STOPS).cast("long").alias("node"), "demand")
    depot = c.select("city").distinct().select("city", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("demand"))
    n = F.col("node")
    return depot.unionByName(c).withColumns({"service": F.when(n == 0, 0).otherwise(60 + n * 37 % 300).cast("long"), "earliest": F.when(n == 0, 0).otherwise(n * 613 % 9000).cast("long"), "latest": F.when(n == 0, 86400).otherwise(n * 613 % 9000 + 7200).cast("long"), "capacity": F.lit(40).cast("long")})


def _costs(stops: DataFrame) -> DataFrame:
    """Made-up travel times between the nodes of each instance."""
    a, b = stops.select("city", F.col("node").alias("i")), stops.select("city", F.col("node").alias("j"))
    return a.join(b, "city").where("i <> j").withColumn("cost", (60 + (F.col("i") * 7919 + F.col("j") * 104729) % 1740).cast("long"))


def _runs(stops: DataFrame) -> DataFrame:
    """Two sets of routes per instance: customers dealt to three routes, and to four in another order."""
    deal = lambda run, k, order: stops.where("node > 0").groupBy("city", (F.col("node") % k).cast("int").alias("route_idx")).agg(F.array_sort(F.collect_list(F.struct((order).alias("o"), "node"))).alias("x")).select("city", F.lit(run).alias("run"), "route_idx", F.col("x.node").alias("route"))
    return deal("a", 3, F.col("node")).unionByName(deal("b", 4, F.col("node") * 7 % 16))


def arrival_times(spark: SparkSession, sf: str) -> DataFrame:
    """When each stop of each route is reached, without waiting."""
    s = _stops(spark, sf)
    a = schedules.arrivals(_runs(s), _costs(s), s)
    return a.select("city", "run", F.col("route_idx").cast("long").alias("route_idx"), F.col("leg").cast("long").alias("leg"), "node", "arrival")


def waiting_times(spark: SparkSession, sf: str) -> DataFrame:
    """When each stop is reached and served, waiting for windows to open."""
    s = _stops(spark, sf)
    a = schedules.arrivals(_runs(s), _costs(s), s, wait=True)
    return a.select("city", "run", F.col("route_idx").cast("long").alias("route_idx"), F.col("leg").cast("long").alias("leg"), "node", "arrival", "begin")


def route_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Load, lateness, cost and return of each route."""
    s = _stops(spark, sf)
    return schedules.route_checks(_runs(s), _costs(s), s).select("city", "run", F.col("route_idx").cast("long").alias("route_idx"), "load", "late_stops", "cost", "returned", "ok")


def route_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Customers missing, repeated or unknown in each run."""
    s = _stops(spark, sf)
    more = s.select("city").distinct().select("city", F.lit("a").alias("run"), F.lit(9).alias("route_idx"), F.expr("array(1L, 1L, 99L)").alias("route"))
    return schedules.coverage(_runs(s).where("NOT (run = 'b' AND route_idx = 2)").unionByName(more), s)


def nearest_tours(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest-neighbour tour of each instance."""
    return schedules.nearest_tours(_costs(_stops(spark, sf)))


def anchor_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy routes that fit capacity and horizon."""
    s = _stops(spark, sf)
    return schedules.anchor_routes(_costs(s), s)


def service_times(spark: SparkSession, sf: str) -> DataFrame:
    """Service times of each instance's nodes."""
    return schedules.service_times(_stops(spark, sf).select("city", "node"), SEED)


def _window_query(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = _stops(spark, sf)
        if kind in ("route_centered", "reachable_interval"):
            w = pipeline.vrptw(s.select("city", "node", "demand"), _costs(s), kind, SEED)
            return w.select("city", "node", "service", "earliest", "latest", "repaired")
        c = _costs(s)
        to, back = c.where("i = 0").select("city", F.col("j").alias("node"), F.col("cost").alias("to")), c.where("j = 0").select("city", F.col("i").alias("node"), F.col("cost").alias("back"))
        timed = schedules.service_times(s.select("city", "node"), SEED).join(to, ["city", "node"], "left").join(back, ["city", "node"], "left").na.fill(0, ["to", "back"])
        return schedules.family_windows(timed.withColumn("visit", F.col("to") * 3.0), kind, SEED).select("city", "node", "service", "earliest", "latest")

    run.__name__, run.__doc__ = "windows_" + kind.replace("-", "_"), f"Time windows by {kind}."
    return run


def rush_curve(spark: SparkSession, sf: str) -> DataFrame:
    """The share of the full rush by hour, and free speeds by class, for the classes of the road edges."""
    c = table(spark, sf, "road_edge").where("edge_class IS NOT NULL").select("edge_class").distinct()
    k = c.select("edge_class", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return k.select("edge_class", "hour", F.round(traffic.rush(F.col("hour")), 6).alias("rush"), F.round(traffic.free_speed(F.col("edge_class")), 6).alias("free"))


def wave_speeds(spark: SparkSession, sf: str) -> DataFrame:
    """Wave speeds of every bridge edge and hour."""
    b = _bridges(spark, sf)
    p = traffic.wave_profiles(_bridge_edges(b), _bridge_spots(b), "moderate", SEED)
    return p.select("city", "u", "v", F.posexplode("profile").alias("bin", "speed"))


def _made_flows(edges: DataFrame) -> DataFrame:
    return edges.select("city", "u", "v", F.explode(F.sequence(F.lit(6), F.lit(20))).alias("bin")).withColumn("n", ((F.col("u") * 31 + F.col("v") * 17 + F.col("bin") * 7) % 2500).cast("long"))


def volume_delay(spark: SparkSession, sf: str) -> DataFrame:
    """Speeds of every bridge edge and hour under made-up flows."""
    e = _bridge_edges(_bridges(spark, sf))
    return traffic.volume_delay_profiles(e, _made_flows(e)).select("city", "u", "v", F.posexplode("profile").alias("bin", "speed"))


def _works(spark: SparkSession, sf: str, spots: DataFrame) -> DataFrame:
    """The workplaces of each bridge graph: its vertices with a POI, or all."""
    on = cut(poi_snap(spark, sf).select("node_id").distinct())
    return cut(traffic.work_pool(spots, spots.join(on, "node_id", "left_semi")))


def commuter_trips(spark: SparkSession, sf: str) -> DataFrame:
    """A day's trips on every bridge graph."""
    spots = _bridge_spots(_bridges(spark, sf))
    return traffic.trips(spots, _works(spark, sf, spots), "light", SEED).select("city", F.col("commuter").cast("long").alias("commuter"), "home", "work", F.round("departure_s", 2).alias("departure_s"), "to_work")


def hourly_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flows of the commuters' trips by edge and hour."""
    b = _bridges(spark, sf)
    spots = _bridge_spots(b)
    return traffic.hourly_flows(pipeline.with_time(_bridge_edges(b)), traffic.trips(spots, _works(spark, sf, spots), "light", SEED))


def overlay_clamp(spark: SparkSession, sf: str) -> DataFrame:
    """Wave speeds cut to each edge's free speed."""
    b = _bridges(spark, sf)
    e = _bridge_edges(b)
    p = traffic.wave_profiles(e, _bridge_spots(b), "light", SEED)
    limited = e.select("city", "u", "v", F.round(traffic.free_speed(F.col("class")), 6).alias("limit"))
    return traffic.overlay(p, limited).select("city", "u", "v", F.posexplode("profile").alias("bin", "speed"))


def departure_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Events per hour bin of their time of day."""
    s = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, sf, "events").groupBy("event_type", traffic.clock_bin(s).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def path_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Arrival through wave traffic on the fastest paths between places, for four departures."""
    b = _bridges(spark, sf)
    e, spots = _bridge_edges(b), _bridge_spots(b)
    places = _places(spots)
    timed = pipeline.with_time(e).join(traffic.wave_profiles(e, spots, "heavy", SEED).select("city", "u", "v", "profile"), ["city", "u", "v"], "left")
    found = traffic.tree_arrivals(timed, graph.all_pairs(places), [0.0, 27000.0, 63000.0, 86000.0])
    ids = lambda k, n: places.select("city", F.col("node_id").alias(n), F.col("i").cast("long").alias(k))
    named = found.join(ids("i", "source"), ["city", "source"]).join(ids("j", "target"), ["city", "target"])
    return named.select("city", "i", "j", "departure", F.round("arrival", 3).alias("arrival"))


def deadline_lift(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of places raised until a tour through them keeps them under two intensities of traffic."""
    b = _bridges(spark, sf)
    e, spots = _bridge_edges(b), _bridge_spots(b)
    places = _places(spots)
    tour = places.where("i > 0").groupBy("city").agg(F.array_sort(F.collect_list("i")).alias("route")).select("city", F.lit("t").alias("run"), F.lit(0).alias("route_idx"), "route")
    stops = places.select("city", F.col("i").alias("node"), F.lit(120).alias("service"), F.lit(0).alias("earliest"), (F.col("i") * 60).cast("long").alias("latest"))
    need = _leg_ends(schedules.legs(tour), places)
    needs = None
    for k, intensity in enumerate(("light", "heavy")):
        driven = pipeline.audit(tour, pipeline.timed_paths(e, traffic.wave_profiles(e, spots, intensity, SEED), places, need), stops)
        part = driven.select("city", "node", "begin", F.lit(intensity).alias("sub"), F.lit(k).alias("sub_pos"))
        needs = part if needs is None else needs.unionByName(part)
    return schedules.lifted_windows(needs, stops).select("city", "node", "latest", "lift", "worst")


def route_polylines(spark: SparkSession, sf: str) -> DataFrame:
    """Road polylines of a tour through the places of each bridge graph, with their fallbacks."""
    b = _bridges(spark, sf)
    spots, places = _bridge_spots(b), _places(_bridge_spots(b))
    tour = places.where("i > 0").groupBy("city").agg(F.array_sort(F.collect_list("i")).alias("route")).select("city", F.lit("t").alias("run"), F.lit(0).alias("route_idx"), "route")
    legs = schedules.legs(tour)
    need = _leg_ends(legs, places)
    found = graph.shortest_paths(_bridge_edges(b), need, "length_m", with_paths=True)
    lines = geometry.polylines(found, spots).join(need, ["city", "source", "target"]).select("city", "from_node", "to_node", F.lit(1).alias("rank"), "line")
    done = geometry.materialized(need.select("city", "from_node", "to_node"), lines, places.select("city", F.col("i").cast("long").alias("node"), "lon", "lat"))
    return geometry.route_lines(legs, done).select("city", "run", "mode", F.size("line").alias("points"))


def solution_legs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct directed edges of each recorded run, the depot's included."""
    return solutions.route_edges(solutions.customer_routes(solutions.runs_once(table(spark, sf, "solution"))))


def solution_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Load of each route with a made-up demand per customer."""
    r = solutions.customer_routes(solutions.runs_once(table(spark, sf, "solution")))
    d = r.select("instance_id", F.explode("route").alias("node")).distinct().withColumn("demand", (1 + F.col("node") * 7 % 20).cast("long"))
    return solutions.loads(r, d).select("run_id", F.col("route_idx").cast("long").alias("route_idx"), "load", "stops")


def solution_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Each valid run against the best of its instance, objective and metric."""
    runs = solutions.runs_once(table(spark, sf, "solution"))
    return solutions.compared(runs, solutions.best_references(runs))


def solution_recent(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty latest runs."""
    return solutions.recent(solutions.runs_once(table(spark, sf, "solution")), 50).select("run_id", "instance_id", "objective_function")


def fetch_tiles_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The tiles that cover each city's box."""
    b = roads.city_bounds(_nodes(spark, sf))
    return acquire.tiles(b, acquire.ROAD_TILE).select("city", "tile", *(F.round(c, 9).alias(c) for c in ("south", "west", "north", "east")))


def dedup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The last delivered row of each node id."""
    n = table(spark, sf, "osm_node").where("id IS NOT NULL").withColumn("o", F.struct("fetched_at", "tile", "lat", "lon"))
    return osm.deduplicated(n, "id", "o", "last").select("id", "tile", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("seen_at"))


def dedup_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The first delivered row of each way id."""
    w = table(spark, sf, "osm_way").where("id IS NOT NULL").withColumn("o", F.struct("fetched_at", "city"))
    return osm.deduplicated(w, "id", "o", "first").select("id", "city", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("seen_at"))


def upsert_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """POIs merged into the nodes by id modulo: replaced ones and added ones."""
    base = _nodes(spark, sf).select((F.col("node_id") - 10000000000).alias("id"), "lat", "lon")
    come = _pois(spark, sf).select((F.col("point_id") - 100000000).alias("id"), "lat", "lon")
    return osm.merged(base, come)


def bridge_files(spark: SparkSession, sf: str) -> DataFrame:
    """Bridge graphs written as JSON and read back, with the rule each breaks."""
    b = _bridges(spark, sf)
    back = instances.read_graphs(instances.graph_json(b))
    return back.select("city", F.size("edges").alias("n_edges"), F.size("vertices").alias("n_vertices"), "problem")


def instance_files(spark: SparkSession, sf: str) -> DataFrame:
    """Instances written as texts and read back."""
    s = _stops(spark, sf)
    c = s.select("city", F.col("node").alias("i"), F.col("node").cast("double").alias("x"), (F.col("node") * 2).cast("double").alias("y"), "demand")
    made = instances.gathered(c, _costs(s), s.select("city", "capacity").distinct())
    back = instances.parsed(instances.instance_text(made).select(F.col("name").alias("path"), "value"))
    return back.select("name", "dimension", "capacity", F.aggregate(F.flatten("costs"), F.lit(0.0), lambda a, x: a + x).alias("cost_sum"), F.aggregate("demands", F.lit(0).cast("long"), lambda a, x: a + x).alias("demand_sum"))


def bulk_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes, demand and arcs of every slice of each instance's pool."""
    s = _stops(spark, sf)
    places = s.select("city", F.col("node").cast("int").alias("i"), F.col("node").alias("node_id"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    nodes, costs = pipeline.bulk_slices(_costs(s), places, [5, 10], [1, 2], [2], SEED)
    n = nodes.groupBy("city", "slice").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("demand").alias("demand"))
    a = costs.groupBy("city", "slice").agg(F.count(F.lit(1)).alias("n_arcs"), F.sum("cost").alias("cost"))
    return n.join(a, ["city", "slice"])


def zone_features(spark: SparkSession, sf: str) -> DataFrame:
    """The POIs of each city as GeoJSON."""
    return geometry.feature_collection(_pois(spark, sf), ["city"], ["point_id"])


QUERIES = {
    f.__name__: f
    for f in (
        geo_frames, names_seeds, road_ways, road_full_edges, road_class_stats, road_vertices, road_intersections, road_segments, road_parallel_min, road_crop, giant_component, road_graph, collected_edges, cost_matrices,
        cost_rounds, euclid_matrices, trimmed_sidecar, poi_snap, depot_center, depot_corner, depot_random, customers_random, cluster_weights, customers_clustered, customers_mixed, customers_hybrid, *map(_demand_query, range(1, 8)),
        fleet_sizes, instance_nodes, arrival_times, waiting_times, route_checks, route_coverage, nearest_tours, anchor_routes, service_times, *map(_window_query, schedules.WIDTHS), rush_curve, wave_speeds, volume_delay,
        commuter_trips, hourly_flows, overlay_clamp, departure_bins, path_arrivals, deadline_lift, route_polylines, solution_legs, solution_loads, solution_compare, solution_recent, fetch_tiles_plan, dedup_last_wins,
        dedup_first_wins, upsert_nodes, bridge_files, instance_files, bulk_slices, zone_features,
    )
}
