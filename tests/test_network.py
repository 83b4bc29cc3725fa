"""Road graphs, paths, schedules, traffic and geometry against brute force and hand-made cases."""

import random
from datetime import datetime
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymesh.functions import geo, scalars
from waymesh.operators import geometry, graph, nearest, roads, sampling, schedules, solutions, traffic
from waymesh.plans import pipeline

DAY = datetime(2025, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def town(spark):
    """Nodes on a line and a square, with a loop, a reversed street, a roundabout, an island and things that are no roads."""
    spots = {1: (50.0, 4.0), 2: (50.0, 4.001), 3: (50.0, 4.002), 4: (50.0, 4.003), 5: (50.001, 4.002), 6: (50.001, 4.001), 7: (50.002, 4.0), 8: (50.01, 4.01), 9: (50.01, 4.011), 10: (50.02, 4.02)}
    n = [(i, y, x, "t", True, DAY) for i, (y, x) in spots.items()] + [(10, 50.02, 4.02, "t", False, datetime(2025, 2, 1)), (11, None, 4.0, "t", True, DAY), (None, 1.0, 1.0, "t", True, DAY)]
    w = [
        (100, [1, 2, 3, 4], {"highway": "residential"}), (101, [2, 6, 5, 2, 7], {"highway": "primary"}), (102, [4, 1], {"highway": "service", "oneway": "-1"}), (103, [3, 5], {"highway": "tertiary", "junction": "roundabout"}),
        (104, [8, 9], {"highway": "residential"}), (105, [1, 5], {"highway": "footway"}), (106, [1, 6], {"highway": "residential", "visible": "false"}), (107, [7, None, 99, 10, 1], {"highway": "motorway", "oneway": "no"}), (108, None, {"highway": "road"}), (109, [], None),
    ]
    nodes = roads.latest_nodes(spark.createDataFrame(n, "id long, lat double, lon double, city string, visible boolean, fetched_at timestamp_ntz"))
    ways = roads.first_ways(spark.createDataFrame([(*x, "t", DAY) for x in w] + [(100, [1, 4], {"highway": "trunk"}, "t", datetime(2025, 3, 1))], "id long, nodes array<long>, tags map<string, string>, city string, fetched_at timestamp_ntz"))
    return nodes.cache(), ways.cache(), roads.roadways(ways).cache()


def test_roadways(town):
    nodes, _, road = town
    assert nodes.count() == 9
    assert {(r.way_id, r["class"], r.one_way, r.backward) for r in road.collect()} == {(100, 6, False, False), (101, 3, False, False), (102, 7, True, True), (103, 5, True, False), (104, 6, False, False), (107, 1, False, False)}


def test_edges_and_segments(town):
    nodes, _, road = town
    p = roads.paths(road, nodes)
    full = {(r.u, r.v): r["class"] for r in roads.full_edges(p).collect()}
    two_way = [(1, 2), (2, 3), (3, 4), (2, 6), (6, 5), (5, 2), (2, 7), (8, 9), (7, 1)]
    assert set(full) == {*two_way, *((b, a) for a, b in two_way), (1, 4), (3, 5)} and full[1, 4] == 7
    cross = {r.node_id for r in roads.intersections(p).collect()}
    assert cross == {1, 2, 3, 4, 5, 7, 8, 9}
    seg = roads.segments(p, roads.intersections(p)).collect()
    assert {(r.u, r.v) for r in seg if r.way_id == 101} == {(2, 5), (5, 2), (2, 7), (7, 2)}
    best = {(r.u, r.v): r.length_m for r in roads.shortest_parallel(roads.segments(p, roads.intersections(p))).collect()}
    assert best[3, 4] == pytest.approx(71.7, abs=1)
    numbers = {r.node_id: r.vertex for r in roads.numbered(roads.full_edges(p)).collect()}
    assert numbers[1] == 0 and numbers[2] == 1 and sorted(numbers.values()) == list(range(len(numbers)))


def test_loop_runs_on(spark):
    """A loop back to where the stretch began does not end it; its length goes into the next stretch."""
    n = spark.createDataFrame([("t", i, 50.0 + (i % 3) * 0.001, 4.0 + i * 0.001) for i in range(1, 6)], "city string, node_id long, lat double, lon double")
    w = spark.createDataFrame([("t", 1, [1, 2, 3, 1, 4], 6, True, False), ("t", 2, [1, 5], 6, True, False)], "city string, way_id long, nodes array<long>, class int, one_way boolean, backward boolean")
    p = roads.paths(w, n)
    seg = [r for r in roads.segments(p, roads.intersections(p)).collect() if r.way_id == 1]
    full = {(r.u, r.v): r.length_m for r in roads.full_edges(p).collect()}
    assert [(r.u, r.v) for r in seg] == [(1, 4)] and seg[0].length_m == pytest.approx(sum(full[e] for e in pairwise([1, 2, 3, 1, 4])))


def test_trimmed_graph_and_fallback(town):
    nodes, _, road = town
    g = {(r.u, r.v) for r in pipeline.road_graph(road, nodes).collect()}
    assert all(8 not in e and 9 not in e for e in g) and (3, 5) in g and (1, 4) in g
    assert {(r.only_intersections, r.trim) for r in pipeline.road_graph_with_fallback(road, nodes).collect()} == {(True, True)}
    assert pipeline.candidate_options(pipeline.Options()) == tuple(pipeline.Options(a, b) for a, b in ((True, True), (False, True), (True, False), (False, False)))


def test_crop(spark):
    n = spark.createDataFrame([("t", 1, 0.5, 0.5), ("t", 2, 0.5, 1.5), ("t", 3, 0.5, 2.5), ("t", 4, 0.5, 0.9), ("t", 5, 1.0, 0.5), ("t", 6, 1.5, 0.5), ("t", 7, 1.5, 0.7)], "city string, node_id long, lat double, lon double")
    w = spark.createDataFrame([("t", 1, [1, 2, 3, 2, 4]), ("t", 2, [2, 3]), ("t", 3, [5, 6, 7]), ("t", 4, [1, 4]), ("t", 5, [1, 6, 4])], "city string, way_id long, nodes array<long>")
    box = spark.createDataFrame([("t", 0.0, 0.0, 1.0, 1.0)], "city string, min_lat double, min_lon double, max_lat double, max_lon double")
    got = roads.cropped(w, n, box).orderBy("way_id", "seq").collect()
    shape = {k: [(r.node_id if not r.synthetic else None, r.lat, r.lon) for r in got if r.way_id == k] for k in (1, 2, 3, 4, 5)}
    assert shape[1] == [(1, 0.5, 0.5), (None, 0.5, 1.0), (None, 0.5, 1.0), (4, 0.5, 0.9)] and shape[2] == [] and shape[3] == [(5, 1.0, 0.5)]
    assert shape[4] == [(1, 0.5, 0.5), (4, 0.5, 0.9)] and [x[:2] for x in shape[5]] == [(1, 0.5), (None, 1.0), (4, 0.5)]


def brute_component(edges):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set())

    def reach(s):
        seen, todo = {s}, [s]
        while todo:
            for w in adj[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    r = {v: reach(v) for v in adj}
    parts = {frozenset(w for w in r[v] if v in r[w]) for v in adj}
    return min(parts, key=lambda p: (-len(p), min(p)))


def random_graphs(seed, n, m):
    r = random.Random(seed)
    return {c: [(r.randrange(n), r.randrange(n)) for _ in range(m)] for c in ("a", "b")}


@pytest.mark.parametrize("limit", [10_000, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_largest_component(spark, seed, limit):
    gs = random_graphs(seed, 14, 20)
    df = spark.createDataFrame([(c, u, v) for c, es in gs.items() for u, v in es] + [("a", None, 1)], "city string, u long, v long")
    got = {}
    for c, v in rows(graph.largest_component(df, limit)):
        got.setdefault(c, set()).add(v)
    assert got == {c: set(brute_component(es)) for c, es in gs.items()}


def brute_costs(edges, n):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for u, v, w in edges:
        d[u, v] = min(d[u, v], w)
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    return d


def test_shortest_paths(spark):
    r = random.Random(3)
    gs = {c: [(r.randrange(15), r.randrange(15), r.choice([0.0, 1.0, 2.5, 7.0])) for _ in range(40)] for c in ("a", "b")}
    edges = spark.createDataFrame([(c, *e) for c, es in gs.items() for e in es] + [("a", 1, 2, None), ("a", 1, 3, -1.0)], "city string, u long, v long, w double")
    pairs = spark.createDataFrame([(c, s, t) for c in gs for s in range(15) for t in range(15)] + [("a", 0, 1), ("a", None, 1)], "city string, source long, target long")
    got = graph.shortest_paths(edges, pairs, "w", with_paths=True, sources_per_task=4).collect()
    d = {c: brute_costs(es, 15) for c, es in gs.items()}
    least = {(c, u, v): min(w for a, b, w in es if (a, b) == (u, v)) for c, es in gs.items() for u, v, _ in es}
    assert len(got) == 2 * 225
    for x in got:
        want = d[x.city][x.source, x.target]
        assert (x.cost is None and np.isinf(want)) or x.cost == pytest.approx(want)
        if x.cost is not None:
            assert x.path[0] == x.source and x.path[-1] == x.target and sum(least[x.city, a, b] for a, b in pairwise(x.path)) == pytest.approx(want)
    again = graph.shortest_paths(edges, pairs, "w", with_paths=True, max_edges=0).collect()
    assert {(x.city, x.source, x.target): x.cost for x in again} == {(x.city, x.source, x.target): x.cost for x in got} and all(x.cost is None or sum(least[x.city, a, b] for a, b in pairwise(x.path)) == pytest.approx(x.cost) for x in again)
    far = {(x.city, x.source, x.node_id): x.cost for x in graph.distances_by_rounds(edges, spark.createDataFrame([("a", 0), ("b", 5)], "city string, source long"), "w").collect()}
    assert far == {(c, s, t): d[c][s, t] for c, s in (("a", 0), ("b", 5)) for t in range(15) if np.isfinite(d[c][s, t])}


def test_trimming_keeps_distances(spark):
    r = random.Random(8)
    es = [("a", u, (u + k) % 12, 6, float(r.randint(1, 90)), 0) for u in range(12) for k in (1, 3, 5)]
    edges = spark.createDataFrame(es, "city string, u long, v long, class int, length_m double, first_pos int")
    places = spark.createDataFrame([("a", i, v) for i, v in enumerate((0, 4, 7))], "city string, i int, node_id long")
    small = pipeline.trimmed_graph(edges, places)
    assert small.count() < len(es) and rows(pipeline.cost_tables(small, places)) == rows(pipeline.cost_tables(edges, places))
    again = graph.reindexed(small).collect()
    ids = sorted({x.osm_u for x in again} | {x.osm_v for x in again})
    assert all(ids[x.u] == x.osm_u and ids[x.v] == x.osm_v for x in again)


def test_nearest_in_box(spark):
    pts = spark.createDataFrame([("t", 1, 0.0, 0.0), ("t", 2, 1000.0, 0.0), ("t", 3, -5000.0, 0.0), ("u", 1, 0.0, 0.0)], "city string, point_id long, east double, north double")
    nd = spark.createDataFrame([("t", 10, 72.0, 72.0), ("t", 11, 0.0, 101.0), ("t", 20, 1099.0, 99.0), ("t", 21, 1030.0, 10.0), ("t", 22, 970.0, -10.0)], "city string, node_id long, east double, north double")
    assert [(r[0], r[1], r[2]) for r in rows(nearest.nearest_in_box(pts, nd))] == [("t", 1, 10), ("t", 2, 21)]
    only = spark.createDataFrame([("t", 20), ("t", 10)], "city string, node_id long")
    assert [r.point_id for r in nearest.snapped(pts, nd, only).collect()] == [1]


def test_geodesy(spark):
    df = spark.createDataFrame([(48.1, -1.7, 48.2, -1.6), (-33.0, 179.999, -33.001, -179.999)], "a double, b double, c double, d double")
    e = geo.enu(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    back = geo.lla_of_enu(*e, F.col("c"), F.col("d"))
    mid = geo.bounds_center(F.col("c"), F.col("b"), F.col("a"), F.col("d"))
    out = df.select(F.abs(back[0] - F.col("a")).alias("y"), F.abs(back[1] - F.col("b")).alias("x"), F.hypot(e[0], e[1]).alias("flat"), geo.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("h"), mid[1].alias("m")).collect()
    assert all(r.y < 1e-9 and r.x < 1e-9 and r.flat == pytest.approx(r.h, rel=0.01) for r in out) and abs(out[1].m) == pytest.approx(180.0)


def test_scalars(spark):
    import hashlib
    import zlib

    df = spark.createDataFrame([("  São Luís--1 ",), ("!!",)], "x string")
    out = df.select(scalars.slug(F.col("x")), scalars.crc_seed(F.lit("a"), F.lit("tw")), scalars.sha_seed(F.lit("a"), F.lit(3)), scalars.bridge_seed(5, "wave", "heavy"), scalars.short_id(F.lit("p"), F.lit("b"))).collect()
    assert [r[0] for r in out] == ["s_o_lu_s_1", "x"] and out[0][1] == zlib.crc32(b"a|tw") and int(out[0][2]) == int.from_bytes(hashlib.sha256(b"a\x1f3").digest()[:8]) and out[0][3] == 5 + 202 + 30021
    assert out[0][4] == hashlib.sha256(b"p\0b").hexdigest()[:20]
    w = spark.createDataFrame([(0, 100, 500, 300, 10), (90000, 95000, 500, 300, 10), (0, 1, 80000, 80000, 10), (400, 700, 500, 300, 10)], "s long, e long, t long, b long, v long")
    got = [tuple(r.w) for r in w.select(scalars.repaired_window(*(F.col(c) for c in "setbv")).alias("w")).collect()]
    assert got == [(500, 86090), (500, 86090), (43195, 43195), (500, 700)]


def test_sampling_is_stable_and_in_bands(spark):
    c = spark.createDataFrame([("t", i, 45 + (i * 37 % 11) * 0.01, 4 + (i * 53 % 13) * 0.01) for i in range(1, 61)], "city string, i long, lat double, lon double")
    bands = {1: (1, 1), 2: (1, 10), 3: (5, 10), 4: (1, 100), 5: (50, 100), 6: (1, 100), 7: (1, 100)}
    for kind, (lo, hi) in bands.items():
        d = sampling.demands(c, kind, 4, 5)
        assert rows(d) == rows(sampling.demands(c.repartition(7), kind, 4, 5)) and all(lo <= r.demand <= hi for r in d.collect())
        f = sampling.fleet(d).first()
        assert f.most <= f.capacity or f.capacity == f.total - 1
    bulky = sum(r.demand >= 50 for r in sampling.demands(c, 7, 4, 5).collect())
    r = sampling.demands(c, 7, 4, 5).first().route_size
    assert bulky == int(np.ceil(60 / r * 1.5)) - 1 or bulky == int(60 / r * 1.5)
    v = c.select("city", F.col("i").alias("node_id"), "lat", "lon")
    for drawn in (sampling.random_customers(v, 20, 1), sampling.clustered_customers(v, 20, 3, 800.0, 1), sampling.random_clustered_customers(v, 20, 3, 800.0, 1), sampling.random_customers(v, 500, 1)):
        got = drawn.collect()
        assert len({x.node_id for x in got}) == len(got) in (20, 60) and sorted(x.place for x in got) == list(range(1, len(got) + 1))
    on = spark.createDataFrame([("t", 1, 5, 0.0), ("t", 2, 5, 0.0), ("t", 3, 6, 0.0)], "city string, point_id long, node_id long, d2 double")
    mixed = sampling.hybrid_customers(on, v, 10, 0.5, 3).collect()
    assert [sum(x.source_tag == t for x in mixed) for t in ("poi", "param", "param_fill")] in ([2, 5, 3], [2, 4, 4], [2, 3, 5])


def square(spark, m):
    return spark.createDataFrame([("t", i, j, float(m[i][j])) for i in range(len(m)) for j in range(len(m)) if i != j], "city string, i long, j long, cost double")


def test_tours_and_schedules(spark):
    r = np.random.default_rng(5)
    m = r.integers(60, 1800, (9, 9)).astype(float)
    m[2] = m[3]
    np.fill_diagonal(m, np.inf)
    left, at, want = set(range(1, 9)), 0, []
    while left:
        at = min(left, key=lambda k: (m[at][k], k))
        left.remove(at)
        want.append(at)
    assert schedules.nearest_tours(square(spark, m)).first().route == want
    demand, service = np.array([0, 3, 4, 5, 2, 6, 1, 2, 3.0]), np.full(9, 100.0)
    tours = schedules.anchor_tours(m, demand, service, 9.0)
    assert sorted(sum(tours, [])) == list(range(1, 9)) and all(demand[t].sum() <= 9 for t in tours)
    stops = spark.createDataFrame([("t", k, int(demand[k]), 100 if k else 0, 0 if k != 4 else 40000, 86400, 9) for k in range(9)], "city string, node long, demand long, service long, earliest long, latest long, capacity long")
    got = schedules.anchor_routes(square(spark, m), stops).orderBy("route_idx")
    assert [x.route for x in got.collect()] == tours
    with pytest.raises(ValueError):
        schedules.anchor_tours(m, demand, service, 5.0)
    routes = got.select("city", F.lit("r").alias("run"), "route_idx", "route")
    seen = {(x.route_idx, x.leg): (x.arrival, x.begin) for x in schedules.arrivals(routes, square(spark, m), stops, wait=True).collect()}
    for k, t in enumerate(tours):
        clock = 0.0
        for leg, (a, b) in enumerate(pairwise([0, *t, 0])):
            clock += m[a, b]
            begin = max(clock, 40000.0 if b == 4 else 0.0)
            assert seen[k, leg] == (clock, begin)
            clock = begin + (100 if b else 0)
    checked = schedules.route_checks(routes, square(spark, m), stops).collect()
    assert all(x.ok for x in checked) and sum(x.load for x in checked) == demand.sum()
    c = schedules.coverage(routes.where("route_idx > 0").unionByName(routes.where("route_idx = 1")).unionByName(spark.createDataFrame([("t", "r", 9, [77])], "city string, run string, route_idx int, route array<bigint>")), stops).first()
    assert (c.missing, c.repeated, c.unknown) == (len(tours[0]), len(tours[1]) if len(tours) > 1 else 0, 1)


def test_windows_and_lift(spark):
    n = spark.createDataFrame([("t", k, 0 if k == 0 else 500 + k, 0 if k == 0 else 700 + k, 1000.0 * k) for k in range(40)], "city string, node long, to long, back long, visit double")
    for kind in ("td-shared", "tight", "spread"):
        w = schedules.family_windows(schedules.service_times(n, 3), kind, 3).collect()
        for x in w:
            assert (x.node == 0 and (x.earliest, x.latest) == (0, 86400)) or (0 <= x.earliest <= x.latest and x.to <= x.latest <= 86400 - x.back - x.service and x.service >= 1)
    w = schedules.windows(schedules.service_times(n, 3).withColumn("arrival", F.col("visit")), "route_centered", 3).collect()
    assert all(x.node == 0 or (x.to <= x.earliest <= x.latest <= 86400 - x.service - x.back) for x in w) and not any(x.repaired for x in w)
    needs = spark.createDataFrame([("t", 1, "a", 0, 700.0), ("t", 1, "b", 1, 900.2), ("t", 2, "a", 0, 10.0), ("t", 3, "a", 0, 5000.0), ("t", 3, "b", 1, 5000.0)], "city string, node long, sub string, sub_pos int, begin double")
    stops = spark.createDataFrame([("t", k, 800) for k in range(5)], "city string, node long, latest long")
    assert {(x.node, x.latest, x.lift, x.worst) for x in schedules.lifted_windows(needs, stops).collect()} == {(0, 800, 0, None), (1, 901, 101, "b"), (2, 800, 0, None), (3, 5000, 4200, "a"), (4, 800, 0, None)}


def ride(t, length, profile):
    while length > 1e-9:
        k = int(t // 3600)
        reach = ((k + 1) * 3600 - t) * profile[k % 24]
        if length <= reach:
            return t + length / profile[k % 24]
        t, length = (k + 1) * 3600.0, length - reach
    return t


def test_travel_through_traffic(spark):
    r = random.Random(2)
    cases = [(r.uniform(0, 90000), r.choice([0.0, 10.0, 5000.0, 90000.0]), [r.uniform(1, 20) for _ in range(24)]) for _ in range(40)]
    df = spark.createDataFrame(cases, "t double, len double, p array<double>")
    got = [x[0] for x in df.select(traffic.through(F.col("t"), F.col("len"), F.col("p"))).collect()]
    assert got == pytest.approx([ride(*c) for c in cases])
    steps = [{"pos": k, "length_m": c[1], "profile": c[2]} for k, c in enumerate(cases[:5])]
    one = spark.createDataFrame([(1, steps)], "id int, steps array<struct<pos: int, length_m: double, profile: array<double>>>")
    clock = 1000.0
    for c in cases[:5]:
        clock = ride(clock, c[1], c[2])
    assert traffic.arrival_after_path(one, F.array(F.lit(1000.0))).first().arrival == pytest.approx(clock)


def test_traffic_models(spark):
    edges = spark.createDataFrame([("t", 1, 2, 6, 500.0), ("t", 2, 3, 1, 900.0)], "city string, u long, v long, class int, length_m double")
    spots = spark.createDataFrame([("t", 1, 50.0, 4.0), ("t", 2, 50.0, 4.01), ("t", 3, 50.0, 4.02)], "city string, node_id long, lat double, lon double")
    calm, busy = ({(x.u, x.v): x.profile for x in traffic.wave_profiles(edges, spots, i, 1).collect()} for i in ("light", "heavy"))
    assert all(len(p) == 24 and min(p) > 0 for p in calm.values()) and busy[1, 2][8] < calm[1, 2][8] < calm[1, 2][3]
    flows = spark.createDataFrame([("t", 1, 2, 8, 600), ("t", 1, 2, 9, 99999)], "city string, u long, v long, bin int, n long")
    p = {(x.u, x.v): x.profile for x in traffic.volume_delay_profiles(edges, flows).collect()}
    free = 40 / 3.6
    assert p[1, 2][8] == pytest.approx(free / 1.15, abs=6e-4) and p[1, 2][9] == pytest.approx(free / 6, abs=6e-4) and p[2, 3] == [27.778] * 24
    steps = spark.createDataFrame([("t", 1, 0, 1, 2), ("t", 1, 1, 2, 3), ("t", 1, 2, 3, 9), ("t", 1, 3, 1, 2)], "city string, trip long, pos int, u long, v long")
    assert traffic.known_prefix(steps, edges).count() == 2
    timed = spark.createDataFrame([(1, 0, 1800.0, 80000.0), (1, 1, 9000.0, 80000.0), (1, 2, 60.0, 80000.0)], "trip long, pos int, time double, departure_s double")
    assert [(x.entry_s, x.bin) for x in traffic.entry_bins(timed).orderBy("pos").collect()] == [(80000.0, 22), (81800.0, 22), (90800.0, 23)]
    limits = edges.select("city", "u", "v", F.lit(5.0).alias("limit"))
    over = traffic.overlay(traffic.wave_profiles(edges.limit(1), spots, "light", 1), limits).collect()
    assert len(over) == 1 and max(over[0].profile) == 5.0 and traffic.missing_profiles(traffic.wave_profiles(edges.where("u = 1"), spots, "light", 1), limits).count() == 1


def test_flows_follow_fastest_paths(spark):
    r = random.Random(6)
    es = [(u, (u + k) % 10, float(r.randint(100, 4000))) for u in range(10) for k in (1, 4, 7)]
    trips = [(r.randrange(10), r.randrange(10), r.uniform(0, 86000), r.random() < 0.5) for _ in range(150)]
    trips = [t for t in trips if t[0] != t[1]]
    edges = spark.createDataFrame([("t", *e) for e in es], "city string, u long, v long, time double")
    day = spark.createDataFrame([("t", *t) for t in trips] + [("t", 0, 99, 0.0, True)], "city string, home long, work long, departure_s double, to_work boolean")
    w = {(u, v): t for u, v, t in es}
    d = brute_costs(es, 10)
    want = {}
    for home, work, begin, to in trips:
        a, b = (home, work) if to else (work, home)
        clock, at = begin, a
        while at != b:
            nxt = next(v for u, v, t in es if u == at and t + d[v, b] == d[at, b])
            k = (at, nxt, min(int(clock // 3600), 23))
            want[k] = want.get(k, 0) + 1
            clock += w[at, nxt]
            at = nxt
    got = {(x.u, x.v, x.bin): x.n for x in traffic.hourly_flows(edges, day, 2).collect()}
    assert sum(got.values()) == sum(want.values()) and sum(got.get(k, 0) == n for k, n in want.items()) > 0.95 * len(want)


    by_joins = {(x.u, x.v, x.bin): x.n for x in traffic.hourly_flows(edges, day, max_edges=0).collect()}
    assert sum(by_joins.values()) == sum(want.values()) and sum(by_joins.get(k, 0) == n for k, n in want.items()) > 0.95 * len(want)


def test_arrival_functions(spark):
    r = random.Random(12)
    steps = [{"pos": k, "length_m": 4000.0, "profile": [r.uniform(2, 20) for _ in range(24)]} for k in range(3)]
    arcs = spark.createDataFrame([("t", 0, 1, steps)], "city string, i int, j int, steps array<struct<pos: int, length_m: double, profile: array<double>>>")
    f = traffic.arrival_functions(arcs, tolerance_s=1.0).cache()
    assert len(f.first().departures) < 1441
    for at in (0.0, 12345.0, 60001.0, 86400.0):
        clock = at
        for s in steps:
            clock = ride(clock, s["length_m"], s["profile"])
        assert traffic.evaluated(f, F.lit(at)).first().arrival == pytest.approx(clock, abs=8.0)
    f.unpersist()


def test_trips(spark):
    v = spark.createDataFrame([("t", k) for k in range(40)], "city string, node_id long")
    got = traffic.trips(v, v, "moderate", 4).collect()
    assert 0.85 * 200 * 2.5 < len(got) < 200 * 2.7 and all(900 <= x.departure_s <= 85500 and x.home != x.work for x in got)


def test_geometry(spark):
    spots = spark.createDataFrame([("t", k, 4 + k * 0.01, 50.0) for k in range(4)], "city string, node long, lon double, lat double")
    line = lambda *ks: [(4 + k * 0.01, 50.0) for k in ks]
    cand = spark.createDataFrame([("t", 0, 1, 2, line(0, 0.5, 1)), ("t", 0, 1, 1, line(0, 3)), ("t", 1, 2, 1, line(1, 1.5, 2)), ("t", 2, 3, 1, [(4.0, 50.0)])], f"city string, from_node long, to_node long, rank int, line {geometry.LINE}")
    legs = spark.createDataFrame([("t", 0, 1), ("t", 2, 1), ("t", 2, 3)], "city string, from_node long, to_node long")
    got = {(x.from_node, x.to_node): (x.mode, len(x.line)) for x in geometry.materialized(legs, cand, spots).collect()}
    assert got == {(0, 1): ("road", 3), (2, 1): ("reversed", 3), (2, 3): ("straight", 2)}
    routes = spark.createDataFrame([("t", "r", 0, [1]), ("t", "r", 1, None), ("t", "r", 2, [])], "city string, run string, route_idx int, route array<bigint>")
    lines = geometry.materialized(schedules.legs(routes).select("city", "from_node", "to_node"), cand, spots)
    one = geometry.route_lines(schedules.legs(routes), lines).collect()
    assert len(one) == 1 and len(one[0].line) == 5 and one[0].mode == "cached_road"
    js = geometry.feature_collection(spots, ["city"], ["node"]).first().geojson
    assert '"type":"FeatureCollection"' in js and js.count('"Point"') == 4


def test_solutions(spark):
    kind = "run_id string, created_at timestamp_ntz, instance_id string, cost double, objective_function string, routes array<array<int>>, validation struct<valid: boolean>, metadata struct<metric: string>"
    runs = solutions.runs_once(spark.createDataFrame([
        ("a", DAY, "i", 10.0, "MonoCost", [[0, 1, 2, 0], [3]], (True,), ("m",)), ("a", DAY, "i", 10.0, "MonoCost", [[0, 1, 2, 0], [3]], (True,), ("m",)), ("b", DAY, "i", 12.0, "MonoCost", [[2, 1, None], [], [3, 0]], (True,), ("m",)),
        ("c", DAY, "i", 9.0, "MonoCost", [[1]], (None,), ("m",)), ("d", DAY, "i", 1.0, "Duration", [[1]], (True,), ("m",)), (None, DAY, "i", 1.0, "Duration", [[1]], (True,), ("m",)), ("e", None, "i", None, "MonoCost", None, None, None),
    ], kind))
    assert runs.count() == 5 and rows(solutions.best_references(runs)) == [("b", "a")]
    x = solutions.compared(runs, solutions.best_references(runs)).first()
    assert (x.cost_delta, x.gap_percent, x.routes_delta, x.ordering) == (2.0, 20.0, 0, "worse") and (x.edges_added, x.edges_removed, x.pairs_added, x.pairs_removed) == (3, 3, 0, 0)
    demand = spark.createDataFrame([("i", 1, 5), ("i", 2, 6)], "instance_id string, node int, demand long")
    assert [(r.run_id, r.route_idx, r.load) for r in solutions.loads(solutions.customer_routes(runs), demand).where("run_id = 'a'").orderBy("route_idx").collect()] == [("a", 0, 11), ("a", 1, 0)]
    assert [r.run_id for r in solutions.recent(runs, 2, objective_function="MonoCost").collect()] == ["a", "b"]


RUN = "run_id string, instance_id string, cost double, objective_function string, metric string, valid boolean, routes array<array<int>>"


def _changes(c, r):
    """Edges and pairs that c adds to r and leaves out, by sets."""
    found = []
    for routes in (c, r):
        own = [[x for x in route or [] if x] for route in routes or []]
        found.append(({e for x in own if x for e in pairwise([0, *x, 0])}, {p for x in own for p in combinations(sorted(set(x)), 2)}))
    (ce, cp), (re, rp) = found
    return (len(ce - re), len(re - ce), len(cp - rp), len(rp - cp))


def _random_routes(draw):
    if draw.random() < 0.3:
        nodes = draw.sample(range(1, 15), 14)
        return [nodes[k::3] for k in range(3)]
    return None if draw.random() < 0.1 else [None if draw.random() < 0.1 else [draw.choice([None, 0, -3, 2**31 - 1, *range(1, 9)]) for _ in range(draw.randrange(7))] for _ in range(draw.randrange(5))]


def test_compared_routes_by_brute_force(spark):
    draw = random.Random(5)
    runs = {f"r{k:03}": _random_routes(draw) for k in range(60)}
    df = spark.createDataFrame([(k, "i", 10.0, "MonoCost", None, True, x) for k, x in runs.items()], RUN)
    versus = spark.createDataFrame([(k, r) for k in runs for r in ("r000", "r007", "gone")], "candidate string, reference string")
    want = sorted((k, r, *_changes(runs[k], runs[r])) for k in runs for r in ("r000", "r007"))
    assert rows(solutions.compared(df, versus, most=7).select("candidate", "reference", "edges_added", "edges_removed", "pairs_added", "pairs_removed")) == want
    kind = pa.list_(pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _, *_ in want]), pa.array([runs[k] for k, *_ in want], kind), pa.array([runs[r] for _, r, *_ in want], kind)], ["candidate", "c_routes", "r_routes"])
    for limit in (1, 50):
        parts = [tuple(x.values())[3:] for b in solutions._change_kernel(limit)([batch.slice(0, 0), batch, batch.slice(3, 9)]) for x in b.to_pylist()]
        assert parts == [x[2:] for x in want] + [x[2:] for x in want[3:12]]


def test_compared_runs_never_turn_pairs_into_rows(spark):
    n = 20_000  # 200 million pairs
    df = spark.createDataFrame([("a", "i", 1.0, "MonoCost", "m", True, [list(range(1, n + 1))]), ("b", "i", 2.0, "MonoCost", "m", True, [list(range(1, n + 1, 2)), list(range(2, n + 1, 2))])], RUN)
    out = solutions.compared(df, solutions.best_references(df))
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert rows(out) == [("b", "a", 1.0, 100.0, 1, "worse", n, n - 1, 0, n * n // 4)]


def test_bad_requests():
    for bad in ({"n": 0}, {"method": "x"}, {"demand_kind": 8}, {"poi_share": 1.5}, {"decay_m": 0}):
        with pytest.raises(ValueError):
            pipeline.Request(**bad)
