"""Registered queries over small tables: nothing is left out."""

import math
import random
from collections import Counter
from datetime import datetime
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from waymesh.functions import geo
from waymesh.functions.scalars import FREE_KMH
from waymesh.operators import nearest, roads, traffic
from waymesh.plans import network, pipeline
from waymesh.sources import acquire


def test_every_customer_has_a_stop(spark, tmp_path):
    sf = str(tmp_path)
    rows = [(k, k % 2) for k in range(1, 78)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").write.parquet(f"{sf}/customer.parquet")
    want = Counter({"0": 15, "0-1": 15, "0-2": 8, "1": 15, "1-1": 15, "1-2": 9})
    assert Counter(x.city for x in network.service_times(spark, sf).where("node > 0").collect()) == want
    for f in (network.arrival_times, network.waiting_times):
        assert Counter((x.city, x.run) for x in f(spark, sf).where("node > 0").collect()) == {(c, r): n for c, n in want.items() for r in "ab"}
    demand = Counter(x.demand for x in network._demand_query(2)(spark, sf).collect())
    assert Counter(x.demand for x in network._stops(spark, sf).where("node > 0").collect()) == demand
    assert sum(len(x.route) for x in network.nearest_tours(spark, sf).collect()) == len(rows)
    assert network.QUERIES["windows_tight"](spark, sf).where("node > 0").count() == len(rows)
    assert {x.name: x.dimension for x in network.instance_files(spark, sf).collect()} == {c: n + 1 for c, n in want.items()}


def test_costs_and_paths_of_all_vertices(spark, tmp_path):
    r, sf, free = random.Random(5), str(tmp_path), list(FREE_KMH)
    kind = "bridge_id long, published_at timestamp, osm_file string, num_bins int, bin_seconds double, edges array<struct<osm_u: long, osm_v: long, length_m: double, road_class: int>>, vertices array<struct<osm_id: long, lon: double, lat: double>>"
    graphs, want, fast = [], {}, {}
    for b in (1, 2):
        ids = r.sample(range(100, 999), 9)
        ends = [*zip(ids, ids[1:]), *(tuple(r.sample(ids, 2)) for _ in range(8))]
        edges = [(u, v, float(r.randint(50, 900)), r.choice(free)) for u, v in dict.fromkeys(ends)]
        graphs.append((b, datetime(2024, 1, 1), "f", 24, 3600.0, edges, [(i, 4 + i / 1e5, 45 + i % 7 / 1e4) for i in ids]))
        for out, weigh in ((want, lambda m, c: m), (fast, lambda m, c: m * 3.6 / FREE_KMH[c])):
            d = {(x, y): 0.0 if x == y else math.inf for x in ids for y in ids}
            d |= {(u, v): weigh(m, c) for u, v, m, c in edges}
            for k, x, y in product(ids, ids, ids):
                d[x, y] = min(d[x, y], d[x, k] + d[k, y])
            out.update({(str(b), x, y): c for (x, y), c in d.items()})
    spark.createDataFrame(graphs, kind).write.parquet(f"{sf}/bridge_graph.parquet")
    b = network._bridges(spark, sf)
    ids = {(x.city, x.i): x.node_id for x in network._places(network._bridge_spots(b)).collect()}
    got = {(x.city, x.metric, ids[x.city, x.i], ids[x.city, x.j]): x.cost for x in network.cost_matrices(spark, sf).collect()}
    up = lambda c: None if c == math.inf else math.ceil(round(c, 6))
    assert got == {(b, m, x, y): up(c) for m, d in (("shortest", want), ("fastest", fast)) for (b, x, y), c in d.items() if x != y}
    rounds = {(x.city, x.source, x.node_id): x.cost for x in network.cost_rounds(spark, sf).collect()}
    assert rounds == {k: round(c, 3) for k, c in want.items() if c < math.inf}
    assert network.euclid_matrices(spark, sf).count() == 2 * 9 * 8
    reach = {(b, x, y) for (b, x, y), c in fast.items() if x != y and c < math.inf}
    arrivals = {(x.city, ids[x.city, x.i], ids[x.city, x.j]) for x in network.path_arrivals(spark, sf).collect()}
    assert arrivals == reach
    tight = {(str(g[0]), u, v) for g in graphs for u, v, m, c in g[5] if fast[str(g[0]), u, v] >= m * 3.6 / FREE_KMH[c] - 1e-9}
    assert {(x.city, x.osm_u, x.osm_v) for x in network.trimmed_sidecar(spark, sf).collect()} == tight
    assert network.deadline_lift(spark, sf).count() == 18
    points = sum(x.points for x in network.route_polylines(spark, sf).collect())
    assert points >= 2 * 9


def test_city_across_the_antimeridian(spark):
    rows = [("a", 1, 0.0, 179.0), ("a", 2, 1.0, 179.9), ("a", 3, 1.0, -179.9), ("a", 4, 2.0, -178.0), ("b", 5, 0.0, 10.0), ("b", 6, 1.0, 11.0)]
    n = spark.createDataFrame(rows, "city string, node_id long, lat double, lon double")
    bounds = roads.city_bounds(n)
    assert {x.city: (x.min_lat, x.min_lon, x.max_lat, x.max_lon) for x in bounds.collect()} == {"a": (0.0, 179.0, 2.0, -178.0), "b": (0.0, 10.0, 1.0, 11.0)}
    half = roads.middle_half(bounds)
    assert {x.city: (x.min_lon, x.max_lon) for x in half.collect()} == {"a": (179.75, -178.75), "b": (10.25, 10.75)}
    w = spark.createDataFrame([("a", 1, [1, 2, 3, 4])], "city string, way_id long, nodes array<long>")
    got = [(x.synthetic, round(x.lon, 6)) for x in roads.cropped(w, n, half).orderBy("seq").collect()]
    assert got == [(True, 179.75), (False, 179.9), (False, -179.9), (True, -178.95)]
    cells = [x for x in acquire.tiles(bounds, (5.0, 0.7)).collect() if x.city == "a"]
    assert sorted(round(x.west, 6) for x in cells) == [-180.0, round(-180 + 2 / 3, 6), round(-180 + 4 / 3, 6), 179.0, 179.5] and len({x.tile for x in cells}) == 5
    assert all(-180 <= x.west < x.east <= 180 for x in cells)
    east = {x.node_id: x.east for x in nearest.in_city_frame(n, bounds).collect()}
    assert east[1] < east[2] < east[3] < east[4]
    assert spark.range(1).select(geo.flat_metres(F.lit(179.9), F.lit(0.0), F.lit(-179.9), F.lit(0.0))).first()[0] < 23_000


def test_work_pool(spark, monkeypatch):
    v = spark.createDataFrame([(c, i) for c in "ab" for i in range(120)], "city string, node_id long")
    on = spark.createDataFrame([(c, i) for c, n in (("a", 50), ("b", 49)) for i in [*range(n), 0, 999]], "city string, node_id long")
    pool = {(x.city, x.node_id) for x in traffic.work_pool(v, on).collect()}
    assert pool == {("a", i) for i in range(50)} | {("b", i) for i in range(120)}
    seen = []
    monkeypatch.setattr(traffic, "trips", lambda homes, works, *_: seen.append({(x.city, x.node_id) for x in works.select("city", "node_id").collect()}) or spark.createDataFrame([], "city string"))
    monkeypatch.setattr(traffic, "hourly_flows", lambda edges, day: day)
    monkeypatch.setattr(traffic, "volume_delay_profiles", lambda edges, flows: edges)
    e = spark.createDataFrame([("a", 0, 1, 9.0, list(FREE_KMH)[0])], "city string, u long, v long, length_m double, class int")
    pipeline.bridge(e, v, "bpr", "light", 3, on)
    assert seen == [pool]


def test_very_long_stretch(spark):
    profile = [1.0 + (k % 5) / 4 for k in range(24)]
    rows = [(float(t), float(m), profile) for t in (0, 5000, 86000) for m in (100, 200_000, 300_000, 1_000_000)]
    df = spark.createDataFrame(rows, "t double, m double, p array<double>")
    got = {(x.t, x.m): x.a for x in df.withColumn("a", traffic.through(F.col("t"), F.col("m"), F.col("p"))).collect()}
    assert all(abs(got[t, m] - traffic.ride_through(np.array([t]), m, np.array(p))[0]) < 1e-3 for t, m, p in rows)
