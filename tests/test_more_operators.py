"""Operators on files, ids, guards and candidate graphs."""

import json

import pytest
from pyspark.sql import functions as F

from waymesh.functions import scalars
from waymesh.operators import geometry, graph, sampling, schedules, traffic
from waymesh.plans import pipeline
from waymesh.sources import instances, osm


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_published_extract(spark, tmp_path):
    nodes = spark.createDataFrame([(2, 50.5, 4.0, {"a": "<&>"}), (1, 50.0, 4.5, {})], "id long, lat double, lon double, tags map<string, string>")
    ways = spark.createDataFrame([(7, [1, 2], {"highway": "primary"})], "id long, nodes array<long>, tags map<string, string>")
    path = str(tmp_path / "x.osm")
    osm.write_xml(nodes, ways, path)
    assert osm.extract_counts(spark, path).first().valid and tuple(osm.read_bounds(spark, path).first()) == (50.0, 4.0, 50.5, 4.5)
    box = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "min_lat double, min_lon double, max_lat double, max_lon double")
    osm.write_xml(nodes, ways, path, box)
    assert tuple(osm.read_bounds(spark, path).first()) == (1.0, 2.0, 3.0, 4.0)
    with pytest.raises(ValueError):
        osm.write_xml(nodes, ways.limit(0), path)
    assert osm.read_ways(spark, path).count() == 1 and [p.name for p in tmp_path.iterdir() if "tmp" in p.name] == []


def test_ids_keep_their_digits(spark):
    big = (1 << 62) + 1
    kind = "city string, osm_file string, num_bins int, bin_seconds double, edges array<struct<osm_u: bigint, osm_v: bigint, length_m: double, road_class: int, free_speed_ms: double>>, vertices array<struct<osm_id: bigint, lon: double, lat: double>>"
    g = spark.createDataFrame([("t", "f", 24, 3600.0, [(big, -big, 5.5, 6, 11.1)], [(big, 4.0, 50.0), (-big, 4.1, 50.1)]), ("u", "f", 12, 3600.0, [(1, 1, 5.5, 6, 11.1)], [(1, 4.0, 50.0)])], kind)
    back = {r.city: r for r in instances.read_graphs(instances.graph_json(g)).collect()}
    assert back["t"].problem is None and back["t"].edges[0].osm_u == big and back["u"].problem == "bins do not make a day"


def test_bridge_export(spark, tmp_path):
    kind = "city string, osm_file string, num_bins int, bin_seconds double, edges array<struct<osm_u: bigint, osm_v: bigint, length_m: double, road_class: int, free_speed_ms: double>>, vertices array<struct<osm_id: bigint, lon: double, lat: double>>"
    g = spark.createDataFrame([("t", "f", 24, 3600.0, [(1, 2, 5.5, 6, 11.1)], [(1, 4.0, 50.0), (2, 4.1, 50.1)])], kind)
    made = []

    def profiles():
        made.append(1)
        return spark.createDataFrame([("t", "wave", "light", 1, 0, 0, [1.0] * 24)], "city string, model string, intensity string, seed long, num_trips long, edge_idx int, profile array<double>")

    nodes = spark.createDataFrame([("t", "b", 0, 1), ("t", "b", 1, 2)], "city string, instance_base string, i int, osm_id long")
    out = str(tmp_path / "bridge")
    first, again, forced = (json.loads(instances.export_bridge(spark, out, g, {("wave", "light"): profiles}, nodes, force).first().value) for force in (False, False, True))
    assert len(made) == 2 and again["speed_files"] == ["speeds-wave-light (kept)"] and forced == first
    assert (first["num_vertices"], first["num_edges"], first["node_files"]) == (2, 1, ["nodes-b"])


def test_routes_by_ids(spark):
    nodes = spark.createDataFrame([("x", i) for i in (1, 2, 3, 4)] + [("y", i) for i in (2, 3)], "instance_id string, node_id long")
    runs = [("x", "places", 0, [1, 3]), ("x", "places", 1, [2]), ("x", "some", 0, [1]), ("x", "ids", 0, [2, None, 4]), ("x", "bad", 0, [9]), ("y", "no", 0, [1]), ("z", "none", 0, [1]), ("x", "empty", 0, [])]
    df = spark.createDataFrame(runs, "instance_id string, run_id string, route_idx int, route array<int>")
    got = {(r.run_id, r.route_idx): (r.route, r.problem) for r in instances.routes_by_ids(df, nodes).collect()}
    assert got == {("places", 0): ([2, 4], None), ("places", 1): ([3], None), ("some", 0): ([2], None), ("ids", 0): ([2, 4], None), ("bad", 0): (None, "unknown node"), ("no", 0): (None, "no depot"), ("none", 0): (None, "no depot"), ("empty", 0): ([], None)}


def test_guards_and_notes(spark):
    d = spark.createDataFrame([([0, 5, 6], 6), ([0, 5, 9], 8), ([0, 2], 9), ([0, 2], None)], "d array<long>, c long")
    assert [r[0] for r in d.select(instances.size_problem(F.col("d"), F.col("c"))).collect()] == [None, "a demand above the capacity", "one vehicle is enough", "no capacity"]
    t = spark.createDataFrame([('{"m":{"a":1,"z":2},"b":[1.50]}',), ('{"m":{"k":0}}',), ('{"b":1}',), (None,)], "value string")
    got = [(r.value, r.changed) for r in instances.annotated(t, "m", "k", "v", "z").collect()]
    assert got[0] == ('{"m":{"a":1,"k":"v","z":2},"b":[1.5]}', True) and got[1:] == [('{"m":{"k":0}}', False), ('{"b":1}', False), (None, False)]
    n = spark.createDataFrame([("t", "b", 0, 5), ("t", "b", 1, 9)], "city string, instance_base string, i int, vertex int")
    v = spark.createDataFrame([("t", 5, 77)], "city string, vertex int, node_id long")
    assert {(r.i, r.osm_id, r.problem) for r in instances.node_ids(n, v, {"trim": True}, {"trim": True}).collect()} == {(0, 77, None), (1, None, "no such vertex")}
    with pytest.raises(ValueError):
        instances.node_ids(n, v, {"trim": True}, {"trim": False})
    assert traffic.model_params("bpr", "light")["trips_per_vertex"] == 2.5 and traffic.model_params("wave", "heavy")["amplitude"] == 0.65
    with pytest.raises(ValueError):
        traffic.model_params("other", "light")
    c = spark.createDataFrame([("t", 1, "poi"), ("t", 2, "param"), ("u", 1, None)], "city string, node_id long, source_tag string")
    assert rows(sampling.source_counts(c)) == [("t", 1, 1), ("u", 0, 1)] and sampling.required(c, 1).count() == 3
    with pytest.raises(Exception, match="fewer than 2"):
        sampling.required(c, 2).collect()
    assert pipeline.pool_request(pipeline.Request(n=3), [5, 7]).n == 11
    s = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    keys = [r[0] for r in s.select(scalars.sha_seed(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert len(set(keys)) == 2


def test_arcs_places_and_lines(spark):
    edges = spark.createDataFrame([("t", 1, 2, 6, 10.0), ("t", 2, 3, 6, 10.0), ("t", 1, 3, 6, 30.0)], "city string, u long, v long, class int, length_m double")
    places = spark.createDataFrame([("t", 0, 1), ("t", 1, 3), ("t", 2, 9)], "city string, i int, node_id long")
    assert rows(graph.missing_places(places, edges).select("node_id")) == [(9,)]
    trimmed = pipeline.trimmed_graph(edges, places)
    assert rows(pipeline.trim_differences(edges, trimmed, places)) == []
    assert rows(pipeline.trim_differences(edges, edges.where("length_m = 30"), places)) == [("t", 1, 3, 1.8, 2.7)]
    legs = spark.createDataFrame([("t", 0, 1), ("t", 1, 0)], "city string, from_node long, to_node long")
    arcs = spark.createDataFrame([("t", 0, 1)], "city string, i int, j int")
    assert rows(schedules.missing_arcs(legs, arcs)) == [("t", 1, 0)]
    spots = spark.createDataFrame([("t", 0, 4.0, 50.0), ("t", 1, 4.1, 50.0)], "city string, node long, lon double, lat double")
    line = lambda *xs: [(x, 50.0) for x in xs]
    kind = "city string, from_node long, to_node long, rank int, line array<struct<lon: double, lat: double>>"
    found = spark.createDataFrame([("t", 0, 1, 0, line(4.0, 4.05, 4.1)), ("t", 1, 0, 0, line(9.0, 4.0))], kind)
    cached = spark.createDataFrame([("t", 0, 1, line(4.0, 4.02, 4.06, 4.1))], "city string, from_node long, to_node long, line array<struct<lon: double, lat: double>>")
    done = {(r.from_node, r.to_node): (len(r.line), r.mode) for r in geometry.materialized(legs, geometry.cached_first(cached, found), spots).collect()}
    assert done == {(0, 1): (4, "road"), (1, 0): (4, "reversed")}


def test_candidate_graphs(spark):
    """A leg to a node inside a road is only on the graph of all nodes."""
    nodes = spark.createDataFrame([("t", i, 50.0, 4.0 + i / 1000) for i in (1, 2, 3)], "city string, node_id long, lat double, lon double")
    ways = spark.createDataFrame([("t", 7, [1, 2, 3], 6, False, False)], "city string, way_id long, nodes array<long>, class int, one_way boolean, backward boolean")
    need = spark.createDataFrame([("t", 0, 1, 1, 3), ("t", 0, 2, 1, 2), ("t", 0, 3, 1, 99)], "city string, from_node long, to_node long, source long, target long")
    got = {(r.to_node, r.rank, len(r.line)) for r in pipeline.candidate_lines(ways, nodes, need).collect()}
    assert got == {(1, 0, 2), (2, 1, 2)}


def test_anchors_or_tours(spark):
    costs = spark.createDataFrame([(c, i, j, 60.0 * (i + j)) for c in "ab" for i in range(3) for j in range(3) if i != j], "city string, i long, j long, cost double")
    known = spark.createDataFrame([("a", 0, [2]), ("a", 1, [1])], "city string, route_idx int, route array<int>")
    assert rows(schedules.anchors_or_tours(known, costs)) == [("a", "anchor", 0, [2]), ("a", "anchor", 1, [1]), ("b", "tour", 0, [1, 2])]
    lifted = spark.createDataFrame([("a", 5), ("a", 0), ("b", 0)], "city string, lift long")
    assert rows(schedules.lift_statistics(lifted)) == [("a", 1, 5), ("b", 0, 0)]
