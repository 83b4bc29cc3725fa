"""Readers, writers and acquisition on own fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from waymesh.sources import acquire, instances, osm

CITY = """<?xml version="1.0"?>
<osm version="0.6"><bounds minlat="50.0" minlon="4.0" maxlat="50.1" maxlon="4.1"/>
<node id="1" lat="50.01" lon="4.01"/><node id="2" lat="50.02" lon="4.02"><tag k="amenity" v="cafe"/><tag k="name" v="A &amp; &quot;B&quot;"/><tag k="name" v="last"/></node>
<node id="3" lat="50.03" lon="4.03"/>
<way id="7"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/></way><way id="8"><tag k="highway" v="service"/></way>
</osm>"""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_read_xml(spark, tmp_path):
    p = tmp_path / "city.xml"
    p.write_text(CITY)
    n = {r.id: r for r in osm.read_nodes(spark, str(p)).collect()}
    assert set(n) == {1, 2, 3} and n[2].tags == {"amenity": "cafe", "name": "last"} and n[1].tags == {}
    w = {r.id: r for r in osm.read_ways(spark, str(p)).collect()}
    assert w[7].nodes == [1, 2] and w[8].nodes == [] and w[7].tags["highway"] == "primary"
    assert rows(osm.read_bounds(spark, str(p))) == [(50.0, 4.0, 50.1, 4.1)]
    assert rows(osm.pois_of(osm.read_nodes(spark, str(p)), ("cafe",))) == [(2, 50.02, 4.02, "cafe")]
    c = osm.extract_counts(spark, str(p)).first()
    assert (c.bounds, c.node, c.way, c.remark, c.valid) == (1, 3, 2, 0, True)
    p.write_text(CITY.replace('<bounds minlat="50.0" minlon="4.0" maxlat="50.1" maxlon="4.1"/>', "<remark>runtime error</remark>"))
    assert rows(osm.read_bounds(spark, str(p))) == [(50.01, 4.01, 50.03, 4.03)] and not osm.extract_counts(spark, str(p)).first().valid


def test_write_xml_round_trip(spark, tmp_path):
    p = tmp_path / "city.xml"
    p.write_text(CITY)
    n, w = osm.read_nodes(spark, str(p)), osm.read_ways(spark, str(p))
    osm.write_xml(n, w, str(tmp_path / "out"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*.txt")))
    assert text.startswith("<?xml") and text.rstrip().endswith("</osm>") and text.index('<node id="3"') < text.index('<way id="7"')
    again = osm.read_nodes(spark, str(tmp_path / "out"))
    assert sorted((r.id, r.lat, sorted(r.tags.items())) for r in again.collect()) == sorted((r.id, r.lat, sorted(r.tags.items())) for r in n.collect())


def test_merge_and_dedup(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    b = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert rows(osm.merged(a, b)) == [(1, "a", False), (2, None, False), (3, "c", True)]
    d = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, None, "z")], "id int, t int, v string")
    assert rows(osm.deduplicated(d, "id", "t", "last")) == [(1, 2, "y")] and rows(osm.deduplicated(d, "id", "t", "first")) == [(1, None, "z")]


TSP = "NAME : a\nTYPE : CVRP\nDIMENSION : 2\nCAPACITY : 9\nEDGE_WEIGHT_SECTION\n0 3\n4 0\nNODE_COORD_SECTION\n1 1 2\n2 3 4.5\nDEMAND_SECTION\n1 0\n2 5\nDEPOT_SECTION\n1\n-1\nEOF\n"


def test_instance_texts(spark, tmp_path):
    for n, t in (("a", TSP), ("b", TSP.replace("0 3\n", "0\n")), ("c", "x")):
        (tmp_path / f"{n}.vrp").write_text(t)
    got = {r.path.rsplit("/", 1)[1]: r for r in instances.read_instances(spark, str(tmp_path), strict=False).collect()}
    assert got["a.vrp"].costs == [[0.0, 3.0], [4.0, 0.0]] and got["a.vrp"].demands == [0, 5] and got["a.vrp"].error is None and got["b.vrp"].error == "3 costs for dimension 2" and got["c.vrp"].error == "no DIMENSION"
    good = instances.read_instances(spark, str(tmp_path / "a.vrp"))
    assert rows(instances.cost_rows(good)) == [("a", 0, 1, 3.0), ("a", 1, 0, 4.0)]
    timed = good.withColumn("windows", F.expr("array(named_struct('earliest', 0L, 'latest', 9L), named_struct('earliest', 2L, 'latest', 3L))")).withColumn("services", F.expr("array(0L, 7L)"))
    again = instances.parsed(instances.instance_text(timed, windows=True).select(F.col("name").alias("path"), "value")).first()
    assert again.type == "CVRPTW" and again.services == [0, 7] and [tuple(w) for w in again.windows] == [(0, 9), (2, 3)] and again.costs == [[0.0, 3.0], [4.0, 0.0]]
    text = instances.instance_text(good, decimals=3).first().value
    assert "0.000 3.000" in text and "2 3.000000 4.500000" in text
    instances.write_texts(instances.instance_text(good), str(tmp_path / "out"))
    assert [p.parent.name for p in (tmp_path / "out").rglob("*.txt")] == ["name=a"]


def graphs(spark, edges, vertices):
    kind = "city string, osm_file string, num_bins int, bin_seconds double, edges array<struct<osm_u: bigint, osm_v: bigint, length_m: double, road_class: int, free_speed_ms: double>>, vertices array<struct<osm_id: bigint, lon: double, lat: double>>"
    return spark.createDataFrame([("t", "t.osm", 24, 3600.0, edges, vertices)], kind)


def test_bridge_files(spark):
    v = [(2, 4.0, 50.0), (1, 4.1, 50.1)]
    good = instances.graph_json(graphs(spark, [(1, 2, 5.5, 6, 11.1)], v))
    assert [x[0] for x in json.loads(good.first().value)["vertices"]] == [1, 2]
    back = instances.read_graphs(good).first()
    assert back.problem is None and tuple(back.edges[0]) == (1, 2, 5.5, 6, 11.1)
    for e, problem in (([(1, 3, 5.5, 6, 11.1)], "unknown vertex"), ([(1, 2, 0.0, 6, 1.0)], "length or speed not above zero"), ([], "no edges")):
        assert instances.read_graphs(instances.graph_json(graphs(spark, e, v))).first().problem == problem
    old = good.select(F.replace("value", F.lit('"schema_version":2'), F.lit('"schema_version":1')).alias("value"))
    assert instances.read_graphs(old).first().problem == "version"
    p = spark.createDataFrame([("t", "wave", "light", 1, 0, k, [1.0] * 24) for k in (1, 0)], "city string, model string, intensity string, seed long, num_trips long, edge_idx int, profile array<double>")
    size = spark.createDataFrame([("t", 2)], "city string, n_edges long")
    assert instances.read_speeds(instances.speeds_json(p), size).first().problem is None
    assert instances.read_speeds(instances.speeds_json(p.limit(1)), size).first().problem == "not one profile per edge"
    nodes = spark.createDataFrame([("t", "b", 1, 20), ("t", "b", 0, 10)], "city string, instance_base string, i int, osm_id long")
    one = instances.read_node_lists(instances.nodes_json(nodes)).first()
    assert one.node_osm_ids == [10, 20] and one.problem is None
    twice = nodes.withColumn("osm_id", F.lit(5).cast("long"))
    assert instances.read_node_lists(instances.nodes_json(twice)).first().problem == "repeated node"


def test_manifests_and_hash(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.json").write_text('{"name": "a", "created_at": "2025-01-01"}')
    (tmp_path / "b.json").write_text('{"name": "b", "created_at": "2025-02-01"}')
    (tmp_path / "c.json").write_text("{broken")
    assert [r.name for r in instances.read_manifests(spark, str(tmp_path), "name string, created_at string").collect()] == ["b", "a"]
    d = spark.createDataFrame([("t", 2), ("t", 1)], "city string, x int")
    assert rows(instances.canonical_hash(d, ["city"], ["x"])) == rows(instances.canonical_hash(d.orderBy("x"), ["city"], ["x"]))


def test_queries_and_tiles(spark):
    q = acquire.road_query("(1,2,3,4)", ("a", "b.c"))
    assert 'way["highway"~"^(a|b\\\\.c)$"](1,2,3,4);' in q and "out skel" in q and "amenity" not in q
    assert 'node["amenity"](1,2,3,4);' in acquire.amenity_query("(1,2,3,4)", None)
    assert "amenity" not in acquire.combined_query("()", acquire.profile("road_cache")) and 'way["highway"]' in acquire.combined_query("()", acquire.profile("full"))
    with pytest.raises(ValueError):
        acquire.profile("full", ["cafe"])
    for lo, hi, most in ((0.0, 1.0, 0.3), (1.0, 1.0, 0.5), (-5.0, 5.0, 20.0)):
        parts = acquire.split_range(lo, hi, most)
        assert parts[0][0] == lo and parts[-1][1] == hi and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    box = spark.createDataFrame([("t", 0.0, 0.0, 1.0, 0.5)], "city string, min_lat double, min_lon double, max_lat double, max_lon double")
    assert acquire.tiles(box, (0.4, 0.5)).count() == 3
    said = spark.createDataFrame([(429, ""), (400, "Runtime Error: Timeout"), (400, "bad"), (200, "The server is probably too busy")], "s int, b string")
    assert [r[0] for r in said.select(acquire.is_retryable(F.col("s"), F.col("b"))).collect()] == [True, True, False, True]


def test_fetch(spark, tmp_path):
    calls = []

    def transport(endpoint, query):
        calls.append(endpoint)
        if endpoint == "a":
            return 504, "busy"
        return (200, "<osm><remark>runtime error</remark></osm>") if len(calls) < 4 else (200, CITY)

    assert acquire.fetch("q", ["a", "b"], transport, attempts=2, sleep=lambda _: None) == CITY and calls == ["a", "a", "b", "b"]
    with pytest.raises(acquire.FetchError):
        acquire.fetch("q", ["a"], lambda *_: (400, "no"), sleep=lambda _: None)
    asked = []
    get = lambda q: asked.append(q) or CITY
    for _ in range(2):
        assert acquire.cached_fetch("q", str(tmp_path), get) == CITY
    assert len(asked) == 1
    next(tmp_path.glob("*.gz")).write_bytes(b"broken")
    assert acquire.cached_fetch("q", str(tmp_path), get) == CITY and len(asked) == 2
    assert acquire.body_error(CITY, True) is None and acquire.body_error("<osm></osm>", True) == "no ways" and acquire.body_error("<osm>", False)


def test_fetch_tiles(spark):
    tiles = spark.createDataFrame([("0_0", 0.0, 0.0, 1.0, 1.0), ("0_1", 0.0, 1.0, 1.0, 2.0)], "tile string, south double, west double, north double, east double")

    def get(q):
        if "(0.0,1.0," in q:
            raise acquire.FetchError("gone")
        return CITY

    got = {r.tile: (r.body is not None, r.error) for r in acquire.fetch_tiles(spark, tiles, get, best_effort=True).collect()}
    assert got == {"0_0": (True, None), "0_1": (False, "gone")}
    bodies = spark.createDataFrame([("0", CITY), ("1", CITY.replace('lat="50.01"', 'lat="51"').replace('v="primary"', 'v="trunk"')), ("2", None)], "tile string, body string")
    nodes, ways = acquire.elements_of(bodies)
    assert {r.id: r.lat for r in nodes.collect()}[1] == 51.0 and {r.id: r.tags["highway"] for r in ways.collect()}[7] == "primary"
    with pytest.raises(acquire.FetchError):
        acquire.area_box((40, 0, 60, 10))
    assert acquire.area_box((49, 3, 51, 5), (50, 4), 11.1, 1.11)[0] == pytest.approx(49.89)
    assert acquire.geocode("x", lambda _: (200, '[{"boundingbox": ["1", "2", "3", "4"], "lat": "1.5", "lon": "3.5"}]')) == ((1.0, 3.0, 2.0, 4.0), (1.5, 3.5))
    assert acquire.file_name(" a/b  c ") == "a_b c"
    what = acquire.profile("generation")
    nodes, ways, mode = acquire.fetch_area(spark, (50.0, 4.0, 50.1, 4.1), lambda q: CITY, what)
    assert mode == "roads_and_amenities" and nodes.count() == 3 and ways.count() == 2
    assert acquire.fetch_area(spark, (50.0, 4.0, 50.5, 4.1), lambda q: CITY, acquire.profile("road_cache"))[2] == "tiled_roads"


def test_one_retry_rule(spark):
    cases = [(429, "", True), (400, "Runtime Error: Timeout", True), (400, "timeout", False), (200, "The server is probably too busy", True), (403, "runtime error: OUT OF MEMORY", True), (404, None, False), (None, None, False)]
    df = spark.createDataFrame([c[:2] for c in cases], "s int, b string")
    assert [r[0] for r in df.select(acquire.is_retryable(F.col("s"), F.col("b"))).collect()] == [c[2] for c in cases] == [acquire.may_pass(*c[:2]) for c in cases]
    calls = []

    def answer(status, body):
        return lambda e, _: calls.append(e) or (status, body)

    for status, body, asked in ((400, "timeout", ["a"]), (400, "runtime error: timeout", ["a", "a", "b", "b"]), (200, "<osm>", ["a", "a", "b", "b"])):
        calls.clear()
        with pytest.raises(acquire.FetchError):
            acquire.fetch("q", ["a", "b"], answer(status, body), attempts=2, sleep=lambda _: None)
        assert calls == asked
    for body, want in (("<osm><way/></osm>", None), ("<osm/>", "no ways"), ("<osm><remark> a\n <b>c</b> </remark><way/></osm>", "remark: a c"), ("<osm><remark/></osm>", "remark: unknown"), ("<html></html>", "not a complete document"), ("", "not a complete document"), ("<osm><way/>", "not a complete document")):
        assert acquire.body_error(body, True) == want


def test_tiles_count_in_numeric_order(spark):
    body = lambda lat: f"<osm><node id='1' lat='{lat}' lon='4'><tag k='a' v='1'/><tag k='a' v='{lat}'/></node><node id='1' lat='{lat + 0.5}' lon='4'/><way id='7'><nd ref='{int(lat)}'/><nd ref='x'/><tag k='t' v='{lat}'/></way><way id='{'9' * 23}'/></osm>"
    bodies = spark.createDataFrame([("10_0", body(10)), ("2_0", body(2)), ("2_10", body(3)), ("9_9", None), ("8_8", "<osm")], "tile string, body string").repartition(3)
    nodes, ways = acquire.elements_of(bodies)
    assert [(r.id, r.lat, r.tags) for r in nodes.collect()] == [(1, 10.5, {})]
    assert [(r.id, r.nodes, r.tags) for r in ways.collect()] == [(7, [2, None], {"t": "2"})]
    late = spark.createDataFrame([("x0_0", body(5)), ("3_3", body(4))], "tile string, body string")
    assert acquire.elements_of(late)[0].first().lat == 5.5


def test_area_modes(spark):
    small, wide = (50.0, 4.0, 50.01, 4.01), (50.0, 4.0, 50.05, 4.4)
    want = acquire.profile("generation")

    def get(fails):
        def run(q):
            if "amenity" in q and fails(q) or "way[" in q and fails("way" + q):
                raise acquire.FetchError("gone")
            return CITY

        return run

    one = lambda q: "(50.0,4.0,50.01,4.01)" in q
    for box, fails, mode in ((small, lambda q: False, "roads_and_amenities"), (small, lambda q: not q.startswith("way"), "roads_only"), (wide, lambda q: False, "tiled_roads_and_amenities"), (wide, lambda q: not q.startswith("way"), "tiled_roads_only"), (wide, lambda q: not q.startswith("way") and "4.4)" in q, "tiled_roads_plus_partial_amenities")):
        assert acquire.fetch_area(spark, box, get(fails), want)[2] == mode
    assert acquire.fetch_area(spark, small, get(one), acquire.profile("road_cache"))[2] == "tiled_roads"
    assert acquire.fetch_area(spark, small, get(lambda q: False), acquire.profile("road_cache"))[2] == "roads_only"


def test_streams(spark, tmp_path):
    from datetime import datetime

    from waymesh.streaming import feeds

    df = spark.createDataFrame([(1, datetime(2025, 1, 1, 5, 10), "a"), (1, datetime(2025, 1, 1, 5, 10), "a"), (2, datetime(2025, 1, 1, 6, 10), "a")], "id long, ts timestamp, kind string")
    df.write.parquet(str(tmp_path / "in"))
    for name, build in (("once", lambda s: feeds.once_within(s, ["id"], "ts")), ("hours", lambda s: feeds.hourly_counts(s, "ts", "kind"))):
        q = build(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("append" if name == "once" else "update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("once").count() == 2 and {r.n for r in spark.table("hours").collect()} == {2, 1}
