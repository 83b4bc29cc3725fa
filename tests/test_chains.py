"""The chains from map records to files on a small grid town."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from waymesh.operators import roads, schedules
from waymesh.plans import chains, pipeline

DAY = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    n = [(10 * y + x, 50 + y * 0.002, 4 + x * 0.003, "grid", True, DAY) for y in range(6) for x in range(6)]
    w = [(100 + k, [10 * k + x for x in range(6)], {"highway": "residential"}, "grid", DAY) for k in range(6)] + [(200 + k, [10 * y + k for y in range(6)], {"highway": "primary"}, "grid", DAY) for k in range(6)]
    nodes = roads.latest_nodes(spark.createDataFrame(n, "id long, lat double, lon double, city string, visible boolean, fetched_at timestamp_ntz"))
    ways = roads.roadways(roads.first_ways(spark.createDataFrame(w, "id long, nodes array<long>, tags map<string, string>, city string, fetched_at timestamp_ntz")))
    pois = spark.createDataFrame([("grid", k, 50 + (k % 6) * 0.002, 4 + (k % 5) * 0.003) for k in range(12)], "city string, point_id long, lat double, lon double")
    out = str(tmp_path_factory.mktemp("out"))
    return chains.generate(nodes, ways, pois, pipeline.Request(n=8, method="hybrid"), out), nodes, out


def test_generate(made):
    got, _, out = made
    assert got["nodes"].count() == 9 and got["costs"].count() == 3 * 72 and got["costs"].where("cost IS NULL").count() == 0 and got["texts"].count() == 3
    flat, short = ({(r.i, r.j): r.cost for r in got["costs"].where(F.col("metric") == m).collect()} for m in ("euclidean", "shortest"))
    assert all(short[k] >= flat[k] - 1 for k in flat)
    from pathlib import Path

    meta = json.loads(next(Path(out, "metadata").rglob("*.txt")).read_text())
    assert meta["schema_version"] == 2 and [x["instance_node_id"] for x in meta["nodes"]] == list(range(1, 10)) and meta["nodes"][0]["source_tag"] == "depot"


@pytest.mark.parametrize("method", ["route_centered", "reachable_interval"])
def test_derive_windows(spark, made, method):
    from pathlib import Path

    from waymesh.sources import instances

    _, _, out = made
    path = next(p.parent for p in Path(out, "instances").rglob("*.txt") if "fastest" in p.parent.name)
    texts = chains.derive_windows(spark, str(path), method, 5)
    x = instances.parsed(texts.select(F.col("name").alias("path"), "value")).first()
    assert x.type == "CVRPTW" and tuple(x.windows[0]) == (0, 86400) and x.services[0] == 0 and all(s > 0 for s in x.services[1:]) and all(w.earliest <= w.latest for w in x.windows)


def test_derive_traffic(made):
    got, nodes, _ = made
    places = got["nodes"].select("city", "i", "node_id")
    fast = got["costs"].where("metric = 'fastest'").select("city", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "cost")
    routes = schedules.nearest_tours(fast).select("city", F.lit("anchor").alias("run"), F.lit(0).alias("route_idx"), "route")
    stops = places.select("city", F.col("i").cast("long").alias("node"), F.lit(60).alias("service"), F.lit(0).alias("earliest"), F.when(F.col("i") == 0, 86400).otherwise(5).cast("long").alias("latest"))
    out = chains.derive_traffic(got["edges"], pipeline.vertices_of(got["edges"], nodes), places, stops, routes, [("wave", "light"), ("bpr", "heavy")], 3)
    assert out["late"].count() == 0 and out["windows"].where("node > 0 AND lift > 0").count() == 8
    assert {(r.model, r.intensity) for r in out["speeds"].select("model", "intensity").distinct().collect()} == {("wave", "light"), ("bpr", "heavy")}
    assert out["functions"].count() == 18


def test_names():
    assert chains.base_name("Ville", 20, "hyb", 4, "s7") == "ville-n21-hyb-k4-s7"
