"""The record operators against brute force and on awkward input."""

import math
import random
from datetime import datetime

import pytest

from plain_decoders import json_ways, xml_nodes
from waymesh.operators import compare, nested, orphans, proximity


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * proximity.EARTH_M * math.asin(min(1, math.sqrt(h)))


def cloud(seed, n, first):
    r = random.Random(seed)
    spots = [(10.0, 20.0), (69.9, 179.9995), (69.9, -179.9995), (89.9995, 3.0), (89.9995, -170.0), (-45.0, 7.0)]
    out = []
    for i in range(n):
        y, x = r.choice(spots)
        y, x = min(90.0, y + r.uniform(-0.002, 0.002)), x + r.uniform(-0.004, 0.004)
        out.append((first + i, y, x - 360 if x > 180 else x + 360 if x < -180 else x))
    return out


def test_near_pairs_equals_brute_force(spark):
    a, b = cloud(1, 300, 0), cloud(2, 500, 10_000)
    a += [(900, a[0][1], a[0][2]), a[5], a[5]]  # a coincident point and repeated rows
    fa, fb = (spark.createDataFrame(x, "id long, lat double, lon double") for x in (a, b))
    got = proximity.near_pairs({"a": fa.repartition(3), "b": fb}, [proximity.Near("aa", "a", "a", 100.0), proximity.Near("ab", "a", "b", 60.0)])
    want = {("aa", min(p[0], q[0]), max(p[0], q[0])) for p in a for q in a if p[0] != q[0] and metres(p, q) <= 100}
    want |= {("ab", p[0], q[0]) for p in a for q in b if metres(p, q) <= 60}
    found = [tuple(r)[:3] for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 300


def test_near_pairs_of_nothing(spark):
    none = spark.createDataFrame([], "id long, lat double, lon double")
    assert rows(proximity.near_pairs({"a": none}, [proximity.Near("aa", "a", "a", 5.0)])) == []


def test_usable_points(spark):
    nan, inf = float("nan"), float("inf")
    raw = [(1, 1.0, 2.0), (None, 1.0, 2.0), (2, None, 1.0), (3, nan, 1.0), (4, inf, 1.0), (5, 91.0, 0.0), (6, 0.0, 0.0), (7, 0.0, 181.0), (8, 0.0, 5.0)]
    df = spark.createDataFrame([(*r, "x") for r in raw], "poi long, lat double, lon double, id string")
    assert [r[0] for r in rows(proximity.usable(df, "poi"))] == [1, 8]


def test_regions(spark):
    star = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    ring = "zone long, ring array<struct<lon: double, lat: double>>, id string"
    zones = [(1, star, "x"), (2, star[::-1] + [star[-1]], None), (3, star[:2], None), (4, None, None), (5, [*star, (None, 1.0)], None), (None, star, None), (1, star, "x")]
    pts = [(10, 0.5, 0.5), (11, 3.0, 2.0), (12, 3.0, 0.2), (13, 5.0, 5.0), (10, 0.5, 0.5)]
    got = proximity.regions_of_points(spark.createDataFrame(pts, "id long, lat double, lon double"), spark.createDataFrame(zones, ring), "zone", "ring")
    assert rows(got) == [(1, 10), (1, 12), (2, 10), (2, 12)]


def t(day):
    return None if day is None else datetime(2025, 1 + (day - 1) // 28, 1 + (day - 1) % 28)


def test_orphans(spark):
    parents = [(1, True, t(1), 0), (2, True, t(1), 0), (2, False, t(3), 0), (3, False, t(1), 0), (3, None, t(2), 0), (4, True, t(40), 0), (5, False, t(2), 0), (5, True, t(2), 0), (6, False, None, 0), (None, True, t(1), 0)]
    states = orphans.parent_states(spark.createDataFrame(parents, "id long, visible boolean, at timestamp_ntz, ref_id int"), "id", "at", "visible")
    refs = [("w", 7, t(20), [1, 2, 3, 4, 5, 6, None, 9, 9]), ("w", 7, t(30), None), ("w", 7, t(35), [4]), ("w", 8, None, [4, 9]), ("w", 10, t(50), []), ("w", None, t(29), [9])]
    got = orphans.by_month(orphans.orphan_references(orphans.references(spark.createDataFrame(refs, "ref_table string, owner_id long, at timestamp_ntz, refs array<long>")), states))
    jan = "2025-01"
    want = [("w", None, 8, 9, "missing"), ("w", jan, 7, 2, "deleted"), ("w", jan, 7, 4, "late"), ("w", jan, 7, 6, "deleted"), ("w", jan, 7, 9, "missing"), ("w", "2025-02", None, 9, "missing")]
    assert rows(got) == sorted(want, key=repr)
    assert sum(r[3] for r in rows(orphans.orphan_report(got))) == 6


def test_local_orphans(spark):
    g = [(1, t(1), [5, 6, None, 7], [5]), (1, t(2), None, [6]), (2, t(1), [5], None), (3, t(1), [], [1])]
    got = orphans.local_orphans(spark.createDataFrame(g, "owner_id long, at timestamp_ntz, ends array<long>, held array<long>"), "e", "ends", "held")
    assert [(r.owner_id, r.ref_id) for r in got.collect()] in ([(1, 7), (2, 5)], [(2, 5), (1, 7)])


def test_compare(spark):
    nan = float("nan")
    kind = "g long, u long, w double, c int, at timestamp_ntz, a string, b string"
    left = [(1, 1, 5.0, 2, t(1), "x", "y"), (1, 1, 9.0, 2, t(2), None, None), (1, 2, None, 1, t(1), "", ""), (1, 3, nan, None, None, "", ""), (1, 4, 1.0, 1, t(1), "", ""), (None, 1, 1.0, 1, t(1), "", ""), (1, 6, 1.0, 1, t(1), "", "")]
    right = [(1, 1, 9.0005, 2, t(1), "", ""), (1, 2, 3.0, 2, t(1), "", ""), (1, 3, nan, None, t(3), "", ""), (1, 5, 1.0, 1, t(1), "", ""), (None, 1, 1.0, 1, t(1), "", ""), (1, 6, 1.002, None, t(1), "", "")]
    rules = [compare.FieldRule("w", 0.001), compare.FieldRule("c")]
    l, r = (spark.createDataFrame(x, kind) for x in (left, right))
    got = [tuple(x)[:3] for x in rows(compare.compare_copies(l, r, ["g", "u"], rules, "at"))]
    assert got == sorted([(1, 2, "w"), (1, 2, "c"), (1, 4, "only_a"), (1, 5, "only_b"), (1, 6, "w"), (1, 6, "c")], key=repr)
    assert {x[2] for x in rows(compare.compare_copies(l.limit(0), r, ["g", "u"], rules, "at"))} == {"only_b"}


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []),
        ("", []),
        ('{"a": [1, ', []),
        ('{"a": NaN}', []),
        ('{"type": "way", "id": "7", "nodes": [1, null, "x"], "tags": {"a": 1.50, "b": true, "c": null, "d": ""}}', [(7, ["1", None, "x"], [("a", "1.50"), ("b", "true"), ("c", None), ("d", "")])]),
        ('[{"x": {"type": "way", "id": 8, "nd": {"ref": 2}, "tag": {"k": "q", "v": " é "}}}]', [(8, ["2"], [("q", " é ")])]),
        ('{"type": "way", "nd": [{"ref": null}], "tag": [{"v": 1}], "tags": null}', [(None, [None], [])]),
    ],
)
def test_json_ways(text, want):
    assert json_ways(text) == want


def test_xml_nodes():
    assert xml_nodes('<?xml version="1.0"?>\n<node id="1"><!-- <tag k="z" v="1"/> --><tag v="a &amp; b" k="n"></tag><tag k="e" v=""/><x><tag k="deep" v="1"/></x></node>') == [(1, [], [("n", "a & b"), ("e", "")])]
    assert xml_nodes("  <osm><node id='x'/><node id='2'><tag k='a' v='1'/></node></osm> ") == [(None, [], []), (2, [], [("a", "1")])]
    assert [xml_nodes(x) for x in (None, "", "<node", "<node></nod>", '<node note="a < b"/>')] == [[]] * 5


def test_flat_children(spark):
    data = [(1, '{"type": "way", "id": 5, "nodes": [9, null, 9], "tags": {"k": ""}}', "c", 0), (2, None, "c", 0), (3, "{", "c", 0), (4, "", None, 0)]
    got = nested.flat_children(spark.createDataFrame(data, "raw long, payload string, text string, parent_id int"), "raw", "payload", "json_ways")
    assert rows(got) == [(1, 5, "nd", "0", "9"), (1, 5, "nd", "2", "9"), (1, 5, "tag", "k", "")]
    twice = '{"e": [{"type": "way", "id": 5, "nodes": [9]}, {"type": "way", "id": 5, "nodes": [9, 8]}]}'
    got = nested.flat_children(spark.createDataFrame([(1, twice)], "raw long, payload string"), "raw", "payload", "json_ways")
    assert rows(got) == [(1, 5, "nd", "0", "9"), (1, 5, "nd", "1", "8")]
    got = nested.flat_children(spark.createDataFrame([(1, 77, "<node><tag k='a' v='b'/></node>")], "rec long, id long, xml string"), "rec", "xml", "xml_nodes", "id")
    assert rows(got) == [(1, 77, "tag", "a", "b")]


def test_open_column(spark):
    df = spark.createDataFrame([(1, [(2, "a"), None], {"x": "y"}), (2, [], {}), (3, None, None)], "id long, items array<struct<id: int, s: string>>, m map<string, string>")
    items = nested.open_column(df, ["id"], "items")
    assert items.columns == ["id", "place", "items_id", "s"] and rows(items) == [(1, 0, 2, "a"), (1, 1, None, None)]
    assert rows(nested.open_column(df, ["id"], "m")) == [(1, 0, "x", "y")]
