"""Field-by-field survivors against brute force."""

import random
from datetime import datetime

from pyspark.sql import functions as F

import re

import pyarrow as pa

from waymesh.functions.markup import whole_number, xml_elements
from waymesh.llm import survivor

NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", re.ASCII)


def brute(text):
    """What one text supplies, parsed by itself."""
    found = xml_elements(text)
    if not found:
        return None, []
    attrs, tags = found[0]
    lat, lon = (float(attrs[k]) if k in attrs and NUMBER.fullmatch(attrs[k]) else None for k in ("lat", "lon"))
    ok = lat is not None and lon is not None and abs(lat) <= 90 and abs(lon) <= 180 and (lat or lon)
    own = {k: v for k, v in tags if v.strip()}
    return whole_number(attrs.get("id")), [*([("coord", f"{attrs['lat'].strip()} {attrs['lon'].strip()}")] if ok else []), *own.items()]


def supplied(texts):
    ids, record, fields, values = survivor.supplied(pa.array(texts, pa.string()))
    out = [(i, []) for i in ids.to_pylist()]
    for r, f, v in zip(record.tolist(), fields.to_pylist(), values.to_pylist()):
        out[r][1].append((f, v))
    return out

KIND = "rec_id long, id long, xml string, feed string, fetched_at timestamp_ntz, trust string, field int"


def t(day):
    return None if day is None else datetime(2025, 1, day)


def test_supplied():
    ok = "<node id='5' lat='1.5' lon=' -2e1 '><tag k='a' v=' '/><tag k='b' v=' x '/></node>"
    odd = [f"<node id='5' lat='{lat}' lon='{lon}'/>" for lat, lon in (("0", "0"), ("n/a", "1"), ("", "1"), ("91", "1"), ("1", "181"), ("nan", "1"), ("1_0", "1"), ("-0.0", "+.0"), ("1.", "+2"))]
    more = ["<osm><node id='1'/><node id='2' lat='1' lon='1'/></osm>", "<node id='3'><tag k='a' v='1'/><tag k='a' v=' '/><tag k='a' v='2'/><tag k='a' v=''/></node>", "<node id='4'><tag k='a' v='\u2003'/></node>", "<node id='5'", None, "", f"<node id='{'9' * 23}' lat='1' lon='1'/>", "<node><![CDATA[x]]><tag k='c' v='d'/></node>"]
    texts = [ok, *odd, *more]
    got = supplied(texts)
    assert got == [(i, fields) for i, fields in map(brute, texts)]
    assert got[0] == (5, [("coord", "1.5 -2e1"), ("b", " x ")]) and supplied([]) == []


def test_an_id_beyond_64_bits(spark):
    rows = [(1, None, f"<node id='{'9' * 23}' lat='1' lon='1'/>"), (2, 7, "<node id='1' lat='1' lon='1'/>"), (3, 7, None)]
    df = spark.createDataFrame(rows, "rec_id long, id long, xml string").selectExpr("*", "'a' AS feed", "CAST(NULL AS TIMESTAMP_NTZ) AS fetched_at")
    got = survivor.merge_fields(df, spark.createDataFrame([], "feed string, trust int"))
    assert [tuple(x) for x in got.collect()] == [(7, "coord", 2, "1 1")]


def test_merge_fields(spark):
    r = random.Random(4)
    trust = {"a": 3, "b": 3, "c": 1}
    rows = []
    for rec in range(600):
        i = 1 if rec % 3 == 0 else r.randint(2, 150)
        tags = "".join(f'<tag k="{k}" v="{r.choice(["", " ", "v", "w"])}"/>' for k in "xyz" if r.random() < 0.5)
        xml = r.choice([None, "<node", f'<node id="{i}" lat="{r.choice(["1", "n/a", "95"])}" lon="2">{tags}</node>'])
        rows.append((rec, r.choice([i, i, None]), xml, r.choice(["a", "b", "c", "d", None]), t(r.choice([None, 1, 2])), "junk", 0))
    best, count = {}, {}
    for rec, i, xml, feed, at, *_ in rows:
        parsed, fields = brute(xml)
        i = i if i is not None else parsed
        if i is None:
            continue
        count[i] = count.get(i, 0) + 1
        for f, v in fields:
            best[i, f] = max(best.get((i, f), ((-1,),)), ((trust.get(feed, 0), at or datetime.min, rec), v))
    want = {(i, f, v[0][2], v[1]) for (i, f), v in best.items() if count[i] > 1}
    ranks = spark.createDataFrame([*trust.items(), ("c", 0), (None, 9)], "feed string, trust int")
    got = survivor.merge_fields(spark.createDataFrame(rows, KIND).repartition(5), ranks)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    one = {x.id: x for x in survivor.survivors(got).collect()}
    assert set(one) == {x[0] for x in want} and one[1].sources["coord"] == best[1, "coord"][0][2] and one[1].lat == 1.0


def test_merge_nothing(spark):
    ranks = spark.createDataFrame([], "feed string, trust int")
    assert survivor.merge_fields(spark.createDataFrame([], KIND), ranks).collect() == []


def test_best_rows(spark):
    df = spark.createDataFrame([(1, "a", None, 5), (1, None, None, 9), (1, "b", None, 5), (None, "c", "d", 1), (None, None, None, 2)], "k int, x string, y string, at int")
    got = survivor.best_rows(df, ["k"], [F.desc(survivor.completeness("x", "y")), F.desc("at"), F.desc("x")])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [(1, "b", None, 5), (None, "c", "d", 1)]
