"""Structural indexes against record-by-record decoders, on texts that are right, wrong and odd."""

import json
import random

import pyarrow as pa
import pytest
from plain_decoders import json_ways, xml_nodes

from waymesh.functions import columnar
from waymesh.functions.markup import whole_number


def flat(found):
    n = len(found.record)
    refs, tags = [[] for _ in range(n)], [[] for _ in range(n)]
    for e, p, v in zip(found.ref_element.tolist(), found.ref_place.tolist(), found.refs.to_pylist()):
        assert len(refs[e]) == p
        refs[e].append(v)
    for e, k, v in zip(found.tag_element.tolist(), found.tag_keys.to_pylist(), found.tag_values.to_pylist()):
        tags[e].append((k, v))
    return list(zip(found.record.tolist(), found.ids.to_pylist(), refs, tags))


def plain(decode, texts):
    return [(i, *e) for i, t in enumerate(texts) for e in decode(t)]


def value(r, depth):
    kind = r.randint(0, 9 if depth else 4)
    if kind < 5:
        return r.choice([None, True, False, 0, -12, 1.5, 1e30, "", "way", "é\\\"\n😀", "a: {b}, [c]", "1_0", 10**22, "7"])
    if kind < 7:
        return [value(r, depth - 1) for _ in range(r.randint(0, 4))]
    keys = ["type", "id", "nodes", "nd", "ref", "tags", "tag", "k", "v", "x", "q\\u"]
    o = {k: value(r, depth - 1) for k in r.sample(keys, r.randint(0, 5))}
    if r.random() < 0.6:
        o["type"] = "way"
    return o


@pytest.mark.parametrize("seed", range(6))
def test_json_ways_random(seed):
    r = random.Random(seed)
    texts = [None, "", " ", "{}", "[]", "null", "{", "}", "]", "[1,]", "[,1]", "[1 2]", '{"a"}', '{"a":}', '{"a":1,}', '{1:2}', '{"a":1 "b":2}', "[1]]", "[[1]", "[1}", '{"a":[}', "1 2", '"a" "b"', '"a"b', "tru", "01", "1.", ".5", "+1", "1e", "-", "NaN", '"\t"', '"\\x"', '"\\u12"', '"\\u12g4"', '"abc', "abc\\", '\\"', '{"a":"\\\\"}', "1", '"x"', "[-0.0e+5]", ":", ",", '[{"type":"way"}] x', "﻿{}", '{"type":"way","id":1,"id":"2"}', '{"a":{"type":"way","id":1},"a":3}', '{"type":"way","nodes":[1],"nodes":[2,3]}', '{"\\u0074ype":"wa\\u0079","id":4}']
    for _ in range(300):
        t = json.dumps(value(r, 5), ensure_ascii=r.random() < 0.5, separators=r.choice([(",", ":"), (", ", ": "), (" ,\n", " :\t")]))
        if r.random() < 0.3 and t:
            k = r.randrange(len(t))
            t = r.choice([t[:k], t[:k] + t[k + 1 :], t[:k] + r.choice('{}[]:,"\\ 1a') + t[k:], t[k:] + t[:k]])
        texts.append(t)
    r.shuffle(texts)
    boxes = lambda rows: [(i, e, [x if x is None or x[:1] not in "[{" else "box" for x in refs], [(k if k[:1] not in ("[", "{") else "box", v if v is None or v[:1] not in ("[", "{") else "box") for k, v in tags]) for i, e, refs, tags in rows]
    whole = lambda x: x if x is None else x.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    want = [(i, e, [whole(x) for x in refs], [(whole(k), whole(v)) for k, v in tags]) for i, e, refs, tags in plain(json_ways, texts)]
    assert boxes(flat(columnar.json_ways(pa.array(texts, pa.string())))) == boxes(want)


def test_json_is_found_at_any_depth():
    deep = '{"a":[' * 20_000 + '{"type":"way","id":5,"nodes":[1]}' + "]}" * 20_000
    assert flat(columnar.json_ways(pa.array([deep, '{"type":"way"}']))) == [(0, 5, ["1"], []), (1, None, [], [])]


@pytest.mark.parametrize("seed", range(6))
def test_xml_nodes_random(seed):
    r = random.Random(seed)
    texts = [None, "", "x", "<node/>", "<node></node>", "<node>", "</node>", "<node/><node/>", "<a><node id='1'/></b>", "<node id='1' id='2'/>", "<node id=1/>", "<node id='1'lat='2'/>", "<node a='<'/>", "<node a='>'/>", "<node a='&'/>", "<node a='&x;'/>", "<node a='&#0;'/>", "<node a='&#55296;'/>", "<node a='&#x41;&#65;'/>", "<node>text</node>", "<node>&amp;</node>", "<!-- a -- b --><node/>", "<!-- a --><node/><!-- b -->", "<node><!-- <tag k='1' v='2'/> --></node>", "<node><![CDATA[<x>]]></node>", "<?xml version='1.0'?><node id='3'/>", " <?xml version='1.0'?><node/>", '<?xml version="1.0" encoding="UTF-8"?>\n<node id="4"/>', "<!DOCTYPE node><node id='5'/>", "<node id='1'/>x", "x<node id='1'/>", "<osm><node id='1'><tag k='a' v='b'/></node><x><node id='2'><y><tag k='c' v='d'/></y></node></x></osm>", "<node><node id='7'><tag k='a' v='1'/></node><tag k='b' v='2'/></node>", "<node><tag k='a'/><tag v='b'/><tag k='' v=''/></node>", "<node é='1' id='9'/>", "<node id='1\n2' a='x\ty'/>", "<node><tag k='a\nb' v=' \t&#10;c&amp;lt; '/></node>", '<node><tag k=\'say "x"\' v="it\'s"/></node>', "<node id='99999999999999999999999'/>", "<node id=' +12 '/>", "<node id='1_0'/>", "<node id='٣'/>", "<node id='-9223372036854775808'/>", "<node id='9223372036854775808'/>", "<node\nid='8'\n></node\n>", "<node id = '8' />", "<-node/>", "<node / >", "< node/>", "<node>\x01</node>", "<Node id='1'/>", "]]>", "<node>]]></node>"]
    for _ in range(300):
        q = r.choice("'\"")
        tags = "".join(r.choice([f"<tag k={q}{r.choice('abc')}{q} v={q}{r.choice(['', ' ', 'é😀', '&quot;&#233;&#xFC;', 'x y', '&amp;amp;'])}{q}{r.choice(['/>', '></tag>', ' />'])}", "<!-- <tag k='z' v='1'/> -->", "\n\t", "<tag/>", "<way><nd/></way>"]) for _ in range(r.randint(0, 6)))
        t = f"<node id={q}{r.randint(-5, 10**12)}{q} lat={q}1.5{q}>{tags}</node>"
        if r.random() < 0.3:
            k = r.randrange(len(t))
            t = r.choice([t[:k], t[:k] + t[k + 1 :], t[:k] + r.choice("<>/&'\" =a") + t[k:]])
        texts.append(r.choice([t, f"<osm>{t}{t}</osm>", " " + t + "\n"]))
    r.shuffle(texts)
    assert flat(columnar.node_elements(pa.array(texts, pa.string()))) == plain(xml_nodes, texts)


def test_whole_numbers():
    texts = ["1", " -7 ", "+0", "1_0", "٣", "", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "1.0", "9" * 23, None, "0x1"]
    want = [1, -7, 0, None, None, None, 2**63 - 1, None, -(2**63), None, None, None, None]
    assert columnar.whole_numbers(pa.array(texts)).to_pylist() == want == [whole_number(t) for t in texts]


def test_numbers():
    texts = ["1.5", " -2e1 ", "+.5", "1.", "n/a", "1_0", "nan", "", None, "1e400"]
    got = columnar.numbers(pa.array(texts)).to_pylist()
    assert got[:4] == [1.5, -20.0, 0.5, 1.0] and got[4:9] == [None] * 5


def test_nothing():
    for texts in ([], [None], [""]):
        a = pa.array(texts, pa.string())
        assert flat(columnar.json_ways(a)) == [] == flat(columnar.node_elements(a))
