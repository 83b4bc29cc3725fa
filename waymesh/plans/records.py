"""Queries of the record operators over the whole tables: p2, p3, p5 and p6, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.operators import compare, nested, orphans, proximity
from waymesh.session import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """POIs within 100 m of each other, nodes within 25 m of a POI, and zones that contain a POI."""
    poi = proximity.usable(table(spark, sf, "poi"), "poi_id")
    node = proximity.usable(table(spark, sf, "osm_node"), "id")
    rules = [proximity.Near("poi_poi", "poi", "poi", 100.0), proximity.Near("poi_node", "poi", "node", 25.0)]
    bounds = proximity.strip_bounds(poi.unionByName(node))
    pairs = proximity.near_pairs({"poi": poi, "node": node}, rules, bounds).select("kind", "first_id", "second_id")
    held = proximity.regions_of_points(poi, table(spark, sf, "city_zone"), "zone_id", "ring", bounds)
    return pairs.unionByName(held.select(F.lit("poi_zone").alias("kind"), F.col("region_id").alias("first_id"), F.col("point_id").alias("second_id")))


def _p3(spark: SparkSession, sf: str) -> DataFrame:
    way, bridge = table(spark, sf, "osm_way"), table(spark, sf, "bridge_graph")
    states = orphans.parent_states(table(spark, sf, "osm_node"), "id", "fetched_at", "visible")
    ways = way.select(F.lit("osm_way").alias("ref_table"), F.col("id").alias("owner_id"), F.col("fetched_at").alias("at"), F.col("nodes").alias("refs"))
    spots = bridge.select(F.lit("bridge_vertex").alias("ref_table"), F.col("bridge_id").alias("owner_id"), F.col("published_at").alias("at"), F.col("vertices.osm_id").alias("refs"))
    outer = orphans.orphan_references(orphans.references(ways.unionByName(spots)), states)
    ends = bridge.select(F.col("bridge_id").alias("owner_id"), F.col("published_at").alias("at"), F.concat(F.col("edges.osm_u"), F.col("edges.osm_v")).alias("ends"), F.coalesce(F.col("vertices.osm_id"), F.array().cast("array<bigint>")).alias("held"))
    return orphans.by_month(outer.unionByName(orphans.local_orphans(ends, "bridge_edge", "ends", "held")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """References from ways, bridge edges and bridge vertices to something missing, deleted or late."""
    return _p3(spark, sf)


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per table, month and status."""
    return orphans.orphan_report(_p3(spark, sf))


_EDGE_RULES = [compare.FieldRule("edge_weight", 0.001), compare.FieldRule("edge_class")]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Edges missing in either copy of the road edges and those whose weight or class differ."""
    found = compare.compare_copies(table(spark, sf, "road_edge"), table(spark, sf, "road_edge_mirror"), ["graph_id", "osm_u", "osm_v"], _EDGE_RULES, "loaded_at")
    return found.select("graph_id", "osm_u", "osm_v", "finding")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Findings between the two copies per graph."""
    return compare.difference_report(table(spark, sf, "road_edge"), table(spark, sf, "road_edge_mirror"), ["graph_id", "osm_u", "osm_v"], _EDGE_RULES, "loaded_at", ["graph_id"])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Node references and tags of all ways in the tile payloads, and tags of all nodes in the XML store, as flat rows."""
    tiles = nested.flat_children(table(spark, sf, "tile_raw"), "raw_id", "payload", "json_ways")
    nodes = nested.flat_children(table(spark, sf, "nodes"), "rec_id", "xml", "xml_nodes", fallback="id")
    return tiles.withColumn("parent_table", F.lit("tile_raw")).unionByName(nodes.withColumn("parent_table", F.lit("nodes"))).select("parent_table", "parent_id", "element_id", "child_kind", "child_key", "child_value")


def p6_way_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The node references of the typed way table as a child table."""
    way = table(spark, sf, "osm_way").withColumn("seen_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))
    return nested.open_column(way, ["id", "seen_at"], "nodes").select("id", "seen_at", F.col("place").cast("long").alias("place"), F.col("value").alias("node_id"))


def p6_way_tags(spark: SparkSession, sf: str) -> DataFrame:
    """The tags of the typed way table as a child table."""
    return nested.open_column(table(spark, sf, "osm_way"), ["id", "fetched_at"], "tags").select("id", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("seen_at"), F.col("key").alias("tag_key"), F.col("value").alias("tag_value"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_report, p5_found, p5_report, p6_found, p6_way_nodes, p6_way_tags)}

_USABLE = "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0) AND NOT isnan(lat) AND NOT isnan(lon)"
_DIST = "2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_P3_SQL = """
st AS (SELECT id, min(fetched_at) AS first_seen, max(CASE WHEN visible IS NOT DISTINCT FROM false THEN fetched_at END) AS gone, max(CASE WHEN visible IS DISTINCT FROM false THEN fetched_at END) AS kept FROM osm_node WHERE id IS NOT NULL GROUP BY id),
own AS (
  SELECT 'osm_way' AS ref_table, id AS owner_id, min(fetched_at) AS t FROM osm_way GROUP BY id
  UNION ALL SELECT k, bridge_id, min(published_at) FROM bridge_graph, (VALUES ('bridge_vertex'), ('bridge_edge')) v(k) GROUP BY k, bridge_id),
ref AS (
  SELECT DISTINCT 'osm_way' AS ref_table, id AS owner_id, u.n AS ref_id FROM osm_way, unnest(nodes) AS u(n) WHERE u.n IS NOT NULL
  UNION SELECT DISTINCT 'bridge_vertex', bridge_id, u.v.osm_id FROM bridge_graph, unnest(vertices) AS u(v) WHERE u.v.osm_id IS NOT NULL),
outer_refs AS (
  SELECT ref.ref_table, own.t, ref.owner_id, ref.ref_id,
         CASE WHEN st.id IS NULL THEN 'missing' WHEN gone IS NOT NULL AND (kept IS NULL OR gone > kept) THEN 'deleted' WHEN first_seen > own.t THEN 'late' END AS ref_status
  FROM ref JOIN own ON own.ref_table = ref.ref_table AND own.owner_id = ref.owner_id LEFT JOIN st ON st.id = ref.ref_id),
ends AS (
  SELECT bridge_id, u.e.osm_u AS r FROM bridge_graph, unnest(edges) AS u(e) UNION SELECT bridge_id, u.e.osm_v FROM bridge_graph, unnest(edges) AS u(e)),
held AS (SELECT DISTINCT bridge_id, u.v.osm_id AS k FROM bridge_graph, unnest(vertices) AS u(v)),
found AS (
  SELECT ref_table, strftime(t, '%Y-%m') AS ref_month, owner_id, ref_id, ref_status FROM outer_refs WHERE ref_status IS NOT NULL
  UNION ALL
  SELECT 'bridge_edge', strftime(own.t, '%Y-%m'), ends.bridge_id, ends.r, 'missing' FROM ends JOIN own ON own.ref_table = 'bridge_edge' AND own.owner_id = ends.bridge_id
  WHERE ends.r IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held WHERE held.bridge_id = ends.bridge_id AND held.k = ends.r))
"""
_P5_SQL = """
a AS (SELECT * FROM road_edge QUALIFY row_number() OVER (PARTITION BY graph_id, osm_u, osm_v ORDER BY loaded_at DESC NULLS LAST, edge_weight DESC NULLS LAST, edge_class DESC NULLS LAST) = 1),
b AS (SELECT * FROM road_edge_mirror QUALIFY row_number() OVER (PARTITION BY graph_id, osm_u, osm_v ORDER BY loaded_at DESC NULLS LAST, edge_weight DESC NULLS LAST, edge_class DESC NULLS LAST) = 1),
j AS (
  SELECT coalesce(a.graph_id, b.graph_id) AS graph_id, coalesce(a.osm_u, b.osm_u) AS osm_u, coalesce(a.osm_v, b.osm_v) AS osm_v, a.graph_id IS NOT NULL AS in_a, b.graph_id IS NOT NULL AS in_b,
         a.edge_weight AS wa, b.edge_weight AS wb, a.edge_class AS ca, b.edge_class AS cb
  FROM a FULL JOIN b ON a.graph_id = b.graph_id AND a.osm_u = b.osm_u AND a.osm_v = b.osm_v),
found AS (
  SELECT graph_id, osm_u, osm_v, 'only_a' AS finding FROM j WHERE NOT in_b
  UNION ALL SELECT graph_id, osm_u, osm_v, 'only_b' FROM j WHERE NOT in_a
  UNION ALL SELECT graph_id, osm_u, osm_v, 'edge_weight' FROM j WHERE in_a AND in_b AND ((wa IS NULL) <> (wb IS NULL) OR abs(wa - wb) > 0.001)
  UNION ALL SELECT graph_id, osm_u, osm_v, 'edge_class' FROM j WHERE in_a AND in_b AND ca IS DISTINCT FROM cb)
"""


def _plain_sql(c: str) -> str:
    """Entities of the test tables resolved."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#233;", "é"), ("&#xFC;", "ü"), ("&amp;", "&")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _attribute_sql(text: str, name: str) -> str:
    return " || ".join(f"regexp_extract({text}, '\\s{name}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)'')', {i})" for i in (1, 2))


_XML_ATTR = r"""(?:\s+[\w:]+\s*=\s*(?:"[^"<]*"|''[^''<]*''))*\s*"""
_HEAD = "regexp_extract(t, '<node[^<>]*>')"
#: own (rec_id, place, k, v) and said (rec_id, i, lat, lon) of the well-formed texts of nodes.xml, which hold one node each.
XML_SQL = rf"""
x AS (SELECT rec_id, regexp_replace(xml, '<!--(?:[^-]|-[^-])*-->', '', 'g') AS t FROM nodes
  WHERE regexp_full_match(xml, '\s*(?:<\?xml[^?]*\?>)?\s*<node{_XML_ATTR}(?:/>|>(?:\s|<!--(?:[^-]|-[^-])*-->|<tag{_XML_ATTR}(?:/>|>\s*</tag\s*>))*</node\s*>)\s*')),
raw AS (SELECT rec_id, unnest(regexp_extract_all(t, '<tag\s[^<>]*>')) AS tag, unnest(range(len(regexp_extract_all(t, '<tag\s[^<>]*>')))) AS place FROM x),
own AS (SELECT rec_id, place, {_plain_sql(_attribute_sql("tag", "k"))} AS k, {_plain_sql(_attribute_sql("tag", "v"))} AS v FROM raw WHERE regexp_matches(tag, '\sk\s*=') AND regexp_matches(tag, '\sv\s*=')),
said AS (SELECT rec_id, {_attribute_sql(_HEAD, "id")} AS i, {_attribute_sql(_HEAD, "lat")} AS lat, {_attribute_sql(_HEAD, "lon")} AS lon FROM x)"""

ORACLES = {
    "p2_found": f"""
WITH p AS (SELECT DISTINCT poi_id AS id, lat, lon FROM poi WHERE {_USABLE}), n AS (SELECT DISTINCT id, lat, lon FROM osm_node WHERE {_USABLE}),
e AS (SELECT zone_id, ring[i].lon AS x1, ring[i].lat AS y1, ring[i % len(ring) + 1].lon AS x2, ring[i % len(ring) + 1].lat AS y2 FROM (SELECT zone_id, ring, unnest(range(1, len(ring) + 1)) AS i FROM city_zone))
SELECT 'poi_poi' AS kind, a.id AS first_id, b.id AS second_id FROM p a JOIN p b ON a.id < b.id AND abs(a.lat - b.lat) < 0.001 WHERE {_DIST} <= 100
UNION ALL SELECT 'poi_node', a.id, b.id FROM p a JOIN n b ON abs(a.lat - b.lat) < 0.001 WHERE {_DIST} <= 25
UNION ALL SELECT 'poi_zone', e.zone_id, p.id FROM e JOIN p ON (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY e.zone_id, p.id HAVING count(*) % 2 = 1
""",
    "p3_found": f"WITH {_P3_SQL} SELECT * FROM found",
    "p3_report": f"WITH {_P3_SQL} SELECT ref_table, ref_month, ref_status, count(*) AS n_refs, count(DISTINCT owner_id) AS n_owners FROM found GROUP BY ALL",
    "p5_found": f"WITH {_P5_SQL} SELECT * FROM found",
    "p5_report": f"WITH {_P5_SQL} SELECT graph_id, finding, count(*) AS n FROM found GROUP BY ALL",
    "p6_way_nodes": "SELECT id, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS seen_at, i - 1 AS place, nodes[i] AS node_id FROM (SELECT id, fetched_at, nodes, unnest(range(1, len(nodes) + 1)) AS i FROM osm_way)",
    "p6_way_tags": "SELECT id, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS seen_at, u.e.key AS tag_key, u.e.value AS tag_value FROM osm_way, unnest(map_entries(tags)) AS u(e)",
    "p6_found": f"""WITH {XML_SQL},
way AS (SELECT raw_id, j.value AS w, TRY_CAST(j.value->>'$.id' AS BIGINT) AS e FROM tile_raw, json_tree(CASE WHEN json_valid(payload) THEN payload END) j WHERE j.type = 'OBJECT' AND json_type(j.value, '$.type') = 'VARCHAR' AND j.value->>'$.type' = 'way'),
lists AS (SELECT raw_id, e, list_concat(CASE json_type(w, '$.nodes') WHEN 'ARRAY' THEN w->'$.nodes[*]' ELSE [] END, CASE json_type(w, '$.nd') WHEN 'ARRAY' THEN w->'$.nd[*]' WHEN 'OBJECT' THEN [w->'$.nd'] ELSE [] END) AS refs,
  CASE json_type(w, '$.tag') WHEN 'ARRAY' THEN w->'$.tag[*]' WHEN 'OBJECT' THEN [w->'$.tag'] ELSE [] END AS pairs, CASE json_type(w, '$.tags') WHEN 'OBJECT' THEN json_keys(w, '$.tags') ELSE [] END AS names, w FROM way),
child AS (
  SELECT raw_id, e, 'nd' AS c, CAST(unnest(range(len(refs))) AS VARCHAR) AS k, unnest(list_transform(refs, lambda r: CASE json_type(r) WHEN 'OBJECT' THEN r->>'$.ref' ELSE r->>'$' END)) AS v FROM lists
  UNION ALL SELECT raw_id, e, 'tag', unnest(list_transform(pairs, lambda r: r->>'$.k')), unnest(list_transform(pairs, lambda r: r->>'$.v')) FROM lists
  UNION ALL SELECT raw_id, e, 'tag', n, w->'$.tags'->>('$."' || n || '"') FROM (SELECT raw_id, e, w, unnest(names) AS n FROM lists))
SELECT DISTINCT 'tile_raw' AS parent_table, raw_id AS parent_id, e AS element_id, c AS child_kind, k AS child_key, v AS child_value FROM child WHERE k IS NOT NULL AND v IS NOT NULL
UNION ALL SELECT DISTINCT 'nodes', own.rec_id, coalesce(TRY_CAST(i AS BIGINT), id), 'tag', k, v FROM own JOIN said USING (rec_id) JOIN nodes USING (rec_id)""",
}
