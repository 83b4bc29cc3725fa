"""The DuckDB SQL of the network queries, written independently of the DataFrame plans."""

from __future__ import annotations

from waymesh.functions.scalars import CAPACITY_VEH_H, DEMAND_BANDS, FREE_KMH, ROAD_CLASSES, ROUTE_SIZE_BANDS
from waymesh.operators.schedules import WIDTHS
from waymesh.operators.traffic import AMPLITUDE

A, B = 6378137.0, 6356752.31424518
E2, EP2 = 1 - B * B / (A * A), A * A / (B * B) - 1


def case(table: dict, key: str) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"CASE {key} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items()) + " END"


def u(label: str, *key: str, seed: int | str = 7) -> str:
    text = " || '|' || ".join([f"'{seed}'", f"'{label}'", *(f"CAST({k} AS VARCHAR)" for k in key)])
    return f"((CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0)"


def g(label: str, *key: str, seed: int | str = 7) -> str:
    return f"(sqrt(-2 * ln({u(label + ':r', *key, seed=seed)})) * cos(6.283185307179586 * {u(label + ':a', *key, seed=seed)}))"


def hav(y1: str, x1: str, y2: str, x2: str) -> str:
    return f"(2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2)))))"


def radius(lat: str) -> str:
    return f"({A} / sqrt(1 - {E2!r} * sin(radians({lat})) * sin(radians({lat}))))"


def xyz(lat: str, lon: str) -> tuple[str, str, str]:
    n = radius(lat)
    return f"({n} * cos(radians({lat})) * cos(radians({lon})))", f"({n} * cos(radians({lat})) * sin(radians({lon})))", f"({n} * (1 - {E2!r}) * sin(radians({lat})))"


OK = "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0) AND NOT isnan(lat) AND NOT isnan(lon)"
X, Y, Z = xyz("lat", "lon")
#: The box of each city of spot; one whose points are less than half a turn apart across the antimeridian runs from w eastwards to e < w.
BOX = """
rim AS (SELECT city, min(lat) AS s, max(lat) AS nn, min(lon) AS w1, max(lon) AS e1, min(lon) FILTER (WHERE lon >= 0) AS w2, max(lon) FILTER (WHERE lon < 0) AS e2 FROM spot GROUP BY city),
side AS (SELECT *, coalesce(e1 - w1 > 180 AND e2 + 360 - w2 < 180, false) AS far FROM rim),
box AS (SELECT city, s, nn, CASE WHEN far THEN w2 ELSE w1 END AS w, CASE WHEN far THEN e2 ELSE e1 END AS e, (s + nn) / 2 AS y0, CASE WHEN NOT far THEN (w1 + e1) / 2 WHEN (w2 + e2) / 2 > 0 THEN (w2 + e2) / 2 - 180 ELSE (w2 + e2) / 2 + 180 END AS x0 FROM side)"""
N = f"""
n AS (SELECT id AS node_id, city, lat, lon, {X} AS x, {Y} AS y, {Z} AS z FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST, lat DESC NULLS LAST, lon DESC NULLS LAST, city DESC NULLS LAST, visible DESC NULLS LAST) AS k FROM osm_node WHERE id IS NOT NULL)
  WHERE k = 1 AND visible IS DISTINCT FROM false AND {OK}),
{BOX.replace('spot', 'n')}"""


def frame(points: str, box: str = "box") -> str:
    """points (city, lat, lon, ...) with east and north and up."""
    x, y, z = xyz("p.lat", "p.lon")
    a, b, c = xyz("b.y0", "b.x0")
    return f"""(SELECT *, cos(q) * dy - sin(q) * dx AS east, cos(f) * dz - sin(f) * (cos(q) * dx + sin(q) * dy) AS north, sin(f) * dz + cos(f) * (cos(q) * dx + sin(q) * dy) AS up
  FROM (SELECT p.*, b.y0, b.x0, radians(b.y0) AS f, radians(b.x0) AS q, {x} - {a} AS dx, {y} - {b} AS dy, {z} - {c} AS dz FROM {points} p JOIN {box} b ON p.city = b.city))"""


ROADS = f"""
way AS (SELECT id AS way_id, city, nodes, tags['highway'] AS highway, tags['oneway'] AS oneway, tags['junction'] AS junction, tags['visible'] AS vis FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at NULLS FIRST, nodes, tags::VARCHAR) AS k FROM osm_way WHERE id IS NOT NULL AND len(nodes) > 0) WHERE k = 1),
road AS (SELECT city, way_id, nodes, {case(ROAD_CLASSES, 'highway')} AS class,
  CASE WHEN oneway IN ('false', 'no', '0') THEN false WHEN oneway IN ('-1', 'true', 'yes', '1') THEN true ELSE highway IN ('motorway', 'motorway_link') OR coalesce(junction = 'roundabout', false) END AS one_way,
  coalesce(oneway = '-1', false) AS backward FROM way WHERE highway IN ({', '.join(f"'{k}'" for k in ROAD_CLASSES)}) AND coalesce(vis, '') <> 'false')"""
STEPS = f"""{N}, {ROADS},
step AS (SELECT r.city, way_id, class, one_way, backward, n.node_id, x, y, z, lat, lon, row_number() OVER (PARTITION BY way_id ORDER BY i) AS k, count(*) OVER (PARTITION BY way_id) AS kn
  FROM (SELECT *, unnest(nodes) AS nid, generate_subscripts(nodes, 1) AS i FROM road) r JOIN n ON n.node_id = r.nid)"""
EDGES = f"""{STEPS},
pair AS (SELECT *, lead(node_id) OVER w AS b, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2) + pow(lead(z) OVER w - z, 2)) AS len FROM step WINDOW w AS (PARTITION BY way_id ORDER BY k)),
dir AS (SELECT city, way_id, class, k, 0 AS d, node_id AS u, b AS v, len FROM pair WHERE b IS NOT NULL AND NOT backward UNION ALL SELECT city, way_id, class, k, 1, b, node_id, len FROM pair WHERE b IS NOT NULL AND (backward OR NOT one_way)),
edge AS (SELECT city, u, v, arg_max(class, (way_id, k, d)) AS class, min(len) AS length_m, min((way_id, k, d)) AS pos FROM dir GROUP BY city, u, v)"""
CROSS = f"""{STEPS},
crossing AS (SELECT city, node_id FROM step GROUP BY city, node_id HAVING bool_or(k = 1 OR k = kn) OR count(*) FILTER (WHERE k > 1 AND k < kn) >= 2)"""
SEGMENTS = CROSS + """,
cum AS (SELECT s.*, c.node_id IS NOT NULL AS cut, sum(coalesce(d, 0)) OVER (PARTITION BY way_id ORDER BY k) AS far FROM (
  SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS d FROM step WINDOW w AS (PARTITION BY way_id ORDER BY k)) s LEFT JOIN crossing c ON c.city = s.city AND c.node_id = s.node_id),
walk AS (
  SELECT way_id, k, k AS first, node_id AS start, far AS begun, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS len FROM cum WHERE k = 1
  UNION ALL
  SELECT w.way_id, c.k, CASE WHEN start <> c.node_id AND (c.cut OR c.k = c.kn) THEN c.k ELSE w.first END, CASE WHEN start <> c.node_id AND (c.cut OR c.k = c.kn) THEN c.node_id ELSE start END,
    CASE WHEN start <> c.node_id AND (c.cut OR c.k = c.kn) THEN c.far ELSE begun END, CASE WHEN start <> c.node_id AND (c.cut OR c.k = c.kn) THEN start END, CASE WHEN start <> c.node_id AND (c.cut OR c.k = c.kn) THEN c.node_id END, c.far - begun
  FROM walk w JOIN cum c ON c.way_id = w.way_id AND c.k = w.k + 1),
seg AS (SELECT r.city, w.way_id, r.class, w.k, a AS u, b AS v, len FROM walk w JOIN road r ON r.way_id = w.way_id WHERE a IS NOT NULL AND NOT backward UNION ALL SELECT r.city, w.way_id, r.class, w.k, b, a, len FROM walk w JOIN road r ON r.way_id = w.way_id WHERE a IS NOT NULL AND (backward OR NOT one_way))"""

BRIDGE = f"""
bg AS (SELECT CAST(bridge_id AS VARCHAR) AS city, edges, vertices FROM (SELECT *, row_number() OVER (PARTITION BY bridge_id ORDER BY published_at DESC NULLS LAST, osm_file DESC NULLS LAST, len(edges) DESC) AS k FROM bridge_graph WHERE bridge_id IS NOT NULL AND len(edges) > 0 AND len(vertices) > 0) WHERE k = 1),
raw AS (SELECT city, e.osm_u AS u, e.osm_v AS v, e.length_m AS length_m, e.road_class AS class FROM (SELECT city, unnest(edges) AS e FROM bg)),
be AS (SELECT city, u, v, arg_min(class, (length_m / {case(FREE_KMH, 'class')}, length_m, class)) AS class, arg_min(length_m, (length_m / {case(FREE_KMH, 'class')}, length_m, class)) AS length_m FROM raw WHERE u <> v AND length_m > 0 AND class BETWEEN 1 AND 8 GROUP BY city, u, v),
spot AS (SELECT city, t.osm_id AS node_id, min(t.lat) AS lat, min(t.lon) AS lon FROM (SELECT city, unnest(vertices) AS t FROM bg) WHERE t.osm_id IS NOT NULL AND t.lat IS NOT NULL AND t.lon IS NOT NULL GROUP BY ALL),
place AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY {u('place', 'node_id')}, node_id) - 1 AS i FROM spot)"""


def sssp(sources: str, weight: str, name: str = "best") -> str:
    """name: the least cost from every source over be, in rounds until no row gets better."""
    return f"""
{name} (city, source, node, cost) USING KEY (city, source, node) AS (SELECT city, source, source, CAST(0 AS DOUBLE) FROM ({sources}) UNION
  SELECT h.city, h.source, be.v, min(h.cost + {weight}) FROM {name} h JOIN be ON be.city = h.city AND be.u = h.node LEFT JOIN recurring.{name} r ON r.city = h.city AND r.source = h.source AND r.node = be.v
  WHERE r.cost IS NULL OR h.cost + {weight} < r.cost GROUP BY h.city, h.source, be.v)"""


def wave(intensity: str) -> str:
    jitter = u("jitter", "be.city", "be.u", "be.v")
    return f"""
mid AS (SELECT city, avg(lat) AS cy, avg(lon) AS cx FROM spot GROUP BY city),
wv AS (SELECT be.city, be.u, be.v, h.bin, {case(FREE_KMH, 'be.class')} / 3.6 AS free, h.rush, 0.35 + 0.65 * exp(-{hav('(a.lat + b.lat) / 2', '(a.lon + b.lon) / 2', 'm.cy', 'm.cx')} / 3000.0) AS share, 1 + (2 * {jitter} - 1) * 0.08 AS jit
  FROM be JOIN spot a ON a.city = be.city AND a.node_id = be.u JOIN spot b ON b.city = be.city AND b.node_id = be.v JOIN mid m ON m.city = be.city,
  (SELECT bin, least(1.0, exp(-pow(bin + 0.5 - 8.25, 2) / (2 * 1.1 * 1.1)) + 0.85 * exp(-pow(bin + 0.5 - 17.75, 2) / (2 * 1.5 * 1.5))) AS rush FROM (SELECT unnest(range(24))::INT AS bin)) h),
prof AS (SELECT city, u, v, bin, free, greatest(round_even(greatest(free * (1 - {AMPLITUDE[intensity]} * rush * share) * jit, free * 0.12), 3), 0.001) AS speed FROM wv)"""


CUST = """
cust AS (SELECT CAST(c_nationkey AS VARCHAR) AS city, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, 45 + (c_custkey * 7919 % 1009) * 0.0002 AS lat, 4 + (c_custkey * 104729 % 1013) * 0.0002 AS lon FROM customer)"""


def between(lo: int, hi: int, x: str) -> str:
    return f"CAST({lo} + floor({x} * {hi - lo + 1}) AS BIGINT)"


def demand(kind: int) -> str:
    x = u(f"demand{kind}", "city", "i")
    lo, hi = ROUTE_SIZE_BANDS[3]
    if kind == 6:
        d = f"CASE WHEN (lat < avg(lat) OVER c) = (lon < avg(lon) OVER c) THEN {between(51, 100, x)} ELSE {between(1, 50, x)} END"
    elif kind == 7:
        d = f"CASE WHEN row_number() OVER (PARTITION BY city ORDER BY {u('bulky', 'city', 'i')}, i) < count(*) OVER c / ({lo} + {u('route_size', 'city')} * {hi - lo}) * 1.5 THEN {between(50, 100, x)} ELSE {between(1, 10, x)} END"
    else:
        d = between(*DEMAND_BANDS[kind], x)
    return f"dem AS (SELECT city, i, {d} AS demand, {lo} + {u('route_size', 'city')} * {hi - lo} AS r FROM cust WINDOW c AS (PARTITION BY city))"


STOPS = f"""{CUST}, {demand(2)},
dealt AS (SELECT *, CASE WHEN i <= 15 THEN city ELSE city || '-' || ((i - 1) // 15) END AS name FROM dem WHERE city IS NOT NULL),
stop AS (SELECT city, node, demand, CASE WHEN node = 0 THEN 0 ELSE 60 + node * 37 % 300 END AS service, CASE WHEN node = 0 THEN 0 ELSE node * 613 % 9000 END AS earliest, CASE WHEN node = 0 THEN 86400 ELSE node * 613 % 9000 + 7200 END AS latest, 40 AS capacity
  FROM (SELECT name AS city, i - (i - 1) // 15 * 15 AS node, demand FROM dealt UNION ALL SELECT DISTINCT name, 0, 0 FROM dealt)),
cost AS (SELECT a.city, a.node AS i, b.node AS j, 60 + (a.node * 7919 + b.node * 104729) % 1740 AS cost FROM stop a JOIN stop b ON a.city = b.city AND a.node <> b.node),
visit AS (SELECT city, 'a' AS run, node % 3 AS route_idx, node, row_number() OVER (PARTITION BY city, node % 3 ORDER BY node, node) - 1 AS leg FROM stop WHERE node > 0
  UNION ALL SELECT city, 'b', node % 4, node, row_number() OVER (PARTITION BY city, node % 4 ORDER BY node * 7 % 16, node) - 1 FROM stop WHERE node > 0),
leg AS (SELECT city, run, route_idx, leg, node AS t, lag(node, 1, 0) OVER (PARTITION BY city, run, route_idx ORDER BY leg) AS f FROM (SELECT * FROM visit UNION ALL SELECT city, run, route_idx, 0, max(leg) + 1 FROM visit GROUP BY city, run, route_idx)),
timed AS (SELECT l.*, c.cost, s.service, s.earliest, s.latest, s.demand, s.capacity FROM leg l JOIN cost c ON c.city = l.city AND c.i = l.f AND c.j = l.t JOIN stop s ON s.city = l.city AND s.node = l.t),
arr AS (SELECT *, sum(cost) OVER w + coalesce(sum(service) OVER (PARTITION BY city, run, route_idx ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM timed WINDOW w AS (PARTITION BY city, run, route_idx ORDER BY leg)),
late AS (SELECT *, greatest(0, max(earliest - reach) OVER (PARTITION BY city, run, route_idx ORDER BY leg)) AS hold FROM arr),
beg AS (SELECT *, CAST(reach + coalesce(lag(hold) OVER (PARTITION BY city, run, route_idx ORDER BY leg), 0) AS DOUBLE) AS arrival, CAST(reach + hold AS DOUBLE) AS begin FROM late)"""

SERVICE = f"""
srv AS (SELECT s.*, CASE WHEN node = 0 THEN 0 ELSE CAST(least(greatest(round_even(mean + mean / 2 * {g('service', 'city', 'node')}, 0), 1), greatest(1, floor(mean * 2))) AS BIGINT) END AS srv FROM (
  SELECT *, 86400 * least(greatest(0.01 + 0.005 * {g('service_mean', 'city')}, 0.001), 0.2) AS mean FROM stop) s),
tb AS (SELECT srv.city, srv.node, srv.srv, coalesce(a.cost, 0) AS t, coalesce(b.cost, 0) AS k FROM srv LEFT JOIN cost a ON a.city = srv.city AND a.i = 0 AND a.j = srv.node LEFT JOIN cost b ON b.city = srv.city AND b.j = 0 AND b.i = srv.node)"""


def width(kind: str) -> str:
    mean, std, lo, hi = WIDTHS[kind]
    return f"greatest(1.0, round_even(86400 * least(greatest({mean} + {std} * {g('width:' + kind, 'city', 'node')}, {lo}), {hi}), 0))"


def family(kind: str) -> str:
    center = f"t + {u('spread', 'city', 'node')} * (86400 - k - srv - t)" if kind == "spread" else "t * 3.0"
    return f"""WITH {STOPS}, {SERVICE}, w AS (SELECT *, {width(kind)} AS w, {center} AS c FROM tb),
l AS (SELECT *, least(greatest(round_even(c + w / 2, 0), t), 86400 - k - srv) AS latest FROM w)
SELECT city, node, srv AS service, CASE WHEN node = 0 THEN 0 ELSE CAST(least(greatest(round_even(c - w / 2, 0), 0), latest) AS BIGINT) END AS earliest, CASE WHEN node = 0 THEN 86400 ELSE CAST(latest AS BIGINT) END AS latest FROM l"""


REPAIR = "CASE WHEN hi < lo THEN least(greatest((lo + hi) // 2, 0), 86400) WHEN greatest({a}, lo) > least({z}, hi) THEN {one} ELSE {two} END"

RUNS = """
run AS (SELECT run_id, instance_id, cost, objective_function, routes, validation.valid AS valid, metadata.metric AS metric, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_at NULLS FIRST, instance_id NULLS FIRST, cost NULLS FIRST, objective_function NULLS FIRST, routes NULLS FIRST) AS k FROM solution WHERE run_id IS NOT NULL) WHERE k = 1),
rt AS (SELECT run_id, instance_id, i - 1 AS route_idx, list_filter(routes[i], lambda x: x <> 0) AS route FROM (SELECT *, unnest(range(1, len(routes) + 1)) AS i FROM run)),
route AS (SELECT * FROM rt WHERE len(route) > 0),
cust_ AS (SELECT run_id, instance_id, route_idx, unnest(route) AS node, generate_subscripts(route, 1) AS p, len(route) AS n FROM route),
dedge AS (SELECT DISTINCT run_id, a, b FROM (SELECT run_id, coalesce(lag(node) OVER w, 0) AS a, node AS b FROM cust_ WINDOW w AS (PARTITION BY run_id, route_idx ORDER BY p) UNION ALL SELECT run_id, node, 0 FROM cust_ WHERE p = n)),
cpair AS (SELECT DISTINCT x.run_id, x.node AS a, y.node AS b FROM cust_ x JOIN cust_ y ON x.run_id = y.run_id AND x.route_idx = y.route_idx AND x.node < y.node)"""

_POI = """poi1 AS (SELECT city, poi_id AS point_id, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY city, lat, lon) AS k FROM poi WHERE poi_id IS NOT NULL AND city IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)) WHERE k = 1)"""
SNAP = f"""{CROSS}, {_POI}, used AS (SELECT DISTINCT city, node_id, lat, lon FROM step), pf AS (SELECT city, point_id, east, north FROM {frame('poi1')}), nf AS (SELECT city, node_id, east, north FROM {frame('used')}),
near AS (SELECT p.city, p.point_id, arg_min(n.node_id, (pow(p.east - n.east, 2) + pow(p.north - n.north, 2), n.node_id)) AS node_id, min(pow(p.east - n.east, 2) + pow(p.north - n.north, 2)) AS d2 FROM pf p JOIN nf n ON n.city = p.city AND abs(p.east - n.east) <= 100 AND abs(p.north - n.north) <= 100 GROUP BY ALL),
snap AS (SELECT near.* FROM near SEMI JOIN crossing c ON c.city = near.city AND c.node_id = near.node_id)"""
_RANDOM = f"drawn AS (SELECT city, node_id, row_number() OVER (PARTITION BY city ORDER BY {u('random', 'node_id')}, node_id) AS place FROM n)"
_SEEDS = lambda n: f"seed AS (SELECT city, node_id, lat, lon FROM n QUALIFY row_number() OVER (PARTITION BY city ORDER BY {u('seeds', 'node_id')}, node_id) <= {n}), wgt AS (SELECT n.city, n.node_id, sum(pow(2.0, -{hav('n.lat', 'n.lon', 's.lat', 's.lon')} / 800.0)) AS weight FROM n JOIN seed s ON s.city = n.city GROUP BY ALL)"


def _tiles(lo: str, hi: str, most: float, k: str) -> str:
    n = f"greatest(1, CAST(ceil(({hi} - {lo}) / {most}) AS INT))"
    return f"unnest(list_transform(range({n}), lambda {k}: {{'k': {k}, 'lo': {lo} + {k} * (({hi} - {lo}) / {n}), 'hi': CASE WHEN {k} = {n} - 1 THEN {hi} ELSE {lo} + ({k} + 1) * (({hi} - {lo}) / {n}) END}}))"


def _depot(aim: str) -> str:
    return f"WITH {N}, aim AS (SELECT city, {aim}(lat) AS y, {aim}(lon) AS x FROM n GROUP BY city) SELECT n.city, arg_min(node_id, (round({hav('lat', 'lon', 'aim.y', 'aim.x')}, 6), node_id)) AS node_id FROM n JOIN aim ON aim.city = n.city GROUP BY n.city"


ORACLES = {
    "geo_frames": f"WITH {N} SELECT city, node_id, round(east, 3) AS east, round(north, 3) AS north, round(up, 3) AS up, round({hav('lat', 'lon', 'y0', 'x0')}, 3) AS metres, round(sqrt(pow((CASE WHEN lon - x0 > 180 THEN lon - x0 - 360 WHEN lon - x0 < -180 THEN lon - x0 + 360 ELSE lon - x0 END) * 111320 * cos(radians((lat + y0) / 2)), 2) + pow((lat - y0) * 111320, 2)), 3) AS flat, true AS same_lat, true AS same_lon FROM {frame('n')}",
    "names_seeds": f"""SELECT instance_id, instance_name, solver, CASE WHEN s = '' THEN 'x' ELSE s END AS slug, CAST(CAST('0x' || substr(sha256(instance_id || chr(31) || coalesce(solver, 'None')), 1, 16) AS UBIGINT) AS VARCHAR) AS seed, substr(sha256(instance_id || chr(0) || coalesce(instance_name, 'None')), 1, 20) AS short_id,
round({u('u', 'instance_id')}, 9) AS u, round({g('g', 'instance_id')}, 6) AS g, 'node:1_' || instance_id AS edge_key FROM (SELECT DISTINCT instance_id, instance_name, solver, regexp_replace(regexp_replace(lower(trim(instance_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM solution WHERE instance_id IS NOT NULL)""",
    "road_ways": f"WITH {ROADS} SELECT city, way_id, class, one_way, backward, len(nodes) AS n_nodes FROM road",
    "road_full_edges": f"WITH {EDGES} SELECT city, u, v, class, round(length_m, 3) AS length_m FROM edge",
    "road_class_stats": f"WITH {EDGES} SELECT city, class, count(*) AS n_edges, round(sum(length_m) / 1000, 3) AS km FROM edge GROUP BY ALL",
    "road_vertices": f"WITH {EDGES}, e AS (SELECT city, node_id, min(p) AS p FROM (SELECT city, u AS node_id, (pos, 0) AS p FROM edge UNION ALL SELECT city, v, (pos, 1) FROM edge) GROUP BY ALL) SELECT city, node_id, row_number() OVER (PARTITION BY city ORDER BY p, node_id) - 1 AS vertex FROM e",
    "road_intersections": f"WITH {CROSS} SELECT city, node_id FROM crossing",
    "road_segments": f"WITH RECURSIVE {SEGMENTS} SELECT city, way_id, u, v, class, round(len, 3) AS length_m FROM seg",
    "road_parallel_min": f"WITH RECURSIVE {SEGMENTS} SELECT city, u, v, round(min(len), 3) AS length_m FROM seg GROUP BY city, u, v",
    "collected_edges": f"WITH {BRIDGE} SELECT city, u, v, class, round(length_m, 3) AS length_m FROM be",
    "cost_matrices": f"""WITH RECURSIVE {BRIDGE}, {sssp('SELECT city, node_id AS source FROM place', 'be.length_m')}, {sssp('SELECT city, node_id AS source FROM place', f"be.length_m * 3.6 / {case(FREE_KMH, 'be.class')}", "best2")}
SELECT a.city, m.metric, a.i, b.i AS j, CAST(ceil(round(CASE m.metric WHEN 'shortest' THEN x.cost ELSE y.cost END, 6)) AS BIGINT) AS cost FROM place a JOIN place b ON a.city = b.city AND a.i <> b.i CROSS JOIN (VALUES ('shortest'), ('fastest')) m(metric)
LEFT JOIN best x ON x.city = a.city AND x.source = a.node_id AND x.node = b.node_id LEFT JOIN best2 y ON y.city = a.city AND y.source = a.node_id AND y.node = b.node_id""",
    "cost_rounds": f"WITH RECURSIVE {BRIDGE}, {sssp('SELECT city, node_id AS source FROM place', 'be.length_m')} SELECT city, source, node AS node_id, round(cost, 3) AS cost FROM best",
    "euclid_matrices": f"WITH {BRIDGE}, {BOX}, f AS (SELECT city, i, east, north FROM {frame('place')}) SELECT a.city, a.i, b.i AS j, CAST(ceil(round(sqrt(pow(a.east - b.east, 2) + pow(a.north - b.north, 2)), 6)) AS BIGINT) AS cost FROM f a JOIN f b ON a.city = b.city AND a.i <> b.i",
    "poi_snap": f"WITH {SNAP} SELECT city, point_id, node_id, round(sqrt(d2), 3) AS metres FROM snap",
    "depot_center": _depot("avg"),
    "depot_corner": _depot("min"),
    "depot_random": f"WITH {N} SELECT city, arg_min(node_id, ({u('depot', 'node_id')}, node_id)) AS node_id FROM n GROUP BY city",
    "customers_random": f"WITH {N}, {_RANDOM} SELECT city, node_id, place, 'param' AS source_tag FROM drawn WHERE place <= 8",
    "cluster_weights": f"WITH {N}, {_SEEDS(4)} SELECT city, node_id, round(weight, 6) AS weight FROM wgt",
    "customers_clustered": f"WITH {N}, {_SEEDS(3)} SELECT city, node_id, row_number() OVER (PARTITION BY city ORDER BY is_seed DESC, round(-ln({u('cluster', 'node_id')}) / greatest(weight, 1e-300), 9), node_id) AS place FROM (SELECT w.*, s.node_id IS NOT NULL AS is_seed FROM wgt w LEFT JOIN seed s ON s.city = w.city AND s.node_id = w.node_id) QUALIFY place <= 8",
    "customers_hybrid": f"""WITH {SNAP}, pk AS (SELECT city, node_id, min(({u('poi', 'point_id')}, point_id)) AS k FROM snap GROUP BY ALL), pp AS (SELECT city, node_id, 0 AS prio, row_number() OVER (PARTITION BY city ORDER BY k) AS place, 'poi' AS tag FROM pk QUALIFY place <= 4),
dr AS (SELECT city, node_id, row_number() OVER (PARTITION BY city ORDER BY {u('random', 'node_id', seed=8)}, node_id) AS place FROM n QUALIFY place <= 8),
al AS (SELECT * FROM pp UNION ALL SELECT city, node_id, CASE WHEN place <= 4 THEN 1 ELSE 2 END, place, CASE WHEN place <= 4 THEN 'param' ELSE 'param_fill' END FROM dr), b AS (SELECT city, node_id, min((prio, place, tag)) AS k FROM al GROUP BY ALL)
SELECT city, node_id, row_number() OVER (PARTITION BY city ORDER BY k[1], k[2], node_id) AS place, k[3] AS source_tag FROM b QUALIFY place <= 8""",
    **{f"demand_kind_{k}": f"WITH {CUST}, {demand(k)} SELECT city, i, demand FROM dem" for k in range(1, 8)},
    "fleet_sizes": f"""WITH {CUST}, {demand(2)}, a AS (SELECT city, count(*) AS n, CAST(sum(demand) AS BIGINT) AS total, max(demand) AS most, min(r) AS r FROM dem GROUP BY city), b AS (SELECT *, CASE WHEN total = n THEN floor(r) ELSE greatest(most, ceil(r * total / n)) END AS w FROM a),
c AS (SELECT *, CAST(CASE WHEN n < 2 THEN greatest(most, w) ELSE least(greatest(w, most), total - 1) END AS BIGINT) AS capacity FROM b) SELECT city, n, total, most, capacity, CAST(ceil(total / capacity) AS BIGINT) AS routes FROM c""",
    "arrival_times": f"WITH {STOPS} SELECT city, run, route_idx, leg, t AS node, CAST(reach AS DOUBLE) AS arrival FROM arr",
    "waiting_times": f"WITH {STOPS} SELECT city, run, route_idx, leg, t AS node, arrival, begin FROM beg",
    "route_checks": f"""WITH {STOPS}, s AS (SELECT city, run, route_idx, CAST(sum(CASE WHEN t <> 0 THEN demand END) AS BIGINT) AS load, count(*) FILTER (WHERE t <> 0 AND begin > latest) AS late_stops, CAST(sum(cost) AS DOUBLE) AS cost, max(CASE WHEN t = 0 THEN begin END) AS returned FROM beg GROUP BY ALL)
SELECT *, load <= 40 AND late_stops = 0 AND returned <= 86400 AS ok FROM s""",
    "route_coverage": f"""WITH {STOPS}, v AS (SELECT city, run, node FROM visit WHERE NOT (run = 'b' AND route_idx = 2) UNION ALL SELECT city, 'a', x FROM (SELECT DISTINCT city FROM stop), (VALUES (1), (1), (99)) t(x)),
seen AS (SELECT city, run, node, count(*) AS k FROM v GROUP BY ALL), want AS (SELECT DISTINCT s.city, r.run, s.node FROM stop s JOIN (SELECT DISTINCT city, run FROM v) r ON r.city = s.city WHERE s.node <> 0)
SELECT city, run, count(*) FILTER (WHERE k IS NULL) AS missing, count(*) FILTER (WHERE k > 1) AS repeated, count(*) FILTER (WHERE w IS NULL) AS unknown FROM (SELECT *, 1 AS w FROM want) FULL JOIN seen USING (city, run, node) GROUP BY ALL""",
    "service_times": f"WITH {STOPS}, {SERVICE} SELECT city, node, srv AS service FROM srv",
    "windows_reachable_interval": f"""WITH {STOPS}, {SERVICE}, w AS (SELECT *, CAST({width('reachable_interval')} AS BIGINT) AS w, t AS lo, 86400 - srv - k AS hi FROM tb),
c AS (SELECT *, CASE WHEN lo + w // 2 > hi - w // 2 THEN (lo + hi) // 2 ELSE CAST(lo + w // 2 + floor({u('center', 'city', 'node')} * (hi - w // 2 - lo - w // 2 + 1)) AS BIGINT) END - w // 2 AS s FROM w),
o AS (SELECT city, node, srv, {REPAIR.format(a='s', z='s + w', one='lo', two='greatest(s, lo)')} AS e, {REPAIR.format(a='s', z='s + w', one='hi', two='least(s + w, hi)')} AS l FROM c)
SELECT city, node, srv AS service, CASE WHEN node = 0 THEN 0 ELSE e END AS earliest, CASE WHEN node = 0 THEN 86400 ELSE l END AS latest, false AS repaired FROM o""",
    **{"windows_" + k.replace("-", "_"): family(k) for k in ("td-shared", "tight", "spread")},
    "rush_curve": f"SELECT edge_class, hour, round(least(1.0, exp(-pow(hour + 0.5 - 8.25, 2) / 2.42) + 0.85 * exp(-pow(hour + 0.5 - 17.75, 2) / 4.5)), 6) AS rush, round({case(FREE_KMH, 'edge_class')} / 3.6, 6) AS free FROM (SELECT DISTINCT edge_class FROM road_edge WHERE edge_class IS NOT NULL), (SELECT unnest(range(24))::INT AS hour)",
    "wave_speeds": f"WITH {BRIDGE}, {wave('moderate')} SELECT city, u, v, bin, speed FROM prof",
    "overlay_clamp": f"WITH {BRIDGE}, {wave('light')} SELECT city, u, v, bin, least(speed, round(free, 6)) AS speed FROM prof",
    "volume_delay": f"""WITH {BRIDGE}, f AS (SELECT *, {case(FREE_KMH, 'class')} / 3.6 AS free, CASE WHEN bin BETWEEN 6 AND 20 THEN (u * 31 + v * 17 + bin * 7) % 2500 ELSE 0 END / {case(CAPACITY_VEH_H, 'class')} AS ratio FROM be, (SELECT unnest(range(24))::INT AS bin))
SELECT city, u, v, bin, greatest(round_even(greatest(free / least(1 + 0.15 * pow(ratio, 4), 6), free * 0.12), 3), 0.001) AS speed FROM f""",
    "departure_bins": "SELECT event_type, CAST(least(greatest(floor((hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) / 3600.0), 0), 23) AS INT) AS bin, count(*) AS n FROM events GROUP BY ALL",
    "solution_legs": f"WITH {RUNS} SELECT run_id, a, b FROM dedge",
    "solution_loads": f"WITH {RUNS} SELECT run_id, CAST(route_idx AS BIGINT) AS route_idx, CAST(sum(1 + node * 7 % 20) AS BIGINT) AS load, count(*) AS stops FROM cust_ GROUP BY ALL",
    "solution_compare": f"""WITH {RUNS}, ok AS (SELECT * FROM run WHERE valid AND cost IS NOT NULL), ref AS (SELECT instance_id, objective_function, metric, arg_min(run_id, (cost, run_id)) AS reference FROM ok GROUP BY ALL),
vs AS (SELECT o.run_id AS candidate, r.reference FROM ok o JOIN ref r ON o.instance_id IS NOT DISTINCT FROM r.instance_id AND o.objective_function IS NOT DISTINCT FROM r.objective_function AND o.metric IS NOT DISTINCT FROM r.metric WHERE o.run_id <> r.reference),
nr AS (SELECT run_id, count(*) AS k FROM route GROUP BY run_id),
de AS (SELECT candidate, reference, (SELECT count(*) FROM dedge e WHERE e.run_id = candidate AND NOT EXISTS (SELECT 1 FROM dedge x WHERE x.run_id = reference AND x.a = e.a AND x.b = e.b)) AS ea, (SELECT count(*) FROM dedge e WHERE e.run_id = reference AND NOT EXISTS (SELECT 1 FROM dedge x WHERE x.run_id = candidate AND x.a = e.a AND x.b = e.b)) AS er FROM vs),
dp AS (SELECT candidate, reference, (SELECT count(*) FROM cpair e WHERE e.run_id = candidate AND NOT EXISTS (SELECT 1 FROM cpair x WHERE x.run_id = reference AND x.a = e.a AND x.b = e.b)) AS pa, (SELECT count(*) FROM cpair e WHERE e.run_id = reference AND NOT EXISTS (SELECT 1 FROM cpair x WHERE x.run_id = candidate AND x.a = e.a AND x.b = e.b)) AS pr FROM vs),
j AS (SELECT vs.*, c.cost - r.cost AS d, r.cost AS rc, coalesce(cn.k, 0) - coalesce(rn.k, 0) AS rd, CASE WHEN c.objective_function = 'HierarchicalVehicleCost' THEN coalesce(cn.k, 0) - coalesce(rn.k, 0) ELSE 0 END AS lead
  FROM vs JOIN run c ON c.run_id = candidate JOIN run r ON r.run_id = reference LEFT JOIN nr cn ON cn.run_id = candidate LEFT JOIN nr rn ON rn.run_id = reference)
SELECT j.candidate, j.reference, round(d, 6) AS cost_delta, CASE WHEN rc <> 0 THEN round(100 * d / abs(rc), 6) END AS gap_percent, rd AS routes_delta, CASE WHEN lead < 0 OR (lead = 0 AND d < 0) THEN 'better' WHEN lead = 0 AND d = 0 THEN 'equal' ELSE 'worse' END AS ordering,
  ea AS edges_added, er AS edges_removed, pa AS pairs_added, pr AS pairs_removed FROM j JOIN de USING (candidate, reference) JOIN dp USING (candidate, reference)""",
    "solution_recent": f"WITH {RUNS} SELECT run_id, instance_id, objective_function FROM run ORDER BY created_at DESC NULLS LAST, run_id LIMIT 50",
    "fetch_tiles_plan": f"""WITH {N}, ys AS (SELECT *, {_tiles('s', 'nn', 0.12, 'a')} AS y FROM box),
xs AS (SELECT city, y, {_tiles('w', 'e', 0.15, 'a')} AS xx, 0 AS k0 FROM ys WHERE w <= e UNION ALL SELECT city, y, {_tiles('w', '180.0', 0.15, 'a')}, 0 FROM ys WHERE w > e
  UNION ALL SELECT city, y, {_tiles('(-180.0)', 'e', 0.15, 'a')}, greatest(1, CAST(ceil((180.0 - w) / 0.15) AS INT)) FROM ys WHERE w > e)
SELECT city, y.k || '_' || (xx.k + k0) AS tile, round(y.lo, 9) AS south, round(xx.lo, 9) AS west, round(y.hi, 9) AS north, round(xx.hi, 9) AS east FROM xs""",
    "dedup_last_wins": "SELECT id, tile, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS seen_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST, tile DESC NULLS LAST, lat DESC NULLS LAST) AS k FROM osm_node WHERE id IS NOT NULL) WHERE k = 1",
    "dedup_first_wins": "SELECT id, city, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS seen_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at NULLS FIRST, city NULLS FIRST) AS k FROM osm_way WHERE id IS NOT NULL) WHERE k = 1",
    "upsert_nodes": f"""WITH {N}, {_POI}, b AS (SELECT node_id - 10000000000 AS id, lat, lon FROM n), c AS (SELECT point_id - 100000000 AS id, lat, lon FROM poi1)
SELECT id, lat, lon, NOT EXISTS (SELECT 1 FROM b WHERE b.id = c.id) AS added FROM c UNION ALL SELECT id, lat, lon, false FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = b.id)""",
    "bridge_files": f"WITH {BRIDGE} SELECT city, len(edges)::INT AS n_edges, len(vertices)::INT AS n_vertices, CASE WHEN len(list_filter(edges, lambda e: NOT list_contains(list_transform(vertices, lambda v: v.osm_id), e.osm_u) OR NOT list_contains(list_transform(vertices, lambda v: v.osm_id), e.osm_v))) > 0 THEN 'unknown vertex' END AS problem FROM bg",
    "instance_files": f"WITH {STOPS} SELECT s.city AS name, s.k::INT AS dimension, CAST(40 AS BIGINT) AS capacity, c.c AS cost_sum, CAST(s.d AS BIGINT) AS demand_sum FROM (SELECT city, count(*) AS k, sum(demand) AS d FROM stop GROUP BY city) s JOIN (SELECT city, CAST(sum(cost) AS DOUBLE) AS c FROM cost GROUP BY city) c ON c.city = s.city",
}

_TOUR = """tour AS (SELECT DISTINCT city, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS route FROM stop UNION ALL
  SELECT t.city, arg_min(c.j, (c.cost, c.j)), list_append(any_value(t.route), arg_min(c.j, (c.cost, c.j))) FROM tour t JOIN cost c ON c.city = t.city AND c.i = t.pos AND c.j <> 0 AND NOT list_contains(t.route, c.j) GROUP BY t.city),
nn AS (SELECT city, route FROM tour QUALIFY row_number() OVER (PARTITION BY city ORDER BY len(route) DESC) = 1)"""
_COMMUTERS = f"""{SNAP}, {BRIDGE}, v AS (SELECT city, node_id, row_number() OVER (PARTITION BY city ORDER BY node_id) - 1 AS k, count(*) OVER (PARTITION BY city) AS n FROM spot),
hit AS (SELECT city, node_id FROM spot SEMI JOIN snap USING (node_id)), enough AS (SELECT city FROM hit GROUP BY city HAVING count(*) >= 50),
pool AS (SELECT * FROM hit SEMI JOIN enough USING (city) UNION ALL SELECT city, node_id FROM spot ANTI JOIN enough USING (city)),
wk AS (SELECT city, node_id, row_number() OVER (PARTITION BY city ORDER BY node_id) - 1 AS k, count(*) OVER (PARTITION BY city) AS n FROM pool),
com AS (SELECT city, n, unnest(range(1, greatest(1, CAST(round_even(2.5 * n, 0) AS BIGINT)) + 1)) AS commuter FROM (SELECT DISTINCT city, n FROM v)),
who AS (SELECT c.city, c.commuter, h.node_id AS home, w.node_id AS work FROM (SELECT com.*, floor({u('home', 'com.city', 'commuter')} * com.n) AS hk, floor({u('work', 'com.city', 'commuter')} * m.n) AS wk FROM com JOIN (SELECT DISTINCT city, n FROM wk) m ON m.city = com.city) c
  JOIN v h ON h.city = c.city AND h.k = hk JOIN wk w ON w.city = c.city AND w.k = c.wk WHERE h.node_id <> w.node_id)"""


def _hour(label: str, mean: float, std: float) -> str:
    return f"round(least(greatest({mean} + {std} * {g(label, 'city', 'commuter')}, 0.25), 23.75) * 3600.0, 2)"


_SLICES = " UNION ALL ".join(f"SELECT city, i, demand, {n} AS n, 'n{n}-d{k}-r2-s7' AS slice FROM d{k}" for n in (5, 10) for k in (1, 2))

ORACLES |= {
    "giant_component": f"""WITH RECURSIVE {EDGES}, ends AS (SELECT DISTINCT city, u, v FROM edge), reach AS (SELECT city, u AS src, u AS node FROM ends UNION SELECT city, v, v FROM ends UNION SELECT r.city, r.src, e.v FROM reach r JOIN ends e ON e.city = r.city AND e.u = r.node),
comp AS (SELECT a.city, a.src AS node_id, min(a.node) AS label FROM reach a JOIN reach b ON b.city = a.city AND b.src = a.node AND b.node = a.src GROUP BY a.city, a.src), size AS (SELECT city, label, count(*) AS k FROM comp GROUP BY ALL), best AS (SELECT city, arg_min(label, (-k, label)) AS label FROM size GROUP BY city)
SELECT comp.city, comp.node_id FROM comp JOIN best ON best.city = comp.city AND best.label = comp.label""",
    "nearest_tours": f"WITH RECURSIVE {STOPS}, {_TOUR} SELECT city, route FROM nn",
    "windows_route_centered": f"""WITH RECURSIVE {STOPS}, {_TOUR}, {SERVICE}, seq AS (SELECT city, unnest(route) AS node, generate_subscripts(route, 1) AS p FROM nn), arr_ AS (SELECT q.city, q.node, sum(c.cost) OVER w + coalesce(sum(tb.srv) OVER (PARTITION BY q.city ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach
  FROM (SELECT *, lag(node, 1, 0) OVER (PARTITION BY city ORDER BY p) AS f FROM seq) q JOIN cost c ON c.city = q.city AND c.i = q.f AND c.j = q.node JOIN tb ON tb.city = q.city AND tb.node = q.node WINDOW w AS (PARTITION BY q.city ORDER BY p)),
c AS (SELECT *, round_even(reach - w / 2, 0) AS s, round_even(reach + w / 2, 0) AS z FROM (SELECT tb.*, {width('route_centered').replace('city', 'tb.city').replace('node', 'tb.node')} AS w, tb.t AS lo, 86400 - srv - k AS hi, reach FROM tb LEFT JOIN arr_ ON arr_.city = tb.city AND arr_.node = tb.node)),
o AS (SELECT city, node, srv, {REPAIR.format(a='s', z='z', one='lo', two='greatest(s, lo)')} AS e, {REPAIR.format(a='s', z='z', one='hi', two='least(z, hi)')} AS l FROM c)
SELECT city, node, srv AS service, CASE WHEN node = 0 THEN 0 ELSE CAST(e AS BIGINT) END AS earliest, CASE WHEN node = 0 THEN 86400 ELSE CAST(l AS BIGINT) END AS latest, false AS repaired FROM o""",
    "commuter_trips": f"""WITH {_COMMUTERS}, t AS (SELECT *, {_hour('morning', 8.0, 0.75)} AS departure_s, true AS to_work FROM who UNION ALL SELECT *, {_hour('evening', 17.5, 1.0)}, false FROM who
UNION ALL SELECT *, {_hour('noon_out', 12.25, 0.5)}, false FROM who WHERE {u('lunch', 'city', 'commuter')} < 0.25 UNION ALL SELECT *, {_hour('noon_back', 13.5, 0.5)}, true FROM who WHERE {u('lunch', 'city', 'commuter')} < 0.25) SELECT * FROM t""",
    "bulk_slices": f"""WITH {STOPS}, c15 AS (SELECT city, node AS i FROM stop WHERE node > 0), d1 AS (SELECT city, i, {between(*DEMAND_BANDS[1], u('demand1', 'city', 'i'))} AS demand FROM c15), d2 AS (SELECT city, i, {between(*DEMAND_BANDS[2], u('demand2', 'city', 'i'))} AS demand FROM c15),
sl AS ({_SLICES}), nd AS (SELECT city, slice, i, demand FROM sl WHERE i <= n UNION ALL SELECT DISTINCT city, slice, 0, 0 FROM sl),
a AS (SELECT city, slice, count(*) AS n_nodes, CAST(sum(demand) AS BIGINT) AS demand FROM nd GROUP BY ALL), b AS (SELECT x.city, x.slice, count(*) AS n_arcs, CAST(sum(c.cost) AS BIGINT) AS cost FROM nd x JOIN nd y ON y.city = x.city AND y.slice = x.slice JOIN cost c ON c.city = x.city AND c.i = x.i AND c.j = y.i GROUP BY ALL)
SELECT a.city, a.slice, n_nodes, demand, n_arcs, cost FROM a JOIN b USING (city, slice)""",
    "customers_mixed": f"""WITH {N}, p1 AS (SELECT city, node_id FROM n QUALIFY row_number() OVER (PARTITION BY city ORDER BY {u('random', 'node_id')}, node_id) <= 4), m AS (SELECT * FROM n ANTI JOIN p1 USING (city, node_id)),
{_SEEDS(3).replace('FROM n ', 'FROM m ').replace('n.', 'm.').replace('FROM n', 'FROM m')}, p2 AS (SELECT city, node_id FROM (SELECT w.*, s.node_id IS NOT NULL AS is_seed FROM wgt w LEFT JOIN seed s ON s.city = w.city AND s.node_id = w.node_id) QUALIFY row_number() OVER (PARTITION BY city ORDER BY is_seed DESC, round(-ln({u('cluster', 'node_id')}) / greatest(weight, 1e-300), 9), node_id) <= 4),
al AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2) SELECT city, node_id, row_number() OVER (PARTITION BY city ORDER BY {u('mix', 'node_id')}, node_id) AS place FROM al QUALIFY place <= 8""",
}
