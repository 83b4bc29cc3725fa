"""The DuckDB SQL of the chains: road graphs, paths, flows, drives and instances, written independently of the DataFrame plans."""

from __future__ import annotations

import re

from waymesh.functions.scalars import DEMAND_BANDS, FREE_KMH
from waymesh.plans.network_sql import _COMMUTERS, _POI, BRIDGE, EDGES, N, ROADS, SEGMENTS, STEPS, STOPS, between, case, frame, g, u, wave

TIMED = f"te AS (SELECT city, u, v, class, length_m, length_m * 3.6 / {case(FREE_KMH, 'class')} AS w FROM be), le AS (SELECT city, u, v, length_m AS w FROM be), ve AS (SELECT city, v AS u, u AS v, w FROM te)"


def trees(name: str, sources: str, edges: str) -> str:
    """name (city, source, node, cost, hops) and name_p (city, source, node, before): trees of least cost, then fewest edges, then the smaller predecessor."""
    return f"""
{name} (city, source, node, cost, hops) USING KEY (city, source, node) AS (SELECT city, source, source, CAST(0 AS DOUBLE), 0 FROM ({sources}) UNION
  SELECT x.city, x.source, x.node, x.m.c, x.m.h FROM (SELECT h.city, h.source, e.v AS node, min({{'c': h.cost + e.w, 'h': h.hops + 1}}) AS m FROM {name} h JOIN {edges} e ON e.city = h.city AND e.u = h.node GROUP BY ALL) x
  LEFT JOIN recurring.{name} r ON r.city = x.city AND r.source = x.source AND r.node = x.node WHERE r.cost IS NULL OR x.m.c < r.cost OR (x.m.c = r.cost AND x.m.h < r.hops)),
{name}_p AS (SELECT t.city, t.source, t.node, min(e.u) AS before FROM {name} t JOIN {edges} e ON e.city = t.city AND e.v = t.node JOIN {name} s ON s.city = t.city AND s.source = t.source AND s.node = e.u AND s.cost + e.w = t.cost AND s.hops + 1 = t.hops GROUP BY ALL)"""


def renamed(sql: str, names: str, suffix: str) -> str:
    """The CTEs of the names under other names, with what refers to them."""
    return re.sub(rf"\b({'|'.join(names.split())})\b", rf"\1{suffix}", sql)


ALL_SPOTS = "SELECT city, node_id AS source FROM spot"
USED = f"""{trees('tr', ALL_SPOTS, 'te')},
up (city, source, node) AS (SELECT t.city, t.source, t.node FROM tr t SEMI JOIN spot s ON s.city = t.city AND s.node_id = t.node UNION SELECT k.city, k.source, p.before FROM up k JOIN tr_p p ON p.city = k.city AND p.source = k.source AND p.node = k.node),
used AS (SELECT DISTINCT k.city, p.before AS u, k.node AS v FROM up k JOIN tr_p p ON p.city = k.city AND p.source = k.source AND p.node = k.node)"""

# The component of each city's graph, and its segments after the other nodes are gone.
GIANT = f"""{EDGES}, ends AS (SELECT DISTINCT city, u, v FROM edge),
reach AS (SELECT city, u AS src, u AS node FROM ends UNION SELECT city, v, v FROM ends UNION SELECT r.city, r.src, e.v FROM reach r JOIN ends e ON e.city = r.city AND e.u = r.node),
comp AS (SELECT a.city, a.src AS node_id, min(a.node) AS label FROM reach a JOIN reach b ON b.city = a.city AND b.src = a.node AND b.node = a.src GROUP BY a.city, a.src), size AS (SELECT city, label, count(*) AS k FROM comp GROUP BY ALL), top AS (SELECT city, arg_min(label, (-k, label)) AS label FROM size GROUP BY city),
gone AS (SELECT comp.city, comp.node_id FROM comp JOIN top USING (city) WHERE comp.label <> top.label),
step_t AS (SELECT city, way_id, class, one_way, backward, node_id, x, y, z, lat, lon, row_number() OVER (PARTITION BY way_id ORDER BY k) AS k, count(*) OVER (PARTITION BY way_id) AS kn FROM step ANTI JOIN gone USING (city, node_id))"""
_TAIL = SEGMENTS[SEGMENTS.index("crossing AS (") :]
_PAIRS = EDGES[EDGES.index("pair AS (") :]
_BOTH = "AND NOT backward UNION ALL SELECT r.city, w.way_id, r.class, w.k,"
assert _BOTH in _TAIL
_SIDED = _TAIL.replace("w.k, a AS u", "w.k, 0 AS d, a AS u").replace(_BOTH, "AND NOT backward UNION ALL SELECT r.city, w.way_id, r.class, w.k, 1,")
SEG = lambda suffix: f"{renamed(_SIDED, 'crossing cum walk seg', suffix)}, sg{suffix} AS (SELECT city, u, v, arg_min(class, (len, way_id, k, d)) AS class, min(len) AS length_m FROM seg{suffix} GROUP BY city, u, v)"
TRIMMED = f"{GIANT}, {renamed(SEG('_t'), 'step', '_t')}"
FALLBACK = f"""{TRIMMED}, {SEG('_f')}, {renamed(_PAIRS, 'pair dir edge step', '_t')},
c1 AS (SELECT DISTINCT city FROM sg_t), c2 AS (SELECT DISTINCT city FROM sg_f ANTI JOIN c1 USING (city)), c3 AS (SELECT DISTINCT city FROM edge_t ANTI JOIN c1 USING (city) ANTI JOIN c2 USING (city)),
c4 AS (SELECT DISTINCT city FROM edge ANTI JOIN c1 USING (city) ANTI JOIN c2 USING (city) ANTI JOIN c3 USING (city)),
built AS (SELECT *, true AS oi, true AS tr FROM sg_t UNION ALL SELECT *, true, false FROM sg_f SEMI JOIN c2 USING (city) UNION ALL SELECT city, u, v, class, length_m, false, true FROM edge_t SEMI JOIN c3 USING (city)
  UNION ALL SELECT city, u, v, class, length_m, false, false FROM edge SEMI JOIN c4 USING (city))"""


def crossing_point(y1: str, x1: str, y2: str, x2: str) -> str:
    """Where a step crosses the box s, w, nn, e: its east and west sides first."""
    cut = lambda v, a, b: f"(({a} < {v} AND {v} < {b}) OR ({a} > {v} AND {v} > {b}))"
    side, level = f"CASE WHEN {cut('w', x1, x2)} THEN w WHEN {cut('e', x1, x2)} THEN e END", f"CASE WHEN {cut('s', y1, y2)} THEN s WHEN {cut('nn', y1, y2)} THEN nn END"
    sy, lx = f"({y1} + ({y2} - {y1}) * (({side}) - {x1}) / ({x2} - {x1}))", f"({x1} + ({x2} - {x1}) * (({level}) - {y1}) / ({y2} - {y1}))"
    return f"CASE WHEN ({side}) IS NOT NULL AND {sy} BETWEEN s AND nn THEN {{'lat': {sy}, 'lon': {side}}} WHEN ({level}) IS NOT NULL AND {lx} BETWEEN w AND e THEN {{'lat': {level}, 'lon': {lx}}} END"


def wrap(x: str) -> str:
    return f"(CASE WHEN {x} > 180 THEN {x} - 360 WHEN {x} < -180 THEN {x} + 360 ELSE {x} END)"


_EAST = "(e + CASE WHEN w > e THEN 360 ELSE 0 END)"
CROP = f"""WITH {N}, {ROADS},
half AS (SELECT city, round(s + (nn - s) * 0.25, 7) AS s, {wrap(f'round(w + ({_EAST} - w) * 0.25, 7)')} AS w, round(s + (nn - s) * 0.75, 7) AS nn, {wrap(f'round(w + ({_EAST} - w) * 0.75, 7)')} AS e0 FROM box),
mid AS (SELECT city, s, w, nn, e0 + CASE WHEN w > e0 THEN 360 ELSE 0 END AS e FROM half),
st AS (SELECT r.city, r.way_id, i - 1 AS seq, n.node_id, n.lat, n.lon + CASE WHEN n.lon - (w + e) / 2 < -180 THEN 360 WHEN n.lon - (w + e) / 2 > 180 THEN -360 ELSE 0 END AS lon, s, w, nn, e
  FROM (SELECT *, unnest(nodes) AS nid, generate_subscripts(nodes, 1) AS i FROM road) r JOIN n ON n.node_id = r.nid JOIN mid ON mid.city = r.city),
fl AS (SELECT *, lat BETWEEN s AND nn AND lon BETWEEN w AND e AS inn, lat IN (s, nn) OR lon IN (w, e) AS edg FROM st),
nb AS (SELECT *, lag(lat) OVER p AS by_, lag(lon) OVER p AS bx, lag(inn) OVER p AS bi, lag(edg) OVER p AS be_, lead(lat) OVER p AS ay, lead(lon) OVER p AS ax, lead(inn) OVER p AS ai, lead(edg) OVER p AS ae, bool_or(inn) OVER (PARTITION BY city, way_id) AS any_ FROM fl WINDOW p AS (PARTITION BY city, way_id ORDER BY seq)),
sp AS (SELECT *, CASE WHEN inn THEN {{'lat': lat, 'lon': lon}} WHEN coalesce(bi, false) THEN CASE WHEN NOT be_ THEN {crossing_point('by_', 'bx', 'lat', 'lon')} END WHEN coalesce(ai, false) THEN CASE WHEN NOT ae THEN {crossing_point('lat', 'lon', 'ay', 'ax')} END END AS spot_ FROM nb WHERE any_)
SELECT city, way_id, CAST(seq AS BIGINT) AS seq, CASE WHEN inn THEN node_id ELSE -1 END AS node_id, round(spot_.lat, 7) AS lat, round({wrap('spot_.lon')}, 7) AS lon FROM sp WHERE spot_ IS NOT NULL"""

PROFILES = lambda intensity, name: f"""{wave(intensity)}, {name} AS (SELECT city, u, v, list(speed ORDER BY bin) AS sp, list_transform(range(25), lambda k: coalesce(list_sum(list_slice(list(speed ORDER BY bin), 1, k)), 0.0) * 3600) AS cum FROM prof GROUP BY city, u, v)"""


def ride(t: str, length: str, edge: str) -> str:
    """The clock after a stretch entered at t: the distance covered since midnight, plus the length, turned back into a clock."""
    h = f"CAST(floor({t} / 3600) % 24 AS INT)"
    x = f"(floor({t} / 86400) * {edge}.cum[25] + {edge}.cum[{h} + 1] + {edge}.sp[{h} + 1] * ({t} - floor({t} / 3600) * 3600) + {length})"
    rest = f"({x} - floor({x} / {edge}.cum[25]) * {edge}.cum[25])"
    k = f"least(24, len(list_filter({edge}.cum, lambda c: c <= {rest})))"
    return f"(floor({x} / {edge}.cum[25]) * 86400 + ({k} - 1) * 3600.0 + ({rest} - {edge}.cum[{k}]) / {edge}.sp[{k}])"


DEPARTURES = "(VALUES (0.0), (27000.0), (63000.0), (86000.0)) d(departure)"
ARRIVALS = f"""WITH RECURSIVE {BRIDGE}, {TIMED}, {trees('tr', ALL_SPOTS, 'te')}, {PROFILES('heavy', 'pf')},
arr (city, source, node, departure, t) AS (SELECT city, source, node, CAST(departure AS DOUBLE), CAST(departure AS DOUBLE) FROM tr, {DEPARTURES} WHERE hops = 0 UNION ALL
  SELECT a.city, a.source, p.node, a.departure, {ride('a.t', 'te.length_m', 'pf')} FROM arr a JOIN tr_p p ON p.city = a.city AND p.source = a.source AND p.before = a.node JOIN te ON te.city = a.city AND te.u = p.before AND te.v = p.node JOIN pf ON pf.city = a.city AND pf.u = p.before AND pf.v = p.node)
SELECT a.city, s.i, t.i AS j, departure, round(a.t, 3) AS arrival FROM arr a JOIN place s ON s.city = a.city AND s.node_id = a.source JOIN place t ON t.city = a.city AND t.node_id = a.node WHERE s.i <> t.i"""

# The tour through all places, leg by leg, and the paths of its legs, edge by edge.
LEGS = """
tl AS (SELECT a.city, a.i AS leg, a.node_id AS source, b.node_id AS target, b.i AS to_i FROM place a JOIN place b ON b.city = a.city AND b.i = a.i + 1
  UNION ALL SELECT a.city, a.i, a.node_id, b.node_id, 0 FROM place a JOIN place b ON b.city = a.city AND b.i = 0 WHERE a.i > 0 QUALIFY row_number() OVER (PARTITION BY a.city ORDER BY a.i DESC) = 1)"""


def leg_paths(tree: str) -> str:
    return f"""{LEGS},
bk (city, leg, node, k) AS (SELECT l.city, l.leg, l.target, t.hops FROM tl l JOIN {tree} t ON t.city = l.city AND t.source = l.source AND t.node = l.target UNION ALL
  SELECT b.city, b.leg, p.before, b.k - 1 FROM bk b JOIN tl l ON l.city = b.city AND l.leg = b.leg JOIN {tree}_p p ON p.city = b.city AND p.source = l.source AND p.node = b.node)"""


def drive(intensity: str, name: str) -> str:
    pf = f"pf_{name}"
    return f"""{renamed(PROFILES(intensity, pf), 'wv prof', '_' + name) if name == 'b' else PROFILES(intensity, pf)},
ed_{name} AS (SELECT b.city, b.leg, b.k, p.before AS u, b.node AS v, f.u IS NOT NULL AS there FROM bk b JOIN tl l ON l.city = b.city AND l.leg = b.leg JOIN tr_p p ON p.city = b.city AND p.source = l.source AND p.node = b.node LEFT JOIN {pf} f ON f.city = b.city AND f.u = p.before AND f.v = b.node
  QUALIFY bool_and(f.u IS NOT NULL) OVER (PARTITION BY b.city, b.leg)),
sq_{name} AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY leg, k) AS n, row_number() OVER (PARTITION BY city, leg ORDER BY k DESC) = 1 AS last_ FROM ed_{name}),
dr_{name} (city, n, leg, last_, t) AS (SELECT DISTINCT city, CAST(0 AS BIGINT), -1, false, CAST(0 AS DOUBLE) FROM sq_{name} UNION ALL
  SELECT d.city, q.n, q.leg, q.last_, {ride("(d.t + CASE WHEN d.last_ THEN 120 ELSE 0 END)", 'te.length_m', 'f')} FROM dr_{name} d JOIN sq_{name} q ON q.city = d.city AND q.n = d.n + 1 JOIN te ON te.city = q.city AND te.u = q.u AND te.v = q.v JOIN {pf} f ON f.city = q.city AND f.u = q.u AND f.v = q.v)"""


LIFT = f"""WITH RECURSIVE {BRIDGE}, {TIMED}, {trees('tr', ALL_SPOTS, 'te')}, {leg_paths('tr')}, {drive('light', 'a')}, {drive('heavy', 'b').replace('mid AS', 'mid_b AS').replace('JOIN mid m', 'JOIN mid_b m')},
need AS (SELECT d.city, l.to_i AS node, CAST(ceil(round(d.t, 6)) AS BIGINT) AS need, s, k FROM (SELECT city, leg, t, 'light' AS s, 0 AS k FROM dr_a WHERE last_ UNION ALL SELECT city, leg, t, 'heavy', 1 FROM dr_b WHERE last_) d JOIN tl l ON l.city = d.city AND l.leg = d.leg WHERE l.to_i <> 0),
most AS (SELECT city, node, max(need) AS needed, arg_max(s, (need, -k)) AS worst FROM need GROUP BY ALL)
SELECT p.city, CAST(p.i AS INT) AS node, greatest(p.i * 60, coalesce(needed, 0)) AS latest, greatest(0, coalesce(needed, 0) - p.i * 60) AS lift, CASE WHEN coalesce(needed, 0) > p.i * 60 THEN worst END AS worst FROM place p LEFT JOIN most m ON m.city = p.city AND m.node = p.i"""

LINES = f"""WITH RECURSIVE {BRIDGE}, {TIMED}, {trees('tl_', ALL_SPOTS, 'le')}, {leg_paths('tl_')},
ln AS (SELECT b.city, b.leg, count(*) AS points, count(s.node_id) = count(*) AND count(*) > 1 AS good FROM bk b LEFT JOIN spot s ON s.city = b.city AND s.node_id = b.node GROUP BY ALL),
lg AS (SELECT l.city, l.leg, coalesce(x.good, false) AS good, x.points, coalesce(y.good, false) AS back, y.points AS back_points FROM tl l LEFT JOIN ln x ON x.city = l.city AND x.leg = l.leg LEFT JOIN tl r ON r.city = l.city AND r.source = l.target AND r.target = l.source LEFT JOIN ln y ON y.city = r.city AND y.leg = r.leg),
md AS (SELECT *, CASE WHEN good THEN points WHEN back THEN back_points ELSE 2 END AS n, NOT good AND NOT back AS straight FROM lg)
SELECT city, 't' AS run, CASE WHEN NOT bool_or(straight) THEN 'cached_road' WHEN bool_and(straight) THEN 'straight_line' ELSE 'mixed' END AS mode, CAST(sum(n) - count(*) + 1 AS INT) AS points FROM md GROUP BY city"""


def _hour(label: str, mean: float, std: float) -> str:
    return f"least(greatest({mean} + {std} * {g(label, 'city', 'commuter')}, 0.25), 23.75) * 3600.0"


_LUNCH = f"WHERE {u('lunch', 'city', 'commuter')} < 0.25"
FLOWS = f"""WITH RECURSIVE {_COMMUTERS}, {TIMED},
trip AS (SELECT *, row_number() OVER () AS id FROM (SELECT city, home, work, {_hour('morning', 8.0, 0.75)} AS t0, true AS inward FROM who UNION ALL SELECT city, home, work, {_hour('evening', 17.5, 1.0)}, false FROM who
  UNION ALL SELECT city, home, work, {_hour('noon_out', 12.25, 0.5)}, false FROM who {_LUNCH} UNION ALL SELECT city, home, work, {_hour('noon_back', 13.5, 0.5)}, true FROM who {_LUNCH})),
{trees('ta', 'SELECT DISTINCT city, work AS source FROM who', 'te')}, {trees('tb', 'SELECT DISTINCT city, work AS source FROM who', 've')},
hw AS (SELECT DISTINCT city, home, work FROM who),
pa (city, home, work, k, u, v) AS (SELECT h.city, h.home, h.work, t.hops, p.before, h.home FROM hw h JOIN ta t ON t.city = h.city AND t.source = h.work AND t.node = h.home JOIN ta_p p ON p.city = h.city AND p.source = h.work AND p.node = h.home UNION ALL
  SELECT a.city, a.home, a.work, a.k - 1, p.before, a.u FROM pa a JOIN ta_p p ON p.city = a.city AND p.source = a.work AND p.node = a.u),
pb (city, home, work, k, u, v) AS (SELECT h.city, h.home, h.work, 1, h.home, p.before FROM hw h JOIN tb_p p ON p.city = h.city AND p.source = h.work AND p.node = h.home UNION ALL
  SELECT b.city, b.home, b.work, b.k + 1, b.v, p.before FROM pb b JOIN tb_p p ON p.city = b.city AND p.source = b.work AND p.node = b.v),
ways AS (SELECT *, false AS inward FROM pa UNION ALL SELECT *, true FROM pb),
run AS (SELECT t.city, y.u, y.v, t.t0 + coalesce(sum(te.w) OVER (PARTITION BY t.id ORDER BY y.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM trip t JOIN ways y ON y.city = t.city AND y.home = t.home AND y.work = t.work AND y.inward = t.inward JOIN te ON te.city = t.city AND te.u = y.u AND te.v = y.v)
SELECT city, u, v, CAST(least(greatest(floor(t / 3600), 0), 23) AS INT) AS bin, count(*) AS n FROM run GROUP BY ALL"""

ANCHORS = f"""WITH RECURSIVE {STOPS},
tour (city, pos, load, clock, seen, route_idx, route) AS (SELECT city, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[]), 0, CAST([] AS BIGINT[]) FROM (SELECT DISTINCT city FROM stop) UNION ALL
  SELECT city, coalesce(j, 0), CASE WHEN j IS NULL THEN 0 ELSE load + d END, CASE WHEN j IS NULL THEN 0 ELSE clock + x + sv END, CASE WHEN j IS NULL THEN seen ELSE list_append(seen, j) END, route_idx + CASE WHEN j IS NULL THEN 1 ELSE 0 END, CASE WHEN j IS NULL THEN [] ELSE list_append(route, j) END
  FROM (SELECT t.city, any_value(t.load) AS load, any_value(t.clock) AS clock, any_value(t.seen) AS seen, any_value(t.route_idx) AS route_idx, any_value(t.route) AS route, arg_min(c.j, (c.cost, c.j)) FILTER (WHERE ok) AS j, arg_min(c.d, (c.cost, c.j)) FILTER (WHERE ok) AS d, arg_min(c.cost, (c.cost, c.j)) FILTER (WHERE ok) AS x, arg_min(c.sv, (c.cost, c.j)) FILTER (WHERE ok) AS sv
    FROM tour t JOIN (SELECT o.city, o.i, o.j, o.cost, s.demand AS d, s.service AS sv, s.capacity AS cap, b.cost AS home FROM cost o JOIN stop s ON s.city = o.city AND s.node = o.j JOIN cost b ON b.city = o.city AND b.i = o.j AND b.j = 0 WHERE o.j <> 0) c ON c.city = t.city AND c.i = t.pos AND NOT list_contains(t.seen, c.j),
    LATERAL (SELECT t.load + c.d <= c.cap AND t.clock + c.cost + c.sv + c.home <= 86400 AS ok) GROUP BY t.city))
SELECT city, route_idx, route FROM tour WHERE len(route) > 0 QUALIFY row_number() OVER (PARTITION BY city, route_idx ORDER BY len(route) DESC) = 1"""

_HAV = "(2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(aim.y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(aim.y)) * pow(sin(radians(aim.x - lon) / 2), 2)))))"
INSTANCE = f"""WITH RECURSIVE {TRIMMED}, {_POI},
vert AS (SELECT x.city, node_id, lat, lon FROM (SELECT city, u AS node_id FROM sg_t UNION SELECT city, v FROM sg_t) x JOIN n USING (node_id)),
aim AS (SELECT city, avg(lat) AS y, avg(lon) AS x FROM vert GROUP BY city), depot AS (SELECT vert.city, arg_min(node_id, (round({_HAV}, 6), node_id)) AS node_id FROM vert JOIN aim ON aim.city = vert.city GROUP BY vert.city),
free AS (SELECT * FROM vert ANTI JOIN depot USING (city, node_id)),
pf AS (SELECT city, point_id, east, north FROM {frame('poi1')}), nf AS (SELECT city, node_id, east, north FROM {frame('n')}),
near AS (SELECT p.city, p.point_id, arg_min(q.node_id, (pow(p.east - q.east, 2) + pow(p.north - q.north, 2), q.node_id)) AS node_id FROM pf p JOIN nf q ON q.city = p.city AND abs(p.east - q.east) <= 100 AND abs(p.north - q.north) <= 100 GROUP BY ALL),
snap AS (SELECT near.* FROM near SEMI JOIN free f ON f.city = near.city AND f.node_id = near.node_id),
pk AS (SELECT city, node_id, min(({u('poi', 'point_id')}, point_id)) AS k FROM snap GROUP BY ALL), pp AS (SELECT city, node_id, 0 AS prio, row_number() OVER (PARTITION BY city ORDER BY k) AS place, 'poi' AS tag FROM pk QUALIFY place <= 5),
dr AS (SELECT city, node_id, row_number() OVER (PARTITION BY city ORDER BY {u('random', 'node_id', seed=8)}, node_id) AS place FROM free QUALIFY place <= 10),
al AS (SELECT * FROM pp UNION ALL SELECT city, node_id, CASE WHEN place <= 5 THEN 1 ELSE 2 END, place, CASE WHEN place <= 5 THEN 'param' ELSE 'param_fill' END FROM dr), b AS (SELECT city, node_id, min((prio, place, tag)) AS k FROM al GROUP BY ALL),
c AS (SELECT city, node_id, row_number() OVER (PARTITION BY city ORDER BY k[1], k[2], node_id) AS i, k[3] AS source_tag FROM b QUALIFY i <= 10)
SELECT vert.city, CAST(c.i AS INT) AS i, vert.node_id, lat, lon, {between(*DEMAND_BANDS[2], u('demand2', 'vert.city', 'c.i'))} AS demand, source_tag FROM c JOIN vert USING (city, node_id)
UNION ALL SELECT vert.city, 0, vert.node_id, lat, lon, 0, 'depot' FROM depot JOIN vert USING (city, node_id)"""

#: pool (city, node_id): the workplaces.
WORKS = _COMMUTERS[: _COMMUTERS.index(",\nwk AS (")]
RUN_STOPS = """
most AS (SELECT instance_id, max(list_max(route)) AS top FROM route WHERE instance_id IS NOT NULL GROUP BY instance_id HAVING max(list_max(route)) > 0),
m AS (SELECT run_id, min(node) AS mn, max(node) AS mx, count(DISTINCT node) AS cd FROM cust_ GROUP BY run_id),
r AS (SELECT route.*, coalesce(mn >= 1 AND mx <= top AND (cd = top OR mn < 2), false) AS places, coalesce(mn >= 2 AND mx <= top + 1, false) AS ids, top FROM route JOIN m USING (run_id) LEFT JOIN most USING (instance_id) WHERE instance_id IS NOT NULL),
x AS (SELECT *, CASE WHEN top IS NULL THEN 'no depot' WHEN NOT places AND NOT ids THEN 'unknown node' END AS problem FROM r)
SELECT run_id, CAST(route_idx AS BIGINT) AS route_idx, problem, CAST(generate_subscripts(route, 1) - 1 AS BIGINT) AS place, CAST(unnest(route) + CASE WHEN places THEN 1 ELSE 0 END AS BIGINT) AS node FROM x WHERE problem IS NULL
UNION ALL SELECT run_id, route_idx, problem, NULL, NULL FROM x WHERE problem IS NOT NULL"""

_RANKED = " UNION ALL ".join(f"SELECT l.city, l.place, {k} AS rank, t.hops + 1 AS points FROM legs l JOIN t{k} t ON t.city = l.city AND t.source = l.source AND t.node = l.target" for k in range(4))
_DEPOT_SOURCES = "SELECT city, source FROM depot"
CANDIDATES = f"""WITH RECURSIVE {FALLBACK}, spot_ AS (SELECT DISTINCT city, node_id, lat, lon FROM step),
aim AS (SELECT city, avg(lat) AS y, avg(lon) AS x FROM spot_ GROUP BY city), depot AS (SELECT spot_.city, arg_min(node_id, (round({_HAV}, 6), node_id)) AS source FROM spot_ JOIN aim ON aim.city = spot_.city GROUP BY spot_.city),
legs AS (SELECT a.city, d.source, a.node_id AS target, row_number() OVER (PARTITION BY a.city ORDER BY {u('random', 'a.node_id')}, a.node_id) AS place FROM spot_ a JOIN depot d ON d.city = a.city WHERE a.node_id <> d.source QUALIFY place <= 8),
g0 AS (SELECT city, u, v, length_m AS w FROM sg_t), g1 AS (SELECT city, u, v, length_m AS w FROM edge_t), g2 AS (SELECT city, u, v, length_m AS w FROM sg_f), g3 AS (SELECT city, u, v, length_m AS w FROM edge),
{', '.join(trees(f't{k}', _DEPOT_SOURCES, f'g{k}') for k in range(4))}
SELECT city, place AS to_node, rank, CAST(points AS INT) AS points FROM ({_RANKED}) QUALIFY row_number() OVER (PARTITION BY city, place ORDER BY rank) = 1"""

ORACLES = {
    "candidate_lines": CANDIDATES,
    "road_parallel_min": f"WITH RECURSIVE {STEPS}, {SEG('_f')} SELECT city, u, v, class, round(length_m, 3) AS length_m FROM sg_f",
    "road_crop": CROP,
    "road_graph": f"WITH RECURSIVE {FALLBACK} SELECT city, u, v, class, round(length_m, 3) AS length_m, oi AS only_intersections, tr AS trim FROM built",
    "trimmed_sidecar": f"""WITH RECURSIVE {BRIDGE}, {TIMED}, {USED}, ids AS (SELECT city, id, row_number() OVER (PARTITION BY city ORDER BY id) - 1 AS k FROM (SELECT city, u AS id FROM used UNION SELECT city, v FROM used))
SELECT x.city, x.u AS osm_u, x.v AS osm_v, a.k::INT AS u, b.k::INT AS v, round(be.length_m, 3) AS length_m FROM used x JOIN be ON be.city = x.city AND be.u = x.u AND be.v = x.v JOIN ids a ON a.city = x.city AND a.id = x.u JOIN ids b ON b.city = x.city AND b.id = x.v""",
    "path_arrivals": ARRIVALS,
    "deadline_lift": LIFT,
    "route_polylines": LINES,
    "hourly_flows": FLOWS,
    "anchor_routes": ANCHORS,
    "instance_nodes": INSTANCE,
    "zone_features": f"""WITH {_POI} SELECT city, to_json({{'type': 'FeatureCollection', 'features': list({{'type': 'Feature', 'properties': {{'point_id': point_id}}, 'geometry': {{'type': 'Point', 'coordinates': [lon, lat]}}}} ORDER BY point_id)}})::VARCHAR AS geojson FROM poi1 GROUP BY city""",
}
