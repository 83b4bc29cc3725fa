"""Queries of the chains and of smaller operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.functions import scalars
from waymesh.operators import geometry, nearest, sampling, schedules, solutions
from waymesh.plans import network, pipeline
from waymesh.plans.chain_sql import ORACLES, RUN_STOPS, WORKS
from waymesh.plans.network_sql import RUNS, STOPS
from waymesh.session import table
from waymesh.sources import instances


def work_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The workplaces of each bridge graph: its vertices with a snapped POI, or all where fewer than 50 have one."""
    return network._works(spark, sf, network._bridge_spots(network._bridges(spark, sf)))


def method_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Short names of methods and display names of instances."""
    s = table(spark, sf, "solution").select("method", "instance_name").distinct()
    return s.select("method", "instance_name", scalars.method_name(F.col("method")).alias("short"), scalars.city_label(F.col("instance_name")).alias("label"))


def vrp_json_files(spark: SparkSession, sf: str) -> DataFrame:
    """Instances written as JSON documents and read back, with the rule each breaks."""
    s = network._stops(spark, sf)
    c = s.select("city", F.col("node").alias("i"), F.col("node").cast("double").alias("x"), (F.col("node") * 2).cast("double").alias("y"), "demand")
    made = instances.gathered(c, network._costs(s), s.select("city", "capacity").distinct())
    back = instances.read_vrp_json(instances.vrp_json(made.withColumn("metric", F.lit("fastest")), "own", "own", ["metric"]))
    total = lambda c, zero: F.aggregate(c, zero, lambda a, x: a + x)
    return back.select("name", "dimension", "capacity", "depot", total(F.flatten("costs"), F.lit(0.0)).alias("cost_sum"), total("demands", F.lit(0).cast("long")).alias("demand_sum"), "problem")


def instance_guards(spark: SparkSession, sf: str) -> DataFrame:
    """What keeps each instance from being a real one, for three capacities."""
    d = network._stops(spark, sf).groupBy("city").agg(F.array_sort(F.collect_list(F.struct("node", "demand"))).alias("x")).select("city", F.col("x.demand").alias("demands"))
    each = d.select("city", "demands", F.explode(F.array(*(F.lit(c).cast("long") for c in (8, 40, 400)))).alias("capacity"))
    return each.select("city", "capacity", instances.size_problem(F.col("demands"), F.col("capacity")).alias("problem"))


def routes_on_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The recorded routes in ids from 1, where the ids of an instance are those up to its largest customer; each stop of each route."""
    runs = solutions.customer_routes(solutions.runs_once(table(spark, sf, "solution")).where("instance_id IS NOT NULL"))
    top = runs.groupBy("instance_id").agg(F.max(F.array_max("route")).cast("long").alias("top")).where("top > 0")
    ids = top.select("instance_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top") + 1)).alias("node_id"))
    found = instances.routes_by_ids(runs, ids)
    return found.select("run_id", F.col("route_idx").cast("long").alias("route_idx"), "problem", F.posexplode_outer("route").alias("place", "node")).withColumn("place", F.col("place").cast("long"))


def solution_route_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Routes of each run, and customers of its largest and smallest one."""
    r = solutions.route_sizes(solutions.customer_routes(solutions.runs_once(table(spark, sf, "solution"))))
    return r.select("run_id", "n_routes", F.col("most").cast("long").alias("most"), F.col("least").cast("long").alias("least"))


def customer_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of each city's hybrid choice by their source."""
    return sampling.source_counts(network.customers_hybrid(spark, sf))


def lift_totals(spark: SparkSession, sf: str) -> DataFrame:
    """How many windows of each tour were raised, and the greatest lift."""
    return schedules.lift_statistics(network.deadline_lift(spark, sf))


def instance_maps(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of each instance as GeoJSON with their places from 0."""
    n = network._stops(spark, sf).select("city", (F.col("node") + 1).alias("instance_node_id"), (F.col("node") / 8.0).alias("lon"), (F.col("node") / 4.0).alias("lat"), "demand", F.lit(None).cast("string").alias("source_tag"))
    return geometry.instance_features(n)


def fleet_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded anchors of the instances whose name has one character; for the others the nearest-neighbour tour."""
    s = network._stops(spark, sf)
    c = network._costs(s)
    known = schedules.anchor_routes(c, s).where("length(city) = 1")
    return schedules.anchors_or_tours(known, c).select("city", "run", "route_idx", "route")


def candidate_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the legs from each city's depot to its random customers on the first candidate graph that has them."""
    n = network._nodes(spark, sf)
    used = network._paths(spark, sf).select("city", F.explode("path.node_id").alias("node_id")).distinct()
    at = used.join(n.select("node_id", "lat", "lon"), "node_id").select("city", "node_id", "lat", "lon")
    depot = nearest.depots(at, "center").select("city", F.col("node_id").alias("source"))
    stops = sampling.random_customers(at.join(depot.withColumnRenamed("source", "node_id"), ["city", "node_id"], "left_anti"), network.CUSTOMERS, network.SEED)
    need = stops.join(depot, "city").select("city", F.lit(0).cast("long").alias("from_node"), F.col("place").cast("long").alias("to_node"), "source", F.col("node_id").alias("target"))
    found = pipeline.candidate_lines(network._roads(spark, sf), n, need)
    return found.select("city", "to_node", "rank", F.size("line").alias("points"))


QUERIES = {
    f.__name__: f
    for f in (work_pool, method_labels, vrp_json_files, instance_guards, routes_on_ids, solution_route_sizes, customer_sources, lift_totals, instance_maps, fleet_anchors, candidate_lines)
}

ORACLES = ORACLES | {
    "work_pool": f"WITH {WORKS} SELECT city, node_id FROM pool",
    "method_labels": """SELECT DISTINCT method, instance_name, CASE lower(trim(method)) WHEN 'poi_categories' THEN 'poi' WHEN 'parametric_attach' THEN 'par' WHEN 'hybrid' THEN 'hyb'
  ELSE CASE WHEN regexp_replace(regexp_replace(lower(trim(method)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN 'x' ELSE regexp_replace(regexp_replace(lower(trim(method)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') END END AS short,
  trim(replace(replace(instance_name, '-', ' '), '_', ' ')) AS label FROM solution""",
    "vrp_json_files": f"WITH {STOPS} SELECT s.city AS name, s.k::INT AS dimension, CAST(40 AS BIGINT) AS capacity, 1 AS depot, c.c AS cost_sum, CAST(s.d AS BIGINT) AS demand_sum, NULL::VARCHAR AS problem FROM (SELECT city, count(*) AS k, sum(demand) AS d FROM stop GROUP BY city) s JOIN (SELECT city, CAST(sum(cost) AS DOUBLE) AS c FROM cost GROUP BY city) c ON c.city = s.city",
    "instance_guards": f"WITH {STOPS}, d AS (SELECT city, sum(demand) AS total, max(demand) AS most FROM stop GROUP BY city) SELECT city, CAST(q AS BIGINT) AS capacity, CASE WHEN ceil(total / q) < 2 THEN 'one vehicle is enough' WHEN most > q THEN 'a demand above the capacity' END AS problem FROM d, (VALUES (8), (40), (400)) v(q)",
    "routes_on_ids": f"WITH {RUNS}, {RUN_STOPS}",
    "solution_route_sizes": f"WITH {RUNS} SELECT run_id, count(*) AS n_routes, max(len(route)) AS most, min(len(route)) AS least FROM route GROUP BY run_id",
    "lift_totals": f"SELECT city, count(*) FILTER (WHERE lift > 0) AS n_lifted, max(lift) AS max_lift FROM ({ORACLES['deadline_lift']}) GROUP BY city",
    "customer_sources": f"SELECT city, count(*) FILTER (WHERE source_tag = 'poi') AS n_poi, count(*) FILTER (WHERE source_tag <> 'poi') AS n_param FROM ({network.ORACLES['customers_hybrid']}) GROUP BY city",
    "instance_maps": f"""WITH {STOPS}, f AS (SELECT city, node, {{'type': 'Feature', 'properties': {{'instance_node_id': node + 1, 'model_node_id': node, 'role': CASE node WHEN 0 THEN 'depot' ELSE 'customer' END, 'demand': demand, 'source_tag': 'unknown'}},
  'geometry': {{'type': 'Point', 'coordinates': [node / 8.0, node / 4.0]}}}} AS f FROM stop) SELECT city, to_json({{'type': 'FeatureCollection', 'features': list(f ORDER BY node)}})::VARCHAR AS geojson FROM f GROUP BY city""",
    "fleet_anchors": f"SELECT city, 'anchor' AS run, route_idx, route FROM ({ORACLES['anchor_routes']}) WHERE length(city) = 1 UNION ALL SELECT city, 'tour', 0, route FROM ({network.ORACLES['nearest_tours']}) WHERE length(city) <> 1",
}
