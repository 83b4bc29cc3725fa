"""Chains from map records to files: instances, their time windows and their traffic twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.operators import nearest, roads, schedules, traffic
from waymesh.plans import pipeline
from waymesh.session import cut
from waymesh.sources import instances


def base_name(city: str, n: int, method: str, routes: int | None = None, *extra: str) -> str:
    """The name of an instance; extra keys (seed, demand kind, route band) keep bulk instances apart."""
    return "-".join([city.lower(), f"n{n + 1}", method, *([f"k{routes}"] if routes else []), *extra])


def layout(df: DataFrame, path: str, *by: str) -> None:
    """Write a table under folders of its keys, for example problem, metric, city, n, base."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def generate(nodes: DataFrame, road_ways: DataFrame, pois: DataFrame, request: pipeline.Request, out: str | None = None) -> dict[str, DataFrame]:
    """One instance per city with costs by three metrics; written as texts and metadata if out is given.

    Returns nodes (city, i, node_id, lat, lon, east, north, demand, source_tag), costs (city, metric, i, j, cost), fleet, edges and
    texts (name, value). Cities whose places cannot all reach each other give no texts: their costs have nulls.
    """
    edges = cut(pipeline.road_graph_with_fallback(road_ways, nodes).select("city", "u", "v", "class", "length_m", "first_pos"))
    drawn = pipeline.instance_nodes(edges, nodes, pois, request)
    placed = cut(nearest.in_city_frame(drawn, roads.city_bounds(nodes)))
    flat = nearest.euclid_table(placed).withColumn("metric", F.lit("euclidean"))
    costs = cut(pipeline.cost_tables(edges, placed).unionByName(flat.select("city", "metric", "i", "j", "cost")))
    from waymesh.operators import sampling

    size = cut(sampling.fleet(placed.where("i > 0")))
    texts = None
    for metric in ("euclidean", "shortest", "fastest"):
        table = costs.where(F.col("metric") == metric)
        whole = table.groupBy("city").agg(F.max(F.col("cost").isNull()).alias("gap")).where("NOT gap").select("city")
        spots = placed.select("city", "i", F.round("lon", 7).alias("x"), F.round("lat", 7).alias("y"), "demand")
        made = instances.gathered(spots.join(whole, "city", "left_semi"), table, size).withColumn("name", F.concat_ws("-", "name", F.lit(metric)))
        part = instances.instance_text(made)
        texts = part if texts is None else texts.unionByName(part)
    if out:
        instances.write_texts(texts, f"{out}/instances")
        meta = placed.select("city", "i", F.col("node_id").alias("graph_vertex_id"), F.col("lat").alias("poi_lat"), F.col("lon").alias("poi_lon"), F.col("east").alias("enu_x"), F.col("north").alias("enu_y"), "demand", "source_tag")
        instances.write_texts(instances.metadata_json(meta, []).withColumnRenamed("city", "name"), f"{out}/metadata")
    return {"nodes": placed, "costs": costs, "fleet": size, "edges": edges, "texts": texts}


def derive_windows(spark: SparkSession, path: str, method: str, seed: int, out: str | None = None) -> DataFrame:
    """Instances read from texts below path with service times and windows, as texts (name, value); costs are seconds."""
    read = cut(instances.read_instances(spark, path))
    costs = instances.cost_rows(read).withColumn("cost", F.col("cost").cast("long"))
    nodes = read.select(F.col("name").alias("city"), F.posexplode("demands").alias("node", "demand")).withColumn("node", F.col("node").cast("long"))
    timed = pipeline.vrptw(nodes, costs.withColumns({"i": F.col("i").cast("long"), "j": F.col("j").cast("long")}), method, seed)
    per = timed.groupBy("city").agg(F.array_sort(F.collect_list(F.struct("node", "service", F.struct("earliest", "latest").alias("w")))).alias("x"))
    joined = read.drop("windows", "services").join(per, read.name == per.city)
    texts = instances.instance_text(joined.withColumns({"windows": F.col("x.w"), "services": F.col("x.service")}), windows=True)
    if out:
        instances.write_texts(texts, out)
    return texts


def derive_traffic(edges: DataFrame, vertices: DataFrame, places: DataFrame, stops: DataFrame, routes: DataFrame, combos: list[tuple[str, str]], seed: int, snapped: DataFrame | None = None) -> dict[str, DataFrame]:
    """Traffic twins of instances: speeds per combination of model and intensity on the trimmed graph, and windows lifted for all.

    places: city, i, node_id; stops: city, node, service, earliest, latest; routes: city, run, route_idx, route (the anchors);
    snapped: city, node_id of the snapped points of interest, for the workplaces of bpr.
    Returns speeds (city, model, intensity, u, v, profile), windows (stops with lift and worst), functions (arrival-time functions
    of the anchors' arcs) and late, the stops that would still be late under the lifted windows: none, or the result is wrong.
    """
    trimmed = cut(pipeline.trimmed_graph(edges, places))
    limit = roads.fastest_parallel(trimmed, ["city"]).select("city", "u", "v", traffic.free_speed(F.col("class")).alias("limit"))
    used = schedules.legs(routes).select("city", F.col("from_node").cast("int").alias("i"), F.col("to_node").cast("int").alias("j")).distinct()
    ids = lambda k, n: places.select("city", F.col("i").cast("int").alias(k), F.col("node_id").alias(n))
    need = cut(used.join(ids("i", "source"), ["city", "i"]).join(ids("j", "target"), ["city", "j"]))
    most = places.groupBy("city").agg(F.max("i").alias("n")).agg(F.max("n")).first()[0] or 0
    speeds = needs = functions = None
    drives = []
    for pos, (model, intensity) in enumerate(combos):
        profiles = traffic.overlay(pipeline.bridge(edges, vertices, model, intensity, seed, snapped), limit)
        arcs = cut(pipeline.timed_paths(trimmed, profiles, places, need))
        drives.append(arcs)
        tag = lambda df: df.withColumns({"model": F.lit(model), "intensity": F.lit(intensity)})  # noqa: B023, E731
        s, f = tag(profiles), tag(traffic.arrival_functions(arcs, tolerance_s=traffic.tolerance_for(most)))
        n = pipeline.audit(routes, arcs, stops).select("city", "node", "begin", F.lit(f"{model}-{intensity}").alias("sub"), F.lit(pos).alias("sub_pos"))
        speeds, functions, needs = (a if b is None else b.unionByName(a) for a, b in ((s, speeds), (f, functions), (n, needs)))
    lifted = cut(schedules.lifted_windows(needs, stops))
    late = None
    for arcs in drives:
        again = pipeline.audit(routes, arcs, lifted).join(lifted.select("city", "node", "latest"), ["city", "node"]).where((F.col("node") != 0) & (F.col("begin") > F.col("latest") + 1e-6))
        late = again if late is None else late.unionByName(again)
    return {"speeds": speeds, "windows": lifted, "functions": functions, "late": late}
