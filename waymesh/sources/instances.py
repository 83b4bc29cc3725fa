"""Routing instances and traffic sidecars as files: readers with checks, and writers of one text per instance."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INSTANCE = "path string, name string, comment string, type string, dimension int, capacity bigint, depot int, costs array<array<double>>, coordinates array<struct<x: double, y: double>>, demands array<bigint>, windows array<struct<earliest: bigint, latest: bigint>>, services array<bigint>, error string"
_SECTIONS = {"EDGE_WEIGHT_SECTION": "costs", "NODE_COORD_SECTION": "coordinates", "DEMAND_SECTION": "demands", "TIME_WINDOW_SECTION": "windows", "SERVICE_TIME_SECTION": "services", "DEPOT_SECTION": "depots", "EOF": ""}


def parse_instance(text: str) -> dict:
    """The parts of one instance in the TSPLIB manner. Raises ValueError if a header is missing or a section has another size."""
    head: dict[str, str] = {}
    rows: dict[str, list[list[str]]] = {v: [] for v in _SECTIONS.values() if v}
    now = ""
    for line in map(str.strip, text.splitlines()):
        if line in _SECTIONS:
            now = _SECTIONS[line]
        elif now == "depots" and line == "-1":
            now = ""
        elif line and now:
            rows[now].append(line.split())
        elif ":" in line:
            key, _, value = line.partition(":")
            head[key.strip()] = value.strip()
    for key in ("DIMENSION", "CAPACITY"):
        if key not in head:
            raise ValueError(f"no {key}")
    n = int(head["DIMENSION"])
    flat = [float(x) for r in rows["costs"] for x in r]
    if len(flat) != n * n:
        raise ValueError(f"{len(flat)} costs for dimension {n}")
    for part, width in (("coordinates", 3), ("demands", 2), ("windows", 3), ("services", 2)):
        rows[part] = [r for r in rows[part] if len(r) >= width]
        if len(rows[part]) != n and (rows[part] or part in ("coordinates", "demands")):
            raise ValueError(f"{len(rows[part])} {part} for dimension {n}")
    return {
        "name": head.get("NAME", ""), "comment": head.get("COMMENT", ""), "type": head.get("TYPE", ""), "dimension": n, "capacity": int(head["CAPACITY"]), "depot": int(rows["depots"][0][0]) if rows["depots"] else 1,
        "costs": [flat[k * n : k * n + n] for k in range(n)], "coordinates": [{"x": float(r[1]), "y": float(r[2])} for r in rows["coordinates"]], "demands": [int(r[1]) for r in rows["demands"]],
        "windows": [{"earliest": int(r[1]), "latest": int(r[2])} for r in rows["windows"]] or None, "services": [int(r[1]) for r in rows["services"]] or None,
    }


def parsed(texts: DataFrame, strict: bool = True) -> DataFrame:
    """Instances of texts (path, value). Without strict a bad text gives a row with its error instead of failing."""
    def run(frames):
        for f in frames:
            out = []
            for path, value in zip(f["path"], f["value"]):
                try:
                    out.append({"path": path, **parse_instance(value or ""), "error": None})
                except ValueError as e:
                    if strict:
                        raise ValueError(f"{path}: {e}") from None
                    out.append({"path": path, "error": str(e)})
            names = [c.split()[0] for c in _columns()]
            yield type(f)([[r.get(n) for n in names] for r in out], columns=names, dtype=object)

    return texts.select("path", "value").mapInPandas(run, INSTANCE)


def _columns() -> list[str]:
    out, depth, word = [], 0, ""
    for ch in INSTANCE + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(word.strip())
            word = ""
        else:
            word += ch
    return out


def read_instances(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """All instance files under a path, one row each."""
    return parsed(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"), strict)


def cost_rows(instances: DataFrame, key: str = "name") -> DataFrame:
    """(city, i, j, cost): the cost tables in long form, from 0, without the diagonal; city is the instance's key."""
    a = instances.select(F.col(key).alias("city"), F.posexplode("costs").alias("i", "r")).select("city", "i", F.posexplode("r").alias("j", "cost"))
    return a.where("i <> j")


def _lines(items: Column, number) -> Column:
    return F.transform(items, number)


def _whole(x: Column) -> Column:
    return x.cast("bigint").cast("string")


def instance_text(instances: DataFrame, decimals: int | None = None, windows: bool = False) -> DataFrame:
    """(name, value): each instance as a TSPLIB text. decimals None writes whole costs, else that many decimals and six for coordinates."""
    cost = _whole if decimals is None else (lambda x: F.format_string(f"%.{decimals}f", x))
    spot = (lambda x: x.cast("string")) if decimals is None else (lambda x: F.format_string("%.6f", x))
    rows = F.transform("costs", lambda r: F.array_join(F.transform(r, cost), " "))
    at = lambda k, *xs: F.concat_ws(" ", (k + 1).cast("string"), *xs)
    head = F.filter(F.array(F.concat(F.lit("NAME : "), "name"), F.lit("TYPE : " + ("CVRPTW" if windows else "CVRP")), F.when(F.col("comment") != "", F.concat(F.lit("COMMENT : "), "comment")), F.concat(F.lit("DIMENSION : "), F.col("dimension").cast("string")), F.concat(F.lit("CAPACITY : "), F.col("capacity").cast("string"))), lambda x: x.isNotNull())
    parts = [head, F.array(*map(F.lit, ("EDGE_WEIGHT_TYPE : EXPLICIT", "EDGE_WEIGHT_FORMAT : FULL_MATRIX", "EDGE_WEIGHT_SECTION"))), rows, F.array(F.lit("NODE_COORD_SECTION")), F.transform("coordinates", lambda c, k: at(k, spot(c["x"]), spot(c["y"]))), F.array(F.lit("DEMAND_SECTION")), F.transform("demands", lambda d, k: at(k, d.cast("string")))]
    if windows:
        parts += [F.array(F.lit("TIME_WINDOW_SECTION")), F.transform("windows", lambda w, k: at(k, w["earliest"].cast("string"), w["latest"].cast("string"))), F.array(F.lit("SERVICE_TIME_SECTION")), F.transform("services", lambda s, k: at(k, s.cast("string")))]
    parts.append(F.array(F.lit("DEPOT_SECTION"), F.col("depot").cast("string"), F.lit("-1"), F.lit("EOF")))
    return instances.select("name", F.concat(F.array_join(F.concat(*parts), "\n"), F.lit("\n")).alias("value"))


def gathered(customers: DataFrame, costs: DataFrame, capacities: DataFrame) -> DataFrame:
    """Instances of long tables: customers (city, i from 0, x, y, demand), costs (city, i, j, cost), capacities (city, capacity)."""
    c = customers.groupBy("city").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y", "demand"))).alias("c"))
    diagonal = customers.select("city", "i", F.col("i").alias("j"), F.lit(0.0).alias("cost"))
    full = costs.select("city", "i", "j", F.col("cost").cast("double").alias("cost")).unionByName(diagonal)
    rows = full.groupBy("city", "i").agg(F.array_sort(F.collect_list(F.struct("j", "cost"))).alias("r"))
    m = rows.groupBy("city").agg(F.array_sort(F.collect_list(F.struct("i", F.col("r.cost").alias("cost")))).alias("m"))
    joined = c.join(m, "city").join(capacities.select("city", "capacity"), "city")
    xy = F.transform("c", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return joined.select(F.col("city").alias("name"), F.lit("").alias("comment"), F.size("c").alias("dimension"), F.col("capacity").cast("bigint").alias("capacity"), F.lit(1).alias("depot"), F.col("m.cost").alias("costs"), xy.alias("coordinates"), F.col("c.demand").alias("demands"))


def write_texts(texts: DataFrame, path: str) -> None:
    """One folder per instance below path, each with its text; the name never repeats the text's columns."""
    texts.select("name", F.regexp_replace("value", "\n$", "").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def metadata_json(nodes: DataFrame, attributes: list[str]) -> DataFrame:
    """(city, value): instance metadata of nodes (city, i from 0, graph_vertex_id, poi_lat, poi_lon, enu_x, enu_y, demand, source_tag)."""
    node = F.struct((F.col("i") + 1).alias("instance_node_id"), "graph_vertex_id", "poi_lat", "poi_lon", "enu_x", "enu_y", "demand", "source_tag")
    per = nodes.groupBy("city", *attributes).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    return per.select("city", F.to_json(F.struct(F.lit(2).alias("schema_version"), "city", *attributes, "nodes")).alias("value"))


# --- traffic sidecars -------------------------------------------------------------------------------------------------

VERSION = 2
_EDGE = "ARRAY<STRUCT<osm_u: BIGINT, osm_v: BIGINT, length_m: DOUBLE, road_class: INT, free_speed_ms: DOUBLE>>"
GRAPH_JSON = "schema_version INT, city STRING, osm_file STRING, num_bins INT, bin_seconds DOUBLE, vertices ARRAY<ARRAY<STRING>>, edges ARRAY<ARRAY<STRING>>"
SPEEDS_JSON = "schema_version INT, city STRING, model STRING, intensity STRING, seed BIGINT, num_trips BIGINT, speeds ARRAY<ARRAY<DOUBLE>>"
NODES_JSON = "schema_version INT, city STRING, instance_base STRING, depot_first BOOLEAN, node_osm_ids ARRAY<BIGINT>"


def graph_json(graphs: DataFrame) -> DataFrame:
    """(city, value): graphs (city, osm_file, num_bins, bin_seconds, vertices, edges) with vertices by id and edges in order, as arrays."""
    v = F.transform(F.array_sort(F.transform("vertices", lambda x: F.struct(x["osm_id"], x["lon"], x["lat"]))), lambda x: F.concat(F.lit("["), x["osm_id"].cast("string"), F.lit(","), x["lon"].cast("string"), F.lit(","), x["lat"].cast("string"), F.lit("]")))
    e = F.transform("edges", lambda x: F.concat(F.lit("["), F.concat_ws(",", x["osm_u"].cast("string"), x["osm_v"].cast("string"), x["length_m"].cast("string"), x["road_class"].cast("string"), x["free_speed_ms"].cast("string")), F.lit("]")))
    head = F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), "city", "osm_file", "num_bins", "bin_seconds", F.lit("m/s").alias("speed_unit"), F.lit("m").alias("length_unit")))
    value = F.concat(F.substring(head, 1, 1 << 30).substr(F.lit(1), F.length(head) - 1), F.lit(',"vertices":['), F.array_join(v, ","), F.lit('],"edges":['), F.array_join(e, ","), F.lit("]}"))
    return graphs.select("city", value.alias("value"))


def read_graphs(texts: DataFrame) -> DataFrame:
    """Graphs of JSON texts (value), with problem: null, or the first rule that a graph breaks. Ids keep all their digits."""
    j = texts.select(F.from_json("value", GRAPH_JSON).alias("g")).select("g.*")
    whole, real = (lambda x: x.try_cast("bigint")), (lambda x: x.try_cast("double"))
    edges = F.transform("edges", lambda x: F.struct(whole(F.get(x, 0)).alias("osm_u"), whole(F.get(x, 1)).alias("osm_v"), real(F.get(x, 2)).alias("length_m"), F.get(x, 3).try_cast("int").alias("road_class"), real(F.get(x, 4)).alias("free_speed_ms")))
    spots = F.transform("vertices", lambda v: F.struct(whole(F.get(v, 0)).alias("osm_id"), real(F.get(v, 1)).alias("lon"), real(F.get(v, 2)).alias("lat")))
    j = j.withColumns({"_width": F.transform("edges", F.size), "edges": edges, "vertices": spots})
    problem = (
        F.when(F.col("schema_version").isNull() | (F.col("schema_version") != VERSION), "version")
        .when(F.col("num_bins").isNull() | F.col("bin_seconds").isNull() | (F.col("num_bins") * F.col("bin_seconds") != 86400), "bins do not make a day")
        .when(F.coalesce(F.size("edges"), F.lit(0)) < 1, "no edges")
        .when(F.exists("_width", lambda n: n != 5), "edge without five values")
        .when(~F.forall("edges", lambda e: F.coalesce((e["length_m"] > 0) & (e["free_speed_ms"] > 0), F.lit(False))), "length or speed not above zero")
        .when(F.size(F.array_except(F.concat(F.col("edges.osm_u"), F.col("edges.osm_v")), F.col("vertices.osm_id"))) > 0, "unknown vertex")
    )
    return j.select("city", "osm_file", "num_bins", "bin_seconds", "edges", "vertices", problem.alias("problem"))


def speeds_json(profiles: DataFrame) -> DataFrame:
    """(city, model, intensity, value): profiles (city, model, intensity, seed, num_trips, edge_idx, profile) in edge order."""
    keys = ["city", "model", "intensity", "seed", "num_trips"]
    per = profiles.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("edge_idx", "profile"))).alias("p"))
    return per.select("city", "model", "intensity", F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), *keys, F.col("p.profile").alias("speeds"))).alias("value"))


def read_speeds(texts: DataFrame, edges: DataFrame, bins: int = 24) -> DataFrame:
    """Speeds of JSON texts with problem; edges (city, n_edges) says how many profiles there must be."""
    j = texts.select(F.from_json("value", SPEEDS_JSON).alias("s")).select("s.*").join(edges.select("city", "n_edges"), "city", "left")
    problem = (
        F.when(F.col("schema_version").isNull() | (F.col("schema_version") != VERSION), "version")
        .when(~F.size("speeds").eqNullSafe(F.col("n_edges").cast("int")), "not one profile per edge")
        .when(F.exists("speeds", lambda p: F.size(p) != bins), "not one speed per bin")
        .when(~F.forall("speeds", lambda p: F.forall(p, lambda x: F.coalesce(x > 0, F.lit(False)))), "speed not above zero")
    )
    return j.withColumn("problem", problem)


def nodes_json(nodes: DataFrame) -> DataFrame:
    """(city, instance_base, value): nodes (city, instance_base, i, osm_id) in order, the depot first."""
    per = nodes.groupBy("city", "instance_base").agg(F.array_sort(F.collect_list(F.struct("i", "osm_id"))).alias("n"))
    return per.select("city", "instance_base", F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), "city", "instance_base", F.lit(True).alias("depot_first"), F.col("n.osm_id").alias("node_osm_ids"))).alias("value"))


def read_node_lists(texts: DataFrame) -> DataFrame:
    """Node lists of JSON texts with problem: at least two nodes, all different, depot first."""
    j = texts.select(F.from_json("value", NODES_JSON).alias("n")).select("n.*")
    n = F.size("node_osm_ids")
    problem = F.when(F.col("schema_version").isNull() | (F.col("schema_version") != VERSION), "version").when(~F.coalesce("depot_first", F.lit(False)), "depot not first").when(F.coalesce(n, F.lit(0)) < 2, "fewer than two nodes").when(n != F.size(F.array_distinct("node_osm_ids")), "repeated node")
    return j.withColumn("problem", problem)


def read_manifests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All manifests below a path, latest first; corrupt files are skipped."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return df.orderBy(F.desc_nulls_last("created_at")) if "created_at" in df.columns else df


def canonical_hash(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by..., sha256) of each group's rows in the order of the columns: the same for the same rows, however they are stored."""
    per = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("x"))
    return per.select(*by, F.sha2(F.to_json("x"), 256).alias("sha256"))


# --- JSON instances, guards, exports -----------------------------------------------------------------------------------


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files, plain or compressed, one document each; a broken one is an error when read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)


_VRP = "instance_name STRING, num_customers INT, vehicle_capacity BIGINT, coordinates ARRAY<ARRAY<DOUBLE>>, demands ARRAY<BIGINT>, depot INT, arc_costs ARRAY<ARRAY<DOUBLE>>"


def vrp_json(instances: DataFrame, origin: str, benchmark: str, metadata: list[str]) -> DataFrame:
    """(name, value): each instance as one JSON document with a 0-based depot; the columns in metadata go below its key metadata."""
    xy = F.transform("coordinates", lambda c: F.array(c["x"], c["y"]))
    head = [F.col("name").alias("instance_name"), F.lit(origin).alias("instance_origin"), F.lit(benchmark).alias("benchmark_name"), (F.col("dimension") - 1).alias("num_customers"), F.col("capacity").alias("vehicle_capacity")]
    body = [xy.alias("coordinates"), "demands", (F.col("depot") - 1).alias("depot"), F.col("costs").alias("arc_costs"), F.struct(F.lit("CVRP").alias("problem_type"), *metadata).alias("metadata")]
    return instances.select("name", F.to_json(F.struct(*head, *body)).alias("value"))


def read_vrp_json(texts: DataFrame) -> DataFrame:
    """Instances (name, dimension, capacity, depot from 1, costs, coordinates, demands) of documents as vrp_json writes them, with problem."""
    j = texts.select(F.from_json("value", _VRP).alias("v")).select("v.*")
    n = F.col("num_customers") + 1
    xy = F.transform("coordinates", lambda c: F.struct(F.get(c, 0).alias("x"), F.get(c, 1).alias("y")))
    problem = (
        F.when(F.col("instance_name").isNull() | F.col("num_customers").isNull() | F.col("vehicle_capacity").isNull(), "no name, size or capacity")
        .when(F.coalesce(F.size("demands"), F.lit(-1)) != n, "demands of another size")
        .when(F.coalesce(F.size("coordinates"), F.lit(-1)) != n, "coordinates of another size")
        .when((F.coalesce(F.size("arc_costs"), F.lit(-1)) != n) | F.exists("arc_costs", lambda r: F.size(r) != n), "costs of another size")
    )
    return j.select(F.col("instance_name").alias("name"), n.alias("dimension"), F.col("vehicle_capacity").alias("capacity"), (F.col("depot") + 1).alias("depot"), F.col("arc_costs").alias("costs"), xy.alias("coordinates"), "demands", problem.alias("problem"))


def size_problem(demands: Column, capacity: Column) -> Column:
    """What keeps an instance from being a real one: one vehicle is enough, or a customer's demand is above the capacity; else null. demands begin with the depot's."""
    rest = F.slice(demands, F.lit(2), F.greatest(F.size(demands) - 1, F.lit(0)))
    vehicles = F.ceil(F.aggregate(demands, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0))) / capacity)
    return F.when(capacity.isNull() | (capacity <= 0), "no capacity").when(vehicles < 2, "one vehicle is enough").when(F.coalesce(F.array_max(rest), F.lit(0)) > capacity, "a demand above the capacity")


def routes_by_ids(routes: DataFrame, nodes: DataFrame, depot_id: int = 1) -> DataFrame:
    """routes (instance_id, run_id, route_idx, route) with the routes in the ids of nodes (instance_id, node_id), and problem.

    Routes of a run may be given as places 0..n-1 among the ascending ids, or as ids. They are places if the run's stops are all
    places but the depot's, or are places and not all ids of customers; else ids if all are; else problem says so and the route is
    null. Null stops are left out. An instance without its depot is a problem too.
    """
    ids = nodes.where("node_id IS NOT NULL").groupBy("instance_id").agg(F.array_sort(F.collect_set(F.col("node_id").cast("long"))).alias("_ids"))
    stops = routes.select("instance_id", "run_id", F.explode("route").alias("s")).where("s IS NOT NULL").groupBy("instance_id", "run_id").agg(F.array_sort(F.collect_set(F.col("s").cast("long"))).alias("_stops"))
    j = routes.join(ids, "instance_id", "left").join(stops, ["instance_id", "run_id"], "left")
    depot = F.array_position("_ids", F.lit(depot_id).cast("long")) - 1
    places = F.array_sort(F.filter(F.transform("_ids", lambda _, k: k.cast("long")), lambda k: k != depot))
    customers = F.filter("_ids", lambda x: x != depot_id)
    inside = lambda of: F.size(F.array_except("_stops", of)) == 0
    is_place = (F.col("_stops") == places) | (inside(places) & ~inside(customers))
    clean = F.transform(F.filter("route", lambda x: x.isNotNull()), lambda x: x.cast("long"))
    route = F.when(F.coalesce(F.size("_stops"), F.lit(0)) <= 0, clean).when(is_place, F.transform(clean, lambda x: F.get("_ids", x.cast("int")))).when(inside(customers), clean)
    problem = F.when(F.col("_ids").isNull() | (F.coalesce(depot, F.lit(-1)) < 0), "no depot").when(route.isNull(), "unknown node")
    return j.select("instance_id", "run_id", "route_idx", F.when(problem.isNull(), route).alias("route"), problem.alias("problem"))


def node_ids(nodes: DataFrame, vertices: DataFrame, built: dict[str, bool], wanted: dict[str, bool]) -> DataFrame:
    """nodes (city, instance_base, i, vertex) with osm_id and problem; vertices: city, vertex, node_id of the graph that numbered them.

    The numbers only mean the same on a graph built with the same options: other ones raise ValueError. A number that the graph does not
    have is a problem.
    """
    if built != wanted:
        raise ValueError(f"vertices numbered on a graph with {built}, not {wanted}")
    j = nodes.join(vertices.select("city", "vertex", F.col("node_id").alias("osm_id")), ["city", "vertex"], "left")
    return j.withColumn("problem", F.when(F.col("osm_id").isNull(), "no such vertex"))


def annotated(texts: DataFrame, section: str, key: str, value: str, before: str | None = None) -> DataFrame:
    """JSON documents (..., value) with the key set in one of their objects, unless it is there; placed before another key, else last. changed says where."""

    def run(frames):
        for f in frames:
            out, changed = [], []
            for text in f["value"]:
                doc = None if text is None else json.loads(text)
                part = doc.get(section) if isinstance(doc, dict) else None
                new = isinstance(part, dict) and key not in part
                if new:
                    items = list(part.items())
                    at = next((k for k, (name, _) in enumerate(items) if name == before), len(items))
                    doc[section] = dict([*items[:at], (key, value), *items[at:]])
                out.append(json.dumps(doc, ensure_ascii=False, separators=(",", ":")) if new else text)
                changed.append(new)
            yield f.assign(value=out, changed=changed)

    schema = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes) + ", changed boolean"
    return texts.mapInPandas(run, schema)


def export_bridge(spark: SparkSession, out: str, graphs: DataFrame, speeds: dict[tuple[str, str], Callable[[], DataFrame]], nodes: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Write traffic sidecars below out and give their manifests (city, value), written too.

    graphs: as graph_json; speeds: for each (model, intensity) a function that gives profiles as speeds_json wants them; nodes: as
    nodes_json. Each kind is a folder with a folder per city. Speeds that are there already are kept and not computed, unless force.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path
    there = lambda p: at(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(at(f"{p}/_SUCCESS"))
    named = lambda df: df.withColumnRenamed("city", "name")
    write_texts(named(graph_json(graphs)), f"{out}/graph")
    done = []
    for (model, intensity), profiles in speeds.items():
        name = f"speeds-{model}-{intensity}"
        if there(f"{out}/{name}") and not force:
            done.append(f"{name} (kept)")
            continue
        write_texts(named(speeds_json(profiles()).select("city", "value")), f"{out}/{name}")
        done.append(name)
    lists = F.array().cast("array<string>")
    made = graphs.select("city", F.size("vertices").alias("num_vertices"), F.size("edges").alias("num_edges"))
    if nodes is not None:
        write_texts(nodes_json(nodes).select(F.concat_ws("-", "city", "instance_base").alias("name"), "value"), f"{out}/nodes")
        made = made.join(nodes.groupBy("city").agg(F.array_sort(F.collect_set(F.concat(F.lit("nodes-"), "instance_base"))).alias("_n")), "city", "left")
    files = F.coalesce("_n", lists) if nodes is not None else lists
    head = F.struct(F.lit(VERSION).alias("schema_version"), "city", "num_vertices", "num_edges", F.array(*map(F.lit, done)).cast("array<string>").alias("speed_files"), files.alias("node_files"))
    manifest = made.select("city", F.to_json(head).alias("value"))
    write_texts(named(manifest), f"{out}/manifest")
    return manifest
