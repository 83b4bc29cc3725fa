"""Customers and demands drawn by counter-based numbers: the same for a seed on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions import geo
from waymesh.functions.scalars import DEMAND_BANDS, ROUTE_SIZE_BANDS, capacity_for, uniform, whole_between
from waymesh.operators.graph import numbered_by


def first_n(df: DataFrame, by: list[str], order: list[Column | str], n: Column | int) -> DataFrame:
    """The first n rows of each group, numbered in place from 1."""
    size = n if isinstance(n, Column) else F.lit(n)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= size)


def random_customers(candidates: DataFrame, n: int, seed: int) -> DataFrame:
    """(city, node_id, place, source_tag): n distinct candidates (city, node_id) per city, all if there are fewer."""
    return first_n(candidates.select("city", "node_id").distinct(), ["city"], [uniform(seed, "random", F.col("node_id")), "node_id"], n).withColumn("source_tag", F.lit("param"))


def seed_points(candidates: DataFrame, n_seeds: int, seed: int) -> DataFrame:
    """The cluster seeds of each city: city, node_id, lat, lon."""
    return first_n(candidates, ["city"], [uniform(seed, "seeds", F.col("node_id")), "node_id"], n_seeds).select("city", "node_id", "lat", "lon")


def cluster_weights(candidates: DataFrame, seeds: DataFrame, decay_m: float) -> DataFrame:
    """(city, node_id, weight): the sum over the city's seeds of 2 ** (-distance / decay_m)."""
    s = seeds.select("city", F.col("lat").alias("sy"), F.col("lon").alias("sx"))
    w = F.pow(F.lit(2.0), -geo.haversine(F.col("lat"), F.col("lon"), F.col("sy"), F.col("sx")) / decay_m)
    return candidates.join(s, "city").groupBy("city", "node_id").agg(F.sum(w).alias("weight"))


def clustered_customers(candidates: DataFrame, n: int, n_seeds: int, decay_m: float, seed: int) -> DataFrame:
    """(city, node_id, place, source_tag): the seeds and then candidates drawn without repeats in proportion to their weight.

    Drawing by the least exponential key -ln(u) / weight equals accepting in proportion to the weight, in one sort.
    """
    seeds = seed_points(candidates, n_seeds, seed)
    first = seeds.select("city", "node_id", F.lit(True).alias("is_seed"))
    weights = cluster_weights(candidates, seeds, decay_m).join(first, ["city", "node_id"], "left")
    key = -F.log(uniform(seed, "cluster", F.col("node_id"))) / F.greatest(F.col("weight"), F.lit(1e-300))
    return first_n(weights, ["city"], [F.coalesce("is_seed", F.lit(False)).desc(), F.round(key, 9), "node_id"], n).select("city", "node_id", "place", F.lit("param").alias("source_tag"))


def random_clustered_customers(candidates: DataFrame, n: int, n_seeds: int, decay_m: float, seed: int) -> DataFrame:
    """Half of them random, the rest clustered among what is left; in mixed order."""
    part = random_customers(candidates, n // 2, seed)
    rest = candidates.join(part, ["city", "node_id"], "left_anti")
    both = part.unionByName(clustered_customers(rest, n - n // 2, n_seeds, decay_m, seed)).drop("place")
    return first_n(both, ["city"], [uniform(seed, "mix", F.col("node_id")), "node_id"], n)


def poi_customers(snapped: DataFrame, n: int, seed: int) -> DataFrame:
    """(city, node_id, point_id, place, source_tag): points snapped to vertices in random order, the first of each vertex, n of them."""
    key = F.struct(uniform(seed, "poi", F.col("point_id")).alias("k"), "point_id")
    one = snapped.groupBy("city", "node_id").agg(F.min(key).alias("b")).select("city", "node_id", "b.k", "b.point_id")
    return first_n(one, ["city"], ["k", "point_id"], n).drop("k").withColumn("source_tag", F.lit("poi"))


def hybrid_customers(snapped: DataFrame, candidates: DataFrame, n: int, share: float, seed: int) -> DataFrame:
    """round(n * share) customers from points, the rest random, filled up with further vertices tagged param_fill."""
    n_poi = round(n * share)
    poi = poi_customers(snapped, n_poi, seed).select("city", "node_id", F.lit(0).alias("prio"), "place", "source_tag")
    drawn = random_customers(candidates, n, seed + 1).select("city", "node_id", F.when(F.col("place") <= n - n_poi, 1).otherwise(2).alias("prio"), "place", F.when(F.col("place") <= n - n_poi, "param").otherwise("param_fill").alias("source_tag"))
    best = poi.unionByName(drawn).groupBy("city", "node_id").agg(F.min(F.struct("prio", "place", "source_tag")).alias("b"))
    return first_n(best.select("city", "node_id", "b.prio", F.col("b.place").alias("old"), "b.source_tag"), ["city"], ["prio", "old", "node_id"], n).select("city", "node_id", "place", "source_tag")


def source_counts(customers: DataFrame) -> DataFrame:
    """(city, n_poi, n_param): customers by whether a point of interest gave them (source_tag poi)."""
    poi = F.col("source_tag") == "poi"
    return customers.groupBy("city").agg(F.count_if(poi).alias("n_poi"), F.count_if(~F.coalesce(poi, F.lit(False))).alias("n_param"))


def required(customers: DataFrame, n: int) -> DataFrame:
    """The customers (city, ...) as they are; a city that has fewer than n of them is an error when its rows are computed."""
    have = F.count(F.lit(1)).over(Window.partitionBy("city"))
    short = F.raise_error(F.concat(F.lit(f"fewer than {n} customers: "), F.col("city").cast("string")))
    return customers.withColumn("city", F.when(have < n, short.cast(customers.schema["city"].dataType)).otherwise(F.col("city")))


def route_size(seed: int, key: Column, band: int) -> Column:
    """The target number of customers per route, uniform in its band."""
    lo, hi = ROUTE_SIZE_BANDS[band]
    return lo + uniform(seed, "route_size", key) * (hi - lo)


def demands(customers: DataFrame, kind: int, band: int, seed: int) -> DataFrame:
    """customers (city, i from 1, lat, lon) with demand and route_size.

    Kinds: 1 unit; 2 to 5 uniform in a band; 6 large (51..100) in the quadrants south-west and north-east of the mean, else 1..50;
    7 a few bulky (50..100), about 1.5 * n / route_size of them, in random order, the rest 1..10. Kinds 6 and 7 leave out customers
    without city.
    """
    key = (F.col("city"), F.col("i"))
    u = uniform(seed, f"demand{kind}", *key)
    sized = customers.withColumn("route_size", route_size(seed, F.col("city"), band))
    if kind == 6:
        mean = customers.groupBy("city").agg(F.avg("lat").alias("_y"), F.avg("lon").alias("_x"))
        south, west = F.col("lat") < F.col("_y"), F.col("lon") < F.col("_x")
        d = F.when(south == west, whole_between(51, 100, u)).otherwise(whole_between(1, 50, u))
        return sized.join(mean, "city").withColumn("demand", d).drop("_y", "_x")
    if kind == 7:
        many = customers.groupBy("city").agg(F.count(F.lit(1)).alias("_n"))
        ranked = numbered_by(sized.withColumn("_u", uniform(seed, "bulky", *key)), "city", ["_u", "i"], start=1, name="_rank").join(many, "city")
        d = F.when(F.col("_rank") < F.col("_n") / F.col("route_size") * 1.5, whole_between(50, 100, u)).otherwise(whole_between(1, 10, u))
        return ranked.withColumn("demand", d).drop("_u", "_rank", "_n")
    return sized.withColumn("demand", whole_between(*DEMAND_BANDS[kind], u))


def fleet(with_demand: DataFrame) -> DataFrame:
    """(city, n, total, most, capacity, routes): capacity of the vehicles and the least number of routes of each instance."""
    agg = with_demand.groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.sum("demand").alias("total"), F.max("demand").alias("most"), F.first("route_size").alias("r"))
    sized = agg.withColumn("capacity", capacity_for(F.col("r"), F.col("total"), F.col("most"), F.col("n")))
    return sized.select("city", "n", "total", "most", "capacity", F.when(F.col("capacity") > 0, F.ceil(F.col("total") / F.col("capacity"))).alias("routes"))
