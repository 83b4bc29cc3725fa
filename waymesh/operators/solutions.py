"""Recorded solutions: once per run, edges, pairs, loads and comparison of runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymesh.functions.arrays import neighbours
from waymesh.operators.nested import open_list

COUNTS = ("c_n", "r_n", "edges_added", "edges_removed", "pairs_added", "pairs_removed")


def runs_once(rows: DataFrame) -> DataFrame:
    """One row per run_id: the earliest recorded, then by cost and routes. Rows without run_id are left out."""
    keep = ["created_at", "instance_id", "cost", "objective_function", "routes", F.col("validation.valid").alias("valid"), F.col("metadata.metric").alias("metric")]
    one = rows.where("run_id IS NOT NULL").groupBy("run_id").agg(F.min(F.struct(*keep)).alias("r"))
    return one.select("run_id", "r.*")


def customer_routes(runs: DataFrame) -> DataFrame:
    """(run_id, instance_id, route_idx, route): the routes without depot and null entries; routes without customers drop out."""
    opened = runs.select("run_id", "instance_id", F.posexplode("routes").alias("route_idx", "r"))
    return opened.select("run_id", "instance_id", "route_idx", F.filter("r", lambda x: x != 0).alias("route")).where(F.size("route") > 0)


def route_edges(routes: DataFrame, depot: int = 0) -> DataFrame:
    """Distinct directed (run_id, a, b) over all routes, the depot's legs included."""
    full = F.concat(F.array(F.lit(depot)), "route", F.array(F.lit(depot)))
    return routes.select("run_id", F.explode(neighbours(full, "a", "b")).alias("e")).select("run_id", "e.a", "e.b").distinct()


def _stops(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, route, node) of the customers in a column of routes, in their order; routes are numbered over the whole column."""
    row, _, routes = open_list(column)
    route, _, node = open_list(routes)
    route, there = route.to_numpy(), pc.fill_null(pc.not_equal(node, 0), False).to_numpy(zero_copy_only=False)
    return row.to_numpy()[route][there], route[there], node.filter(pa.array(there)).to_numpy().astype(np.int64)


def _per_row(row: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weight, n).astype(np.int64)


def _choose_two(n: np.ndarray) -> np.ndarray:
    return n * (n - 1) // 2


def _edge_keys(row: np.ndarray, route: np.ndarray, code: np.ndarray, k: int) -> np.ndarray:
    """The distinct edges as sorted numbers (row * k + a) * k + b; the depot's code is 0."""
    turn = np.flatnonzero(np.diff(route))
    first, last = np.append(0, turn + 1)[: len(route)], np.append(turn, len(route) - 1)[: len(route)]
    before = np.roll(code, 1)
    before[first] = 0
    return np.unique(np.concatenate([(row * k + before) * k + code, (row[last] * k + code[last]) * k]))


def _listed_pairs(sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, n: int, limit: int) -> list[np.ndarray]:
    """Distinct pairs of both sides and those they share, by row, by listing: about limit pairs, or those of one lower customer, at a time.

    sides: distinct row, route, code, sorted by route and code.
    """
    lower = [row * k + code for row, _, code in sides]
    after = [np.searchsorted(route, route, "right") - np.arange(len(route)) - 1 for _, route, _ in sides]
    of = np.unique(np.concatenate(lower), return_inverse=True)[1]
    part = (np.cumsum(np.bincount(of, np.concatenate(after))) // limit).astype(np.int64)[of]
    parts, out = np.split(part, [len(lower[0])]), [np.zeros(n, np.int64) for _ in range(3)]
    order = [np.argsort(p, kind="stable") for p in parts]
    sorted_ = [p[by] for p, by in zip(parts, order)]
    for p in np.unique(part):
        keys = []
        for (_, _, code), low, many, by, mine in zip(sides, lower, after, order, sorted_):
            at = by[slice(*np.searchsorted(mine, (p, p + 1)))]
            have = many[at]
            upper = np.repeat(at + 1 - (np.cumsum(have) - have), have) + np.arange(have.sum())
            keys.append(np.unique(np.repeat(low[at], have) * k + code[upper]))
        for total, found in zip(out, (*keys, np.intersect1d(*keys, assume_unique=True))):
            total += _per_row(found // k // k, n)
    return out


def _pair_counts(sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, n: int, limit: int) -> list[np.ndarray]:
    """Distinct pairs of customers who share a route, of both sides and in common, by row.

    Where nobody is in two routes of a run, the sizes of the routes and of what two routes have in common tell them; else they are listed.
    """
    listed, members = np.zeros(n, bool), []
    for row, route, code in sides:
        at = np.unique(route * k + code, return_index=True)[1]
        row, route, code = row[at], route[at], code[at]
        seen, times = np.unique(row * k + code, return_counts=True)
        listed[seen[times > 1] // k] = True
        members.append((row, route, code))
    out, keys = [], []
    for row, route, code in members:
        plain = ~listed[row]
        of, at, size = np.unique(route[plain], return_index=True, return_counts=True)
        out.append(_per_row(row[plain][at], n, _choose_two(size)))
        keys.append(((row * k + code)[plain], route[plain]))
    shared, c, r = np.intersect1d(keys[0][0], keys[1][0], assume_unique=True, return_indices=True)
    _, at, size = np.unique(keys[0][1][c] * (keys[1][1].max(initial=0) + 1) + keys[1][1][r], return_index=True, return_counts=True)
    out.append(_per_row(shared[at] // k, n, _choose_two(size)))
    if listed.any():
        more = _listed_pairs([tuple(x[listed[row]] for x in (row, route, code)) for row, route, code in members], k, n, limit)
        out = [a + b for a, b in zip(out, more)]
    return out


def change_counts(candidate: pa.ListArray, reference: pa.ListArray, limit: int = 1_000_000) -> list[np.ndarray]:
    """COUNTS by row for two columns of routes: routes with customers of each, and what the candidate adds and removes."""
    n, sides = len(candidate), [_stops(x) for x in (candidate, reference)]
    nodes = np.unique(np.concatenate([node for _, _, node in sides]))
    k, coded = len(nodes) + 1, [(row, route, np.searchsorted(nodes, node) + 1) for row, route, node in sides]
    routes = []
    for row, route, _ in coded:
        routes.append(_per_row(row[np.unique(route, return_index=True)[1]], n))
    keys = [_edge_keys(*x, k) for x in coded]
    c, r, both = (_per_row(x // k // k, n) for x in (*keys, np.intersect1d(*keys, assume_unique=True)))
    mine, theirs, shared = _pair_counts(coded, k, n, limit)
    return [*routes, c - both, r - both, mine - shared, theirs - shared]


def _change_kernel(limit: int = 1_000_000):
    """Arrow kernel: rows with c_routes and r_routes to the other columns and COUNTS. About limit stops, or one row, at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            load = np.ones(b.num_rows, np.int64)
            for side in ("c_routes", "r_routes"):
                row, _, routes = open_list(b[side])
                load += _per_row(row.to_numpy(), b.num_rows, pc.fill_null(pc.list_value_length(routes), 0).to_numpy())
            cuts = np.flatnonzero(np.diff((np.cumsum(load) - load) // limit, prepend=-1))
            for start, end in zip(cuts, np.append(cuts[1:], b.num_rows)):
                part = b.slice(start, end - start)
                counts = change_counts(part["c_routes"], part["r_routes"], limit)
                kept = part.select([x for x in part.schema.names if x not in ("c_routes", "r_routes")])
                yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, counts)], [*kept.schema.names, *COUNTS])

    return run


def best_references(runs: DataFrame) -> DataFrame:
    """(candidate, reference): each valid run against the best one of its instance, objective and metric (cost, then run_id)."""
    keys = ["instance_id", "objective_function", "metric"]
    valid = runs.where("valid AND cost IS NOT NULL")
    best = valid.groupBy(*keys).agg(F.min_by("run_id", F.struct("cost", "run_id")).alias("reference"))
    same = [valid[k].eqNullSafe(best[k]) for k in keys]
    return valid.join(best, same).select(F.col("run_id").alias("candidate"), "reference").where("candidate <> reference")


def compared(runs: DataFrame, versus: DataFrame, most: int = 2_000) -> DataFrame:
    """Candidate against reference: cost delta and gap in percent (null if the reference costs 0), routes, edge and pair changes, ordering.

    Pairs of runs with different objectives or metrics, or without a cost, are left out. Ordering is by cost, for
    HierarchicalVehicleCost by number of routes and then cost. Runs are joined as whole rows and their routes are compared inside the
    batch, so neither edges nor pairs are ever rows. A reference is copied once for about every most candidates, which spreads them.
    """
    side = lambda p: runs.select(*(F.col(x).alias(p + x) for x in ("run_id", "cost", "objective_function", "metric", "routes")))
    copies = 1 + F.floor(F.count(F.lit(1)).over(Window.partitionBy("reference")) / most)
    spread = versus.select("candidate", "reference", F.pmod(F.xxhash64("candidate"), copies).alias("copy"))
    c = spread.join(side("c_"), F.col("candidate") == F.col("c_run_id"))
    r = spread.select(F.col("reference").alias("r_reference"), F.col("copy").alias("r_copy")).distinct().join(side("r_"), F.col("r_reference") == F.col("r_run_id"))
    both = c.join(r, (F.col("reference") == F.col("r_reference")) & (F.col("copy") == F.col("r_copy")))
    both = both.where("c_cost IS NOT NULL AND r_cost IS NOT NULL AND c_objective_function <=> r_objective_function AND c_metric <=> r_metric")
    both = both.select("candidate", "reference", "c_cost", "r_cost", "c_objective_function", "c_routes", "r_routes")
    kind = T.StructType([*both.drop("c_routes", "r_routes").schema.fields, *(T.StructField(x, T.LongType()) for x in COUNTS)])
    found = both.mapInArrow(_change_kernel(), kind)
    fleet_first = F.col("c_objective_function").eqNullSafe("HierarchicalVehicleCost")
    lead = F.when(fleet_first, F.col("c_n") - F.col("r_n")).otherwise(0)
    delta = F.col("c_cost") - F.col("r_cost")
    order = F.when((lead < 0) | ((lead == 0) & (delta < 0)), "better").when((lead == 0) & (delta == 0), "equal").otherwise("worse")
    gap = F.when(F.col("r_cost") != 0, F.round(100 * delta / F.abs("r_cost"), 6))
    return found.select("candidate", "reference", F.round(delta, 6).alias("cost_delta"), gap.alias("gap_percent"), (F.col("c_n") - F.col("r_n")).alias("routes_delta"), order.alias("ordering"), *COUNTS[2:])


def loads(routes: DataFrame, demand: DataFrame) -> DataFrame:
    """(run_id, route_idx, load, stops) of each route; demand: instance_id, node, demand. Stops without demand count 0."""
    stops = routes.select("run_id", "instance_id", "route_idx", F.explode("route").alias("node"))
    return stops.join(demand, ["instance_id", "node"], "left").groupBy("run_id", "route_idx").agg(F.sum(F.coalesce("demand", F.lit(0))).alias("load"), F.count(F.lit(1)).alias("stops"))


def route_sizes(routes: DataFrame) -> DataFrame:
    """(run_id, n_routes, most, least): routes of each run, and customers of its largest and smallest route."""
    n = F.size("route")
    return routes.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_routes"), F.max(n).alias("most"), F.min(n).alias("least"))


def record_runs(runs: DataFrame, path: str) -> None:
    """Append runs to a store partitioned by objective."""
    runs.write.mode("append").partitionBy("objective_function").parquet(path)


def recent(runs: DataFrame, n: int = 50, **equal: str) -> DataFrame:
    """The latest runs, at most n (between 1 and 200), of those whose columns equal the given values."""
    for k, v in equal.items():
        runs = runs.where(F.col(k) == v)
    return runs.orderBy(F.desc_nulls_last("created_at"), "run_id").limit(min(max(n, 1), 200))
