"""Kernels and rounds give the same costs, paths and flows, ties included."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.operators import graph, traffic
from waymesh.plans import pipeline


def grid(k, drop=()):
    """A k by k grid of equal edges, both ways, whose ids are shuffled."""
    ids = random.Random(k).sample(range(1000), k * k)
    es = []
    for y in range(k):
        for x in range(k):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < k and y + dy < k:
                    a, b = ids[y * k + x], ids[(y + dy) * k + x + dx]
                    es += [(a, b), (b, a)]
    return ids, [e for i, e in enumerate(es) if i not in drop]


def brute(edges, source):
    """Cost, hops and path of every vertex under the rule, by plain relaxation."""
    best = {source: (0.0, 0)}
    while True:
        new = dict(best)
        for u, v, w in edges:
            if u in best:
                new[v] = min(new.get(v, (np.inf, 0)), (best[u][0] + w, best[u][1] + 1))
        if new == best:
            break
        best = new
    paths = {}
    for t in best:
        path = [t]
        while path[-1] != source:
            v = path[-1]
            path.append(min(u for u, x, w in edges if x == v and u in best and best[u][0] + w == best[v][0] and best[u][1] + 1 == best[v][1]))
        paths[t] = path[::-1]
    return best, paths


@pytest.mark.parametrize("weights", [[1.0], [0.0, 1.0, 2.0]])
def test_paths_of_kernel_and_rounds(spark, weights):
    r = random.Random(len(weights))
    ids, es = grid(5, drop={3, 17})
    rows = [("a", u, v, r.choice(weights)) for u, v in es] + [("b", u, v, r.choice(weights)) for u, v in es]
    edges = spark.createDataFrame(rows, "city string, u long, v long, w double")
    pairs = [(c, s, t) for c in "ab" for s in ids[:6] for t in [*ids, 5000]]
    wanted = spark.createDataFrame(pairs, "city string, source long, target long")
    got = {}
    for limit in (10_000, 0):
        got[limit] = {(x.city, x.source, x.target): (x.cost, x.path) for x in graph.shortest_paths(edges, wanted, "w", with_paths=True, sources_per_task=2, max_edges=limit).collect()}
    assert got[0] == got[10_000]
    for c in "ab":
        mine = [(u, v, w) for d, u, v, w in rows if d == c]
        for s in ids[:6]:
            best, paths = brute(mine, s)
            for t in [*ids, 5000]:
                assert got[0][c, s, t] == ((best[t][0], paths[t]) if t in best else (None, None))


def test_flows_of_kernel_and_joins(spark):
    ids, es = grid(4)
    edges = spark.createDataFrame([("a", u, v, 900.0) for u, v in es], "city string, u long, v long, time double")
    spots = spark.createDataFrame([("a", i) for i in ids], "city string, node_id long")
    day = traffic.trips(spots, spots.limit(5), "light", 3)
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    kernel = rows(traffic.hourly_flows(edges, day, 2))
    assert kernel == rows(traffic.hourly_flows(edges, day, 2, max_edges=0)) and sum(x[4] for x in kernel) > 100


def test_driving_trees_is_driving_paths(spark):
    r = random.Random(4)
    ids, es = grid(4)
    rows = [("a", u, v, r.choice([300.0, 40_000.0, 900.0]), r.randint(1, 8), [r.choice([0.5, 5.0, 20.0]) for _ in range(24)]) for u, v in es]
    edges = spark.createDataFrame(rows, "city string, u long, v long, length_m double, class int, profile array<double>")
    places = spark.createDataFrame([("a", i, v) for i, v in enumerate(ids[:5])], "city string, i int, node_id long")
    pairs = graph.all_pairs(places)
    departures = [0.0, 30_000.0, 86_399.0]
    got = {(x.source, x.target, x.departure): x.arrival for x in traffic.tree_arrivals(pipeline.with_time(edges), pairs, departures, 2).collect()}
    arcs = pipeline.timed_paths(edges.drop("profile"), edges, places)
    want = {(ids[x.i], ids[x.j], x.departure): x.arrival for x in traffic.arrival_after_path(arcs, F.array(*map(F.lit, departures))).collect()}
    assert got.keys() == want.keys() and len(got) == 60 and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)


def test_numbering_without_one_task(spark):
    r = random.Random(2)
    rows = [(r.choice("aaab"), i) for i in r.sample(range(10_000), 500)]
    got = graph.numbered_by(spark.createDataFrame(rows, "city string, x long"), "city", ["x"], start=1)
    want = {(c, x): sum(d == c and y <= x for d, y in rows) for c, x in rows}
    assert {(x.city, x.x): x["at"] for x in got.collect()} == want


def test_a_large_graph_by_the_kernel():
    k = 300
    at = np.arange(k * k)
    right, down = at[at % k < k - 1], at[at < k * (k - 1)]
    tail = np.concatenate([right, right + 1, down, down + k])
    head = np.concatenate([right + 1, right, down + k, down])
    net = graph.Net.of(tail, head, np.full(len(tail), 1.5))
    t = graph.trees(net, np.array([0, k * k - 1]))
    assert t.hops[0].max() == 2 * (k - 1) and np.array_equal(t.cost[0], 1.5 * (at // k + at % k)) and t.cost[1, 0] == 3.0 * (k - 1)
    offset, path = graph.walked(net, t, np.array([0, 1]), np.array([k * k - 1, 0]))
    assert np.diff(offset).tolist() == [2 * (k - 1)] * 2 and net.head[path[-1]] == 0
    assert len(graph.largest_component_of(k * k, tail, head)) == k * k
    chain = np.arange(1000)
    assert graph.largest_component_of(1001, chain, chain + 1).tolist() == [0]
    loops = np.concatenate([chain * 2, chain * 2 + 1]), np.concatenate([chain * 2 + 1, chain * 2])
    assert graph.largest_component_of(2000, *loops).tolist() == [0, 1]
