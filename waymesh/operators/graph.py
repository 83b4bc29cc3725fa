"""Strong components and shortest paths on many graphs at once.

A graph of bounded size is solved by kernels in numpy, sources in batches. A city's sources are dealt to at most as many tasks
as a shuffle has partitions, each with one copy of the city's edges, so the edges are copied as often as tasks run beside each
other and no more. A graph beyond the bound is solved by joins in rounds, with a reliable checkpoint between them. Both follow one
rule between equal paths: the fewest edges, then at every vertex, from the target backwards, the smaller predecessor. Nothing
grows with the data on the driver or in a broadcast: the cities beyond the bound are marked by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.arrays import neighbours
from waymesh.session import cut, shuffle_partitions

#: Edges of a graph that one task may hold; sources times vertices that a kernel works on at a time.
MAX_EDGES, CELLS = 5_000_000, 1_000_000
#: Pivots after which a graph of many components is left to the sequential search.
PIVOTS = 64


@dataclass
class Net:
    """A graph as arrays: ascending ids; the edges of vertex k are start[k]..start[k+1]-1, with head and weight; edge says which row each was."""

    ids: np.ndarray
    start: np.ndarray
    tail: np.ndarray
    head: np.ndarray
    weight: np.ndarray
    edge: np.ndarray

    @staticmethod
    def of(u: np.ndarray, v: np.ndarray, weight: np.ndarray, *more: np.ndarray, turned: bool = False) -> Net:
        ids = np.unique(np.concatenate([u, v, *more]).astype(np.int64))
        a, b = np.searchsorted(ids, u), np.searchsorted(ids, v)
        a, b = (b, a) if turned else (a, b)
        order = np.lexsort((b, a))
        return Net(ids, np.searchsorted(a[order], np.arange(len(ids) + 1)), a[order], b[order], weight[order].astype(float), order)

    def opened(self, vertices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in vertices, edge) of all edges of the vertices."""
        first, many = self.start[vertices], self.start[vertices + 1] - self.start[vertices]
        place = np.repeat(np.arange(len(vertices)), many)
        return place, np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + first[place]


@dataclass
class Trees:
    """Shortest path trees of some sources: cost (inf if unreachable), number of edges (-1) and last edge (-1), by source and vertex."""

    cost: np.ndarray
    hops: np.ndarray
    via: np.ndarray


def trees(net: Net, sources: np.ndarray) -> Trees:
    """Trees from the sources (places in net.ids), all at once: costs by correcting labels, then breadth-first over the edges that fit them."""
    n, m = len(net.ids), len(sources)
    root = np.arange(m) * n + sources
    cost = np.full(m * n, np.inf)
    cost[root] = 0.0
    front = root
    while len(front):
        place, e = net.opened(front % n)
        at = front[place]
        there, new = at - at % n + net.head[e], cost[at] + net.weight[e]
        better = new < cost[there]
        there, new = there[better], new[better]
        np.minimum.at(cost, there, new)
        front = np.unique(there)
    hops, via = np.full(m * n, -1), np.full(m * n, -1)
    hops[root] = 0
    front, step = root, 0
    while len(front):
        step += 1
        place, e = net.opened(front % n)
        at = front[place]
        there = at - at % n + net.head[e]
        fits = (hops[there] < 0) & (cost[at] + net.weight[e] == cost[there])
        there, e = there[fits], e[fits]
        order = np.lexsort((net.tail[e], there))
        there, first = np.unique(there[order], return_index=True)
        hops[there], via[there] = step, e[order][first]
        front = there
    return Trees(cost.reshape(m, n), hops.reshape(m, n), via.reshape(m, n))


def batches(net: Net, sources: np.ndarray) -> Iterator[tuple[np.ndarray, Trees]]:
    """Distinct sources (places, ascending) in batches of bounded memory, with their trees."""
    step = max(1, CELLS // max(1, len(net.ids)))
    for s in range(0, len(sources), step):
        yield sources[s : s + step], trees(net, sources[s : s + step])


def walked(net: Net, t: Trees, row: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, edges) of the paths from the source of each row to the target, in order, all end to end; unreachable ones are empty."""
    size = np.maximum(t.hops[row, target], 0)
    offset = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(offset[-1], np.int64)
    left, at, place = np.flatnonzero(size), target[size > 0], offset[1:][size > 0] - 1
    while len(left):
        e = t.via[row[left], at]
        out[place] = e
        at, place = net.tail[e], place - 1
        go = place >= offset[left]
        left, at, place = left[go], at[go], place[go]
    return offset, out


def largest_component_of(n: int, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The vertices, ascending, of the largest strong component; of equals the one with the least vertex.

    The component of the busiest vertex left is cut off by forward and backward reach until no rest can hold a better one; vertices
    without edges in or out of the rest are components of their own. After PIVOTS rounds the rest goes to the sequential search.
    """
    if not n:
        return np.empty(0, np.int64)
    alive, best = np.ones(n, bool), np.empty(0, np.int64)

    def better(found: np.ndarray) -> np.ndarray:
        return found if (len(found), -found[0]) > (len(best), -best[0] if len(best) else -n) else best

    def reach(pivot: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        order = np.argsort(a, kind="stable")
        net = Net(np.arange(n), np.searchsorted(a[order], np.arange(n + 1)), a[order], b[order], np.zeros(0), order)
        seen = np.zeros(n, bool)
        seen[pivot], front = True, np.array([pivot])
        while len(front):
            front = np.unique(net.head[net.opened(front)[1]])
            front = front[~seen[front]]
            seen[front] = True
        return seen

    for _ in range(PIVOTS):
        while True:  # vertices no cycle goes through
            lone = alive & ((np.bincount(tail, minlength=n) == 0) | (np.bincount(head, minlength=n) == 0))
            if not lone.any():
                break
            best = better(np.flatnonzero(lone)[:1])
            alive &= ~lone
            keep = alive[tail] & alive[head]
            tail, head = tail[keep], head[keep]
        rest = np.flatnonzero(alive)
        if len(rest) < max(1, len(best)):
            return best
        degree = np.bincount(np.concatenate([tail, head]), minlength=n)
        pivot = int(np.argmax(np.where(alive, degree, -1)))
        both = reach(pivot, tail, head) & reach(pivot, head, tail) & alive
        best = better(np.flatnonzero(both))
        alive &= ~both
        keep = alive[tail] & alive[head]
        tail, head = tail[keep], head[keep]
    comp = components(n, tail, head)
    comp = np.where(alive, comp, -1)
    some = np.flatnonzero(alive)
    if len(some):
        labels, first, size = np.unique(comp[some], return_index=True, return_counts=True)
        top = np.lexsort((first, -size))[0]
        best = better(some[comp[some] == labels[top]])
    return best


def components(n: int, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The strong component of each of n vertices, by the path-based method with explicit stacks."""
    order = np.argsort(tail, kind="stable")
    start, to = np.searchsorted(tail[order], np.arange(n + 1)).tolist(), head[order].tolist()
    comp, number = [-1] * n, [-1] * n
    count = found = 0
    open_, bounds = [], []
    for root in range(n):
        if number[root] >= 0:
            continue
        walk = [(root, start[root])]
        number[root] = count
        count += 1
        open_.append(root)
        bounds.append(root)
        while walk:
            v, e = walk[-1]
            if e < start[v + 1]:
                walk[-1] = (v, e + 1)
                w = to[e]
                if number[w] < 0:
                    number[w] = count
                    count += 1
                    open_.append(w)
                    bounds.append(w)
                    walk.append((w, start[w]))
                elif comp[w] < 0:
                    while number[bounds[-1]] > number[w]:
                        bounds.pop()
            else:
                walk.pop()
                if bounds[-1] == v:
                    bounds.pop()
                    while True:
                        w = open_.pop()
                        comp[w] = found
                        if w == v:
                            break
                    found += 1
    return np.asarray(comp, np.int64)


def _largest(key, edges):
    u, v = (edges[c].to_numpy() for c in "uv")
    ids, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    best = largest_component_of(len(ids), code[: len(u)], code[len(u) :])
    city = pa.array([key[0].as_py()], edges.schema.field("city").type).take(pa.array(np.zeros(len(best), np.int64)))
    return pa.table({"city": city, "node_id": pa.array(ids[best], pa.int64())})


def sized(edges: DataFrame, max_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """(edges of the graphs of at most max_edges rows, those of the others): None if there are no others. One row per city is counted and joined."""
    size = edges.groupBy("city").agg(F.count(F.lit(1)).alias("_m"))
    large = cut(size.where(F.col("_m") > max_edges).select("city"))
    if large.isEmpty():
        return edges, None
    return edges.join(large, "city", "left_anti"), edges.join(large, "city", "left_semi")


def largest_component(edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(city, node_id) of each graph's largest strong component; of equals the one with the least node.

    edges: city, u, v. Graphs of at most max_edges distinct edges are solved whole in a task each, larger ones by rounds of
    joins. Null cities and ends are ignored.
    """
    slim = edges.select("city", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).dropna().distinct()
    small, large = sized(slim, max_edges)
    out = small.groupBy("city").applyInArrow(_largest, f"city {slim.schema['city'].dataType.simpleString()}, node_id long")
    return out if large is None else out.unionByName(component_by_rounds(large))


def _reach(edges: DataFrame, seeds: DataFrame, tail: str, head: str) -> DataFrame:
    """Everything reachable from seeds (city, node_id), by frontier rounds."""
    seen = frontier = seeds
    while True:
        moves = edges.select("city", F.col(tail).alias("node_id"), F.col(head).alias("_next"))
        step = frontier.join(moves, ["city", "node_id"]).select("city", F.col("_next").alias("node_id")).distinct()
        frontier = cut(step.join(seen, ["city", "node_id"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))


def component_by_rounds(edges: DataFrame) -> DataFrame:
    """largest_component by forward and backward reach: the component of the busiest vertex of each graph is cut off, until
    no rest can hold a larger one."""
    schema_edges, best = cut(edges.select("city", "u", "v").distinct()), None
    rest = schema_edges
    left = cut(rest.select("city", F.explode(F.array("u", "v")).alias("node_id")).distinct())
    while not left.isEmpty():
        degree = left.join(rest.select("city", F.explode(F.array("u", "v")).alias("node_id")), ["city", "node_id"], "left").groupBy("city", "node_id").agg(F.count(F.lit(1)).alias("d"))
        pivot = cut(degree.groupBy("city").agg(F.max_by("node_id", F.struct("d", -F.col("node_id"))).alias("node_id")))
        both = cut(_reach(rest, pivot, "u", "v").join(_reach(rest, pivot, "v", "u"), ["city", "node_id"], "left_semi"))
        found = both.groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("least"))
        marked = both.join(found, "city").select("city", "node_id", "n", "least")
        if best is not None:
            marked = best.unionByName(marked)
            top = marked.groupBy("city").agg(F.min(F.struct(-F.col("n"), "least")).alias("t"))
            marked = marked.join(top, "city").where((-F.col("n") == F.col("t.col1")) & (F.col("least") == F.col("t.least"))).select("city", "node_id", "n", "least")
        best = cut(marked)
        left = left.join(both, ["city", "node_id"], "left_anti")
        more = left.groupBy("city").agg(F.count(F.lit(1)).alias("k")).join(best.select("city", "n").distinct(), "city").where(F.col("k") >= F.col("n")).select("city")
        left = cut(left.join(more, "city", "left_semi"))
        ends = lambda c: left.select(F.col("city"), F.col("node_id").alias(c))
        rest = cut(rest.join(ends("u"), ["city", "u"], "left_semi").join(ends("v"), ["city", "v"], "left_semi"))
    return best.select("city", "node_id") if best is not None else left


def _routes(with_paths: bool):
    def run(key, edges: pa.Table, pairs: pa.Table) -> pa.Table:
        source, target = (pairs[c].to_numpy() for c in ("source", "target"))
        net = Net.of(edges["u"].to_numpy(), edges["v"].to_numpy(), edges["weight"].to_numpy(), source, target)
        s, t = np.searchsorted(net.ids, source), np.searchsorted(net.ids, target)
        order = np.argsort(s, kind="stable")
        s, t = s[order], t[order]
        costs, paths = [], []
        for some, found in batches(net, np.unique(s)):
            mine = slice(np.searchsorted(s, some[0]), np.searchsorted(s, some[-1], "right"))
            row, goal = np.searchsorted(some, s[mine]), t[mine]
            costs.append(found.cost[row, goal])
            if with_paths:
                offset, e = walked(net, found, row, goal)
                there = np.isfinite(costs[-1])
                size = np.diff(offset)
                begin = np.concatenate([[0], np.cumsum(np.where(there, size + 1, 0))])
                ids = np.empty(begin[-1], np.int64)
                ids[begin[:-1][there]] = net.ids[some[row[there]]]
                ids[np.arange(len(e)) - np.repeat(offset[:-1] - begin[:-1], size) + 1] = net.ids[net.head[e]]
                paths.append(pa.ListArray.from_arrays(pa.array(begin.astype(np.int32), mask=np.r_[~there, False]), pa.array(ids)))
        cost = np.concatenate(costs) if costs else np.empty(0)
        city = pa.array([key[0].as_py()], edges.schema.field("city").type if len(edges) else pairs.schema.field("city").type).take(pa.array(np.zeros(len(s), np.int64)))
        out = {"city": city, "source": pa.array(net.ids[s]), "target": pa.array(net.ids[t]), "cost": pa.array(cost, mask=~np.isfinite(cost))}
        if with_paths:
            out["path"] = pa.concat_arrays(paths) if paths else pa.array([], pa.list_(pa.int64()))
        return pa.table(out)

    return run


def dealt(wanted: DataFrame, edges: DataFrame, by: str, per_task: int) -> tuple[DataFrame, DataFrame]:
    """(wanted with chunk, copies of the edges with chunk): each city's rows dealt by the column, about per_task values of it to a chunk.

    A city has no more chunks than a shuffle has partitions: beyond that a chunk takes more values, so the edges are copied once for
    each task that can run, not once for every so many values.
    """
    most = F.lit(shuffle_partitions(wanted.sparkSession))
    chunks = wanted.groupBy("city").agg(F.least(most, F.ceil(F.countDistinct(by) / per_task)).cast("int").alias("chunks"))
    rows = wanted.join(chunks, "city").withColumn("chunk", F.pmod(F.xxhash64(by), F.col("chunks")).cast("int")).drop("chunks")
    copies = edges.join(chunks, "city").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return rows.toDF(*rows.columns), copies


def shortest_paths(edges: DataFrame, pairs: DataFrame, weight: str, with_paths: bool = False, sources_per_task: int = 64, max_edges: int = MAX_EDGES) -> DataFrame:
    """(city, source, target, cost, path): the least cost of each distinct pair, null if unreachable; path on request.

    edges: city, u, v and the weight (null or negative weights are left out); pairs: city, source, target. Pairs are chunked by
    source (dealt) and every chunk gets its city's edges, in one cogrouped task. Parallel edges count with the lightest. Graphs of more
    than max_edges edges are solved by rounds of joins instead; the result, paths included, is the same.
    """
    light = edges.where(F.col(weight) >= 0).groupBy("city", "u", "v").agg(F.min(weight).cast("double").alias("weight"))
    wanted = pairs.select("city", "source", "target").dropna().distinct()
    kind = f"city {edges.schema['city'].dataType.simpleString()}, source bigint, target bigint, cost double" + (", path array<bigint>" if with_paths else "")
    small, large = sized(light, max_edges)
    if large is None:
        return _solved(small, wanted, with_paths, sources_per_task, kind)
    big = wanted.join(large.select("city").distinct(), "city", "left_semi")
    far = distances_by_rounds(large, big.select("city", "source"), "weight", targets=big, with_paths=with_paths)
    far = big.join(far.withColumnRenamed("node_id", "target"), ["city", "source", "target"], "left").select("city", "source", "target", "cost", *(["path"] if with_paths else []))
    rest = wanted.join(large.select("city").distinct(), "city", "left_anti")
    return _solved(small, rest, with_paths, sources_per_task, kind).unionByName(far)


def _solved(light: DataFrame, wanted: DataFrame, with_paths: bool, per_task: int, kind: str) -> DataFrame:
    rows, copies = dealt(wanted, light, "source", per_task)
    return copies.groupBy("city", "chunk").cogroup(rows.groupBy("city", "chunk")).applyInArrow(_routes(with_paths), kind)


def _steps_before(costs: DataFrame, moves: DataFrame) -> DataFrame:
    """costs (city, source, node_id, cost, hops) with before, the smaller of the predecessors that the rule allows; null at the source."""
    e = moves.select("city", F.col("node_id").alias("_u"), F.col("v").alias("node_id"), "w")
    up = costs.select("city", "source", F.col("node_id").alias("_u"), F.col("cost").alias("_c"), F.col("hops").alias("_h"))
    fits = costs.join(e, ["city", "node_id"]).join(up, ["city", "source", "_u"]).where("_c + w = cost AND _h + 1 = hops")
    found = fits.groupBy("city", "source", "node_id").agg(F.min("_u").alias("before"))
    return costs.join(found, ["city", "source", "node_id"], "left")


def distances_by_rounds(edges: DataFrame, sources: DataFrame, weight: str, max_rounds: int = 100_000, with_paths: bool = False, targets: DataFrame | None = None) -> DataFrame:
    """(city, source, node_id, cost[, path]) from every source (city, source) to all it reaches, for graphs of any size.

    All sources advance together. A round joins only the rows that got better with the edges and writes only those that get better
    now; what is known is the best of all writings, merged every eighth round. With targets (city, source, target) the rows come for
    those only, and a source stops at rows that are no nearer than the farthest of its targets, once it has all of them. Paths are
    read off the final costs afterwards, in as many rounds as the longest has edges.
    """
    key = ["city", "source", "node_id"]
    moves = cut(edges.where(F.col(weight) >= 0).groupBy("city", F.col("u").alias("node_id"), "v").agg(F.min(weight).cast("double").alias("w")))
    front = cut(sources.select("city", F.col("source").cast("long").alias("source")).distinct().select("city", "source", F.col("source").alias("node_id"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops")))
    goals = None if targets is None else cut(targets.select("city", F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("node_id")).distinct())
    least = lambda df: df.groupBy(*key).agg(F.min(F.struct("cost", "hops")).alias("b")).select(*key, "b.cost", "b.hops")
    known = front
    for k in range(1, max_rounds + 1):
        step = front.join(moves, ["city", "node_id"]).select("city", "source", F.col("v").alias("node_id"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + 1).alias("hops"))
        old = least(known).select(*key, F.col("cost").alias("_c"), F.col("hops").alias("_h"))
        news = least(step).join(old, key, "left").where("_c IS NULL OR cost < _c OR (cost = _c AND hops < _h)").drop("_c", "_h")
        if goals is not None and k % 8 == 0:
            reached = goals.join(least(known), key, "left").groupBy("city", "source").agg(F.when(F.count_if(F.col("cost").isNull()) == 0, F.max("cost")).alias("_far"))
            news = news.join(reached, ["city", "source"], "left").where("_far IS NULL OR cost <= _far").drop("_far")
        front = cut(news)
        if front.isEmpty():
            break
        known = known.unionByName(front)
        if k % 8 == 0:
            known = cut(least(known))
    else:
        raise RuntimeError("no fixed point within max_rounds")
    costs = cut(least(known))
    wanted = costs if goals is None else costs.join(goals, key, "left_semi")
    if not with_paths:
        return wanted.select(*key, "cost")
    before = cut(_steps_before(costs, moves).select(*key, "before"))
    walk = wanted.select("city", "source", F.col("node_id").alias("target"), "cost", "node_id", F.array("node_id").alias("path"))
    done = None
    while True:
        there = F.col("node_id") == F.col("source")
        part = walk.where(there).select("city", "source", F.col("target").alias("node_id"), "cost", "path")
        done = part if done is None else done.unionByName(part)
        rest = walk.where(~there).join(before, key)
        walk = cut(rest.select("city", "source", "target", "cost", F.col("before").alias("node_id"), F.concat(F.array("before"), "path").alias("path")))
        if walk.isEmpty():
            return done


def all_pairs(places: DataFrame) -> DataFrame:
    """(city, source, target): ordered pairs of different nodes of one instance; places: city, node_id. By city, never across."""
    a, b = places.select("city", F.col("node_id").alias("source")), places.select("city", F.col("node_id").alias("target"))
    return a.join(b, "city").where("source <> target")


def used_edges(routes: DataFrame) -> DataFrame:
    """Distinct (city, u, v) on any of the paths."""
    return routes.where(F.size("path") > 1).select("city", F.explode(neighbours(F.col("path"), "u", "v")).alias("e")).select("city", "e.u", "e.v").distinct()


def numbered_by(rows: DataFrame, by: str, order: list[Column | str], start: int = 0, name: str = "at") -> DataFrame:
    """rows with name, their number within the group in the order (unique, its first key not null), without sorting a group in one task.

    Rows are range-partitioned by group and order; each task numbers its own, and the count of the group's rows in the ranges before is added: one
    row per range and group is joined.
    """
    spread = cut(rows.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = spread.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(before, F.lit(0)))
    own = F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))
    joined = spread.withColumn("_own", own).join(base.drop("_n"), [by, "_part"])
    return joined.withColumn(name, (F.col("_own") + F.col("_base") + F.lit(start - 1)).cast("int")).drop("_own", "_base", "_part")


def reindexed(edges: DataFrame) -> DataFrame:
    """Edges with u and v replaced by the place of their ids in the city's ascending ids, and kept as osm_u, osm_v."""
    ids = edges.select("city", F.explode(F.array("u", "v")).alias("node_id")).distinct()
    places = numbered_by(ids, "city", ["node_id"])
    a, b = (places.select("city", F.col("node_id").alias(o), F.col("at").alias(n)) for o, n in (("osm_u", "u"), ("osm_v", "v")))
    return edges.withColumnsRenamed({"u": "osm_u", "v": "osm_v"}).join(a, ["city", "osm_u"]).join(b, ["city", "osm_v"])


def missing_places(places: DataFrame, edges: DataFrame) -> DataFrame:
    """Places (city, node_id, ...) that no edge of their city's graph touches."""
    ends = edges.select("city", F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return places.join(ends, ["city", "node_id"], "left_anti")
