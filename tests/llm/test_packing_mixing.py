"""Bucket boundaries, containers, permutations and shares."""

import random
from collections import Counter, defaultdict
from functools import cache
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.llm import mixing, packing, tokens


@pytest.mark.parametrize("seed", range(12))
def test_optimal_buckets(seed):
    r = random.Random(seed)
    u = sorted(r.sample(range(1, 60), r.randint(1, 14)))
    n = [r.randint(1, 50) for _ in u]
    k = r.randint(1, 6)

    @cache
    def least(j, b):
        if j == 0:
            return 0
        return min((least(i, b - 1) + sum((u[j - 1] - u[x]) * n[x] for x in range(i, j)) for i in range(j)), default=0) if b else float("inf")

    pads = lambda i, j: sum((u[j - 1] - u[x]) * n[x] for x in range(i, j))
    bounds = packing.optimal_buckets(np.array(u), np.array(n), k, pads).tolist()
    assert len(bounds) <= k and bounds == sorted(set(bounds)) and bounds[-1] == u[-1]
    assert sum((min(b for b in bounds if b >= x) - x) * c for x, c in zip(u, n)) == least(len(u), k)


@pytest.mark.parametrize("seed", range(6))
def test_fill_containers(seed):
    r = random.Random(seed)
    sizes = np.array([min(100, 1 + int(r.expovariate(1 / r.choice([5, 30])))) for _ in range(r.choice([1, 40, 3000]))])
    u, n = np.unique(sizes, return_counts=True)
    bounds = packing.least_padding(u, n, 100, 9)
    b, c, s = packing.fill_containers(sizes, bounds, 100)
    used = np.bincount(c, sizes)
    assert used.max() <= 100 and (used > 0).all() and len(set(zip(c, s))) == len(sizes)
    assert len(set(zip(c, b))) == len(used) and (sizes <= bounds[b]).all() and ((b == 0) | (sizes > bounds[b - 1])).all()
    assert all(sorted(s[c == k]) == list(range((c == k).sum())) for k in range(min(50, len(used))))
    if len(sizes) == 3000:
        assert used.sum() / (100 * len(used)) > 0.98


def test_pack(spark):
    r = random.Random(1)
    rows = [(i, None if i % 50 == 0 else 0 if i % 49 == 0 else 7 if i % 3 else r.randint(1, 260), "x") for i in range(2000)] + [(5, 7, "x"), (None, 9, "x")]
    got = packing.pack(spark.createDataFrame(rows, "item_id long, n_tokens int, slot string"), 100, 20, 300).collect()
    whole, used, spots = defaultdict(list), Counter(), Counter()
    for x in got:
        whole[x.item_id, x.piece].append((x.token_start, x.n_tokens))
        used[x.container_id] += x.n_tokens
        spots[x.container_id, x.slot] += 1
    assert all(x.container_id is None or used[x.container_id] == x.used_tokens <= 100 for x in got)
    assert all(n == 1 for (c, _), n in spots.items() if c is not None)
    want = Counter()
    for i, n, _ in rows:
        if n is not None:
            want.update([(i, p, 100 * p, min(100, n - 100 * p)) for p in range(max(1, -(-n // 100)))])
    assert Counter((x.item_id, x.piece, x.token_start, x.n_tokens) for x in got) == want
    assert {x.n_tokens for x in got if x.container_id is None} == {0}
    assert packing.pack(spark.createDataFrame([], "item_id long, n_tokens int"), 10).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_least_padding_over_all_cuts(seed):
    """No other choice of bounds leaves less space unused when its buckets are batched."""
    r = random.Random(seed)
    u = np.array(sorted(r.sample(range(1, 41), 7)))
    n = np.array([r.randint(1, 9) for _ in u])
    unused = lambda i, j: sum(k for k, _ in packing.batches(u[i:j], n[i:j], 40)) * 40 - int((u[i:j] * n[i:j]).sum())
    bounds = packing.least_padding(u, n, 40, 3)
    at = [0, *(np.searchsorted(u, bounds, "right"))]
    least = min(sum(unused(a, z) for a, z in zip((0, *c), (*c, 7))) for k in range(3) for c in combinations(range(1, 7), k))
    assert sum(unused(a, z) for a, z in zip(at, at[1:])) == least


def test_batches_take_all_items_once():
    r = random.Random(3)
    u = np.array(sorted(r.sample(range(1, 513), 200)))
    n = np.array([r.randint(1, 500) for _ in u])
    got = np.zeros(200, int)
    for alike, batch in packing.batches(u, n, 512):
        assert alike > 0 and sum(u[i] * k for i, k in batch) <= 512
        for i, k in batch:
            got[i] += alike * k
    assert (got == n).all()


def test_report_and_kinds(spark):
    df = spark.createDataFrame([(i, 1 + i % 90) for i in range(3000)], "item_id long, n_tokens int")
    packed = packing.pack_kinds(df, [("a", 50), ("b", 1000)], 4, 800).cache()
    report = packing.fill_report(packed).orderBy("bin_kind").collect()
    total = sum(1 + i % 90 for i in range(3000))
    assert [(x.bin_kind, x.tokens) for x in report] == [("a", total), ("b", total)] and all(x.used_share > 0.9 and x.padding == x.n_containers * x.capacity_tokens - total for x in report)
    assert packed.where("container_id IS NOT NULL").groupBy("bin_kind", "container_id").agg(F.countDistinct("bucket").alias("k")).where("k > 1").count() == 0
    assert packing.pack_kinds(df, []).collect() == []
    with pytest.raises(ValueError):
        packing.pack_kinds(df, [("a", 0)])


def test_tokens(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b  c" * 20000, 0)], "i int, text string, n_tokens int").select("i", "text")
    got = {r.i: r.n_tokens for r in tokens.with_token_count(df, "text", ["i"]).collect()}
    assert got[1] is None and got[2] == 0 and got[3] == len(tokens.encoder()("a b  c" * 20000))


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_permuted(spark, size):
    df = spark.range(size).select(*(mixing.permuted(F.col("id"), F.lit(size), F.lit(s)).alias(f"p{s}") for s in (1, 2)))
    a, b = ([r[i] for r in df.collect()] for i in (0, 1))
    assert sorted(a) == sorted(b) == list(range(size)) and (size < 1000 or (a != b and a != sorted(a)))


def test_draw_counts():
    n = mixing.draw_counts([1000, 10, 0, 333], 7, 3)
    assert n.sum(axis=0).tolist() == [1000, 10, 0, 333] and np.ptp(n.sum(axis=1)) <= 1


def items(spark, n=3000, seed=2):
    r = random.Random(seed)
    rows = [(r.choice(["big", "big", "big", "mid", "Small "]) if i % 40 else r.choice([None, "other"]), i, r.choice([None, 0, r.randint(1, 90), 3000])) for i in range(n)]
    df = spark.createDataFrame(rows, "source string, item_id long, n_tokens int")
    return rows, df.select(mixing.proper_source(F.col("source")).alias("source"), "item_id", "n_tokens")


GOALS = [("big", 0.5, 1), ("mid", 0.2, 2), ("small", 0.2, 4), ("absent", 0.1, 3), (None, 0.5, 1)]


@pytest.mark.parametrize("total", [None, 30_000_000])
def test_mix(spark, total):
    rows, df = items(spark)
    goals = spark.createDataFrame(GOALS, "source string, target_share double, max_repeats int")
    drawn = mixing.mix(df, goals, total, block_tokens=200, shard_blocks=50).cache()
    size = {i: n for _, i, n in rows}
    name = {i: (s or "").strip().lower() for s, i, _ in rows}
    most = {s: m for s, _, m in GOALS}
    cover = defaultdict(list)
    for x in drawn.collect():
        assert name[x.item_id] == x.source and 0 <= x.token_start and x.token_start + x.n_tokens <= size[x.item_id] and x.pass_no < most[x.source]
        cover[x.item_id, x.pass_no].append((x.token_start, x.token_start + x.n_tokens))
    for parts in cover.values():
        parts.sort()
        assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))
    slots = Counter((x.slot, x.source) for x in drawn.collect() for _ in [0])
    assert max(slots.values()) <= 200
    got = {x.source: x for x in mixing.shares(drawn, goals).collect()}
    assert got["absent"].drawn_tokens == 0 and sum(x.actual_share for x in got.values()) == pytest.approx(1, abs=1e-5)
    if total is None:
        assert all(got[s].actual_share == pytest.approx(p / 0.9, rel=0.03) for s, p, _ in GOALS[:3])
    else:
        have = {s: sum(n or 0 for q, _, n in rows if (q or "").strip().lower() == s) for s in ("big", "mid", "small")}
        assert all(got[s].drawn_tokens == have[s] * m for s, _, m in GOALS[:3])
    drawn.unpersist()


def test_mix_of_nothing(spark):
    goals = spark.createDataFrame(GOALS[:2], "source string, target_share double, max_repeats int")
    none = spark.createDataFrame([], "source string, item_id long, n_tokens int")
    assert mixing.mix(none, goals).collect() == []
    assert [x.actual_share for x in mixing.shares(mixing.mix(none, goals), goals).collect()] == [None, None]


def test_plan_divides_the_rest():
    plan = mixing.plan_sources([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1), ("d", 0.0, 1)], {"a": (1000, 10), "b": (10000, 100), "c": (10000, 100)}, 100, 10_000)
    assert [p.drawn for p in plan] == [10, 54, 36, 0]
