"""Pair counts against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from waymesh.llm import cooccur


def brute(baskets):
    pairs, items = Counter(), Counter()
    for b in baskets:
        s = sorted(set(b))
        items.update(s)
        pairs.update(combinations(s, 2))
    return pairs, items


@pytest.mark.parametrize("chunk", [3, 50, 2_000_000])
@pytest.mark.parametrize("seed", range(4))
def test_count_block(monkeypatch, seed, chunk):
    monkeypatch.setattr(cooccur, "CHUNK", chunk)
    r = random.Random(seed)
    baskets = [sorted({int(r.expovariate(0.05 if seed % 2 else 0.3)) for _ in range(r.randint(1, 12))}) for _ in range(r.choice([1, 70, 400]))]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in baskets])])
    names, seen, a, b, n = cooccur.count_block(offsets, np.array([x for s in baskets for x in s], np.int32))
    pairs, items = brute(baskets)
    assert dict(zip(names.tolist(), seen.tolist())) == items
    assert {(x, y): c for x, y, c in zip(a.tolist(), b.tolist(), n.tolist())} == pairs


def test_pair_counts_with_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "BLOCK", 100)
    r = random.Random(9)
    rows = [("hot" if i % 3 else f"g{i % 17}", i, [r.choice([0, 1, 2, r.randint(3, 90), None]) for _ in range(r.randint(0, 7))], "x") for i in range(1500)]
    rows += [(None, 1, [1, 2], "x"), ("g1", -1, None, "x"), ("g1", -2, [], "x"), ("g1", -3, [None], "x")]
    got = cooccur.pair_counts(spark.createDataFrame(rows, "group_id string, basket_id long, items array<int>, n string"))
    want = Counter()
    for g, _, items, _ in rows:
        s = sorted({x for x in items or [] if x is not None})
        if g is None or not s:
            continue
        want.update([(g, None, None), *((g, x, None) for x in s), *((g, *p) for p in combinations(s, 2))])
    assert {(x.group_id, x.a, x.b): x.n for x in got.collect()} == want
    few = {(x.group_id, x.a, x.b): x.n for x in cooccur.pair_counts(spark.createDataFrame(rows, "group_id string, basket_id long, items array<int>, n string"), 3).collect()}
    assert {k: n for k, n in few.items() if k[2] is None or n >= 3} == {k: n for k, n in want.items() if k[2] is None or n >= 3} and len(few) < len(want)
    lifted = {(x.group_id, x.a, x.b) for x in cooccur.lifted_pairs(got, 2, 1.5).collect()}
    assert lifted == {k for k, n in want.items() if k[2] is not None and n >= 2 and n * want[(k[0], None, None)] >= 1.5 * want[(k[0], k[1], None)] * want[(k[0], k[2], None)]}


def test_pair_counts_of_nothing(spark):
    none = spark.createDataFrame([], "group_id string, basket_id long, items array<int>")
    assert cooccur.lifted_pairs(cooccur.pair_counts(none), 1, 0.0).collect() == []


@pytest.mark.parametrize("work", [1, 30, 400])
def test_blocks_end_by_their_pairs(spark, monkeypatch, work):
    monkeypatch.setattr(cooccur, "WORK", work)
    monkeypatch.setattr(cooccur, "CHUNK", 20)
    r = random.Random(work)
    rows = [(f"g{i % 5}", i, r.sample(range(60), r.choice([1, 2, 5, 30]))) for i in range(120)]
    got = cooccur.pair_counts(spark.createDataFrame(rows, "group_id string, basket_id long, items array<int>"), 2)
    want = Counter()
    for g, _, items in rows:
        s = sorted(items)
        want.update([(g, None, None), *((g, x, None) for x in s), *((g, *p) for p in combinations(s, 2))])
    found = {(x.group_id, x.a, x.b): x.n for x in got.collect()}
    assert all(found[k] == n for k, n in want.items() if k[2] is None or n >= 2) and all(want[k] == n for k, n in found.items())


def test_memory_of_wide_baskets():
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(1)
    items = pa.array([r.choice(20_000, 200, replace=False).astype(np.int32) for _ in range(4000)], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(["g"] * 4000), items], ["group_id", "items"])
    tracemalloc.start()
    pairs = sum(int(pa.compute.sum(b["n"].filter(b["b"].is_valid())).as_py()) for b in cooccur._block_kernel(1)(iter([batch])))
    assert pairs == 4000 * 200 * 199 // 2 and tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


def test_lift_is_exact(spark):
    rows = [("g", None, None, 3), ("g", 1, None, 1), ("g", 2, None, 1), ("g", 1, 2, 1)]
    counts = spark.createDataFrame(rows, "group_id string, a int, b int, n long")
    for limit, hit in ((3.0, 1), (3, 1), (3.004, 0), (2.999999999, 1), (3.000000001, 0)):
        assert cooccur.lifted_pairs(counts, 1, limit).count() == hit
    with pytest.raises(ValueError):
        cooccur.lifted_pairs(counts, 1, 1 / 3)
