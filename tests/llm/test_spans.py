"""Shared spans against brute force over all windows."""

import random
from collections import defaultdict

import numpy as np
import pytest

from waymesh.llm import spans


def brute(docs, least):
    where = defaultdict(set)
    for d, text in docs:
        for i in range(len(text or "") - least + 1):
            where[text[i : i + least]].add(d)
    out = []
    for d, text in docs:
        end = start = None
        for i in range(len(text or "") - least + 1):
            if len(where[text[i : i + least]]) > 1:
                if end is None or i > end:
                    if end is not None:
                        out.append((d, start, end - start))
                    start = i
                end = i + least
        if end is not None:
            out.append((d, start, end - start))
    return sorted(set(out))


def corpus(seed, n):
    r = random.Random(seed)
    letters = "ab é😀" if seed % 2 else "abcdefgh \n"
    word = lambda k: "".join(r.choice(letters) for _ in range(k))
    pool = [word(r.randint(15, 90)) for _ in range(12)]
    common = "every record has this phrase in it " * 2
    docs = []
    for d in range(n):
        parts = [r.choice([word(r.randint(1, 30)), r.choice(pool), r.choice(pool)[r.randint(0, 9) :], "-" * r.randint(1, 60), "ab" * r.randint(1, 40)]) for _ in range(r.randint(0, 6))]
        if d % 3 == 0:
            parts.insert(r.randint(0, len(parts)), common)
        docs.append((d, "".join(parts)))
    docs += [(n, None), (n + 1, ""), (n + 2, docs[0][1]), (n + 3, "x" * 19), (n + 4, "q" * 400), (n + 5, "q" * 20)]
    return docs


@pytest.mark.parametrize("seed, subtree, chunk", [(0, 2000, 1_000_000), (1, 2000, 150), (2, 3, 1_000_000), (3, 1, 77)])
def test_spans_equal_brute_force(spark, monkeypatch, seed, subtree, chunk):
    monkeypatch.setattr(spans, "CHUNK_CHARS", chunk)
    docs = corpus(seed, 60)
    df = spark.createDataFrame([(d, t, 0) for d, t in docs] + [(None, docs[3][1], 0)], "doc_id long, text string, s int").repartition(3)
    found = spans.merged_spans(spans.shared_stretches(df, 20, subtree=subtree))
    assert sorted(tuple(x) for x in found.collect()) == brute(docs, 20)
    share = {x.doc_id: x for x in spans.share_of_records(df, found).collect()}
    assert len(share) == len(docs) and share[len(docs) - 6].share is None and share[len(docs) - 1].share == 1.0


def test_spans_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spans.merged_spans(spans.shared_stretches(none, 20)).collect() == []


def test_one_record_given_twice(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 5), (1, "abcdefghij" * 5)], "doc_id long, text string")
    assert spans.shared_stretches(df, 20).collect() == []


@pytest.mark.parametrize("w", [1, 2, 5, 8, 13])
def test_sliding_least(w):
    v = np.random.default_rng(w).integers(0, 99, 40).astype(np.uint64)
    assert spans.sliding_least(v, w).tolist() == [min(v[i : i + w]) for i in range(41 - w)]


@pytest.mark.parametrize("subtree, small", [(20_000, True), (50, False)])
def test_header_in_a_third_of_the_records(spark, monkeypatch, subtree, small):
    if not small:
        monkeypatch.setattr(spans, "broadcast_if_small", lambda df, n: df)
    r = random.Random(5)
    word = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    header, phrase = word(60), word(25)
    docs = [(d, (header if d % 3 == 0 else "") + word(r.randint(0, 30)) + (phrase + word(r.randint(0, 9)) if d % 2 else "")) for d in range(900)]
    found = spans.merged_spans(spans.shared_stretches(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), 20, subtree=subtree))
    assert sorted(tuple(x) for x in found.collect()) == brute(docs, 20)


def test_two_texts_under_one_id(spark):
    a, b = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    docs = spark.createDataFrame([(1, a), (1, b * 4), (2, a + b)], "doc_id long, text string")
    found = {(x.doc_id, x.start, x.end) for x in spans.shared_stretches(docs, 20).collect()}
    assert {(2, 0, 26), (1, 0, 26)} <= {(d, s, e) for d, s, e in ((x.doc_id, x.span_start, x.span_start + x.span_len) for x in spans.merged_spans(spans.shared_stretches(docs, 20)).collect())} and found


def test_suffix_array():
    group = np.array([1, 1, 1, 2, 2])
    texts = ["abc", "ab", "abd", "abc", "x😀"]
    order, common = spans.suffix_array(group, texts)
    assert order.tolist() == [1, 0, 2, 3, 4] and common.tolist() == [-1, 2, 2, -1, 0]
    assert [len(x) for x in spans.suffix_array(np.empty(0, np.int64), [])] == [0, 0]


def test_hot_join(spark):
    many = spark.createDataFrame([(1, i) for i in range(600)] + [(k, k) for k in range(2, 2000)], "k long, v long")
    few = many.groupBy("k").count().where("k % 2 = 1")
    got = spans._hot_join(many, few, ["k"], "count", many.count())
    assert sorted(map(tuple, got.select("k", "v").collect())) == sorted((k, v) for k, v in map(tuple, many.collect()) if k % 2)
