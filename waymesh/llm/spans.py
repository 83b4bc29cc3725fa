"""Long exact spans shared between records: suffix trees partitioned by prefix.

Only suffixes that can start a span of the least length L matter. Each window of L characters names, by its content alone, one
k-character prefix inside it (the one with the least hash), so equal windows name equal prefixes at equal places. A named
prefix with the windows that name it, at most L - k + 1 of them, is an anchor; its body is the text those windows cover.

1. Prefixes. Anchors are grouped by their prefix; those whose prefix occurs in one record only end here. The hash of the
   prefix does nothing but partition and filter: equal prefixes have equal hashes, so nothing is lost.
2. Leaves. Bodies of the remaining anchors are grouped by their characters: a distinct body with the least and the greatest
   doc_id that has it. A boilerplate text in a third of all records is one leaf, combined before the shuffle.
3. Subtrees. The bodies under one prefix are one subtree, built in memory from two suffix arrays with their common-prefix
   lengths, one of what follows the anchor and one, turned, of what precedes it. A run whose common prefix reaches L is an
   internal node of that depth; if its leaves come from two records, its suffixes are shared. A subtree with more bodies than
   memory should hold is split by longer prefixes, halving the windows in question each time, until it fits or the
   prefix is L long and the subtree is one node. Every character that counts as shared has been compared.
4. Each leaf's shared stretches go back to the anchors that have its body.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.session import broadcast_if_small, cut

#: Characters hashed at a time (at most 2**24); distinct bodies of a subtree that is built in memory.
CHUNK_CHARS, SUBTREE = 1_000_000, 20_000
#: A key with this part of all rows or more is hot (there are at most so many of them); salts that spread the rows of a hot key.
HOT_KEYS, SALTS = 1_000, 64

_BASE, _ADD = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD1B54A32D192ED03)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _of_code() -> np.ndarray:
    """The scrambled number of every code point."""
    return _mix(np.arange(0x110000, dtype=np.uint64) + _ADD)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    size = 1 << max(10, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[size] = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, inverse))
    return _POWERS[size]


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by doubling."""
    span, cur = 1, v
    while span * 2 <= w:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    n = len(v) - w + 1
    return np.minimum(cur[:n], cur[w - span : w - span + n])


def anchors_of(codes: np.ndarray, text_of: np.ndarray, least: int, k: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, place of the prefix, its hash) of the anchors of texts laid end to end.

    codes: code points; text_of: the number of each one's text. Windows never cross from one text into another.
    """
    n = len(codes)
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    if n < least:
        return none
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_of_code()[codes] * up[:n], out=total[1:])
    prefix = total[k:] - total[:-k]
    prefix *= down[: n - k + 1]
    prefix = _mix(prefix)
    place = np.uint64(0xFFFFFF)
    ranked = prefix & ~place
    ranked |= np.arange(len(prefix), dtype=np.uint64)
    chosen = (sliding_least(ranked, least - k + 1) & place).astype(np.int64)
    at = np.flatnonzero(text_of[: n - least + 1] == text_of[least - 1 :])
    if not len(at):
        return none
    pick = chosen[at]
    new = np.r_[True, (pick[1:] != pick[:-1]) | (at[1:] != at[:-1] + 1)]
    return at[new], at[np.r_[new[1:], True]], pick[new], prefix[pick[new]]


ANCHOR = "doc_id long, s int, wins int, at int, prefix long"


def _anchor_kernel(least: int, k: int):
    """Arrow kernel: (doc_id, text) to anchors: first window s, windows after it, place of the prefix from s, its hash."""

    def emit(parts: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        ids, offset = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
        sizes = np.array([len(p[2]) for p in parts])
        start = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(parts)), sizes)
        first, last, place, prefix = anchors_of(np.concatenate([p[2] for p in parts]), owner, least, k)
        of = owner[first]
        cols = [ids[of], (first + offset[of] - start[of]).astype(np.int32), (last - first).astype(np.int32), (place - first).astype(np.int32), prefix.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "s", "wins", "at", "prefix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, held = [], 0
            for i in range(b.num_rows):
                codes = np.frombuffer(b["text"][i].as_py().encode("utf-32-le", "surrogatepass"), np.uint32)
                doc = b["doc_id"][i].as_py()
                for o in range(0, max(1, len(codes) - least + 1), CHUNK_CHARS):
                    part = codes[o : o + CHUNK_CHARS + least - 1]
                    if held and held + len(part) > CHUNK_CHARS + least:
                        yield emit(parts)
                        parts, held = [], 0
                    parts.append((doc, o, part))
                    held += len(part)
            if parts:
                yield emit(parts)

    return run


def _body_kernel(least: int):
    """Arrow kernel: (doc_id, text, anchors) to (prefix, doc_id, s, at, body), the text that each anchor's windows cover.

    An anchor that does not lie in the text (a second text under its doc_id) gives none.
    """
    names, kinds = ["prefix", "doc_id", "s", "at", "body"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

        for b in batches:
            out, size = [[] for _ in names], 0
            for i in range(b.num_rows):
                text, doc = b["text"][i].as_py(), b["doc_id"][i].as_py()
                for a in b["anchors"][i].as_py():
                    s, end = a["s"], a["s"] + a["wins"] + least
                    if end > len(text):
                        continue
                    for col, v in zip(out, (a["prefix"], doc, s, a["at"], text[s:end])):
                        col.append(v)
                    size += end - s
                    if size > 8_000_000:
                        yield batch(out)
                        out, size = [[] for _ in names], 0
            yield batch(out)

    return run


def suffix_array(group: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the texts sorted inside their groups, and how many characters each shares with the one before it.

    The first text of a group shares -1. Vectorised comparison of neighbours; no character is taken on trust.
    """
    n = len(texts)
    g = group.tolist()
    order = np.array(sorted(range(n), key=lambda m: (g[m], texts[m])), np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(size) - size
    common = np.full(n, -1, np.int64)
    width = int(size.max(initial=0))
    step = max(1, 4_000_000 // max(1, width))
    for lo in range(1, n, step):
        a, b = order[lo - 1 : min(n, lo + step) - 1], order[lo : lo + step]
        most = np.minimum(size[a], size[b])
        w = int(most.max(initial=0))
        if w:
            at = np.arange(w)
            last = len(codes) - 1
            equal = (codes[np.minimum(begin[a][:, None] + at, last)] == codes[np.minimum(begin[b][:, None] + at, last)]) & (at < most[:, None])
            same = np.where(equal.all(axis=1), w, equal.argmin(axis=1))
        else:
            same = np.zeros(len(a), np.int64)
        common[lo : lo + step] = np.where(group[a] == group[b], same, -1)
    return order, common


def deep_nodes(group: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, least_doc: np.ndarray, most_doc: np.ndarray, bodies: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, start, end) of the stretches of bodies under internal nodes of depth least or more with leaves of two records.

    Leaves of one group share the prefix that starts at their place at. Of each leaf the suffixes that start lo..hi characters
    before the prefix are asked about. least_doc and most_doc: the least and greatest record that has the body.
    """
    n = len(bodies)
    after, afters = suffix_array(group, [b[p:] for b, p in zip(bodies, at.tolist())])
    before, befores = suffix_array(group, [b[:p][::-1] for b, p in zip(bodies, at.tolist())])
    room = np.array([len(b) for b in bodies], np.int64) - at
    leaves, starts = [], []
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for x in range(int(lo.min(initial=0)), int(min(hi.max(initial=0), at.max(initial=0))) + 1):
        some = np.flatnonzero((lo <= x) & (x <= hi) & (at >= x) & (room >= least - x))
        if not len(some):
            continue
        right[after], left[before] = np.cumsum(afters < least - x), np.cumsum(befores < x)
        node = left[some] * (n + 1) + right[some]
        order = np.argsort(node, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(node[order]) != 0])
        shared = np.minimum.reduceat(least_doc[some][order], first) < np.maximum.reduceat(most_doc[some][order], first)
        hit = some[order][np.repeat(shared, np.diff(np.r_[first, len(some)]))]
        leaves.append(hit)
        starts.append(at[hit] - x)
    if not leaves:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    leaf, start = np.concatenate(leaves), np.concatenate(starts)
    order = np.lexsort((start, leaf))
    leaf, start = leaf[order], start[order]
    new = np.r_[True, (leaf[1:] != leaf[:-1]) | (start[1:] != start[:-1] + 1)] if len(leaf) else np.empty(0, bool)
    last = np.r_[new[1:], True] if len(leaf) else new
    return leaf[new], start[new], start[last] + least


FOUND = "prefix long, leaf binary, from int, to int"


def _subtree_kernel(least: int, size: int):
    """Arrow kernel over leaves sorted by node: the shared stretches of each. Whole subtrees are taken together up to size leaves."""
    names = ["node", "prefix", "leaf", "at", "lo", "hi", "a", "z", "body"]

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        node, at, lo, hi, a, z = (t[c].to_numpy() for c in ("node", "at", "lo", "hi", "a", "z"))
        of = np.cumsum(np.r_[True, node[1:] != node[:-1]])
        leaf, start, end = deep_nodes(of, at.astype(np.int64), lo, hi, a, z, t["body"].to_pylist(), least)
        pick = pa.array(leaf)
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t["prefix"].take(pick), t["leaf"].take(pick), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)))], ["prefix", "leaf", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            b = b.select(names)
            if not b.num_rows:
                continue
            node = b["node"].to_numpy()
            cuts = np.flatnonzero(node[1:] != node[:-1]) + 1
            if held and held[-1]["node"][-1].as_py() != node[0]:
                cuts = np.r_[0, cuts]
            done = 0
            for c in cuts.tolist():
                if rows + c - done >= size:
                    if c > done:
                        held.append(b.slice(done, c - done))
                    if held:
                        yield solve(held)
                    held, rows, done = [], 0, c
            held.append(b.slice(done))
            rows += b.num_rows - done
        if held:
            yield solve(held)

    return run


def _hot_join(many: DataFrame, few: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """many joined with few (unique by keys; size: the rows of many that have them), the rows of hot keys spread by a salt, in one pass over many.

    Hot are keys with a HOT_KEYS-th of all rows or more: at most HOT_KEYS, so they are broadcast; their rows of few are repeated for each salt.
    """
    hot = F.broadcast(few.where(F.col(size) * HOT_KEYS >= F.lit(max(total, HOT_KEYS))).select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*many.columns), F.lit(SALTS))).otherwise(F.lit(0).cast("long")).alias("_salt")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    spread = many.join(hot, keys, "left").select(*many.columns, salt)
    return spread.join(few.join(hot, keys, "left").select(*few.columns, F.explode(salts).alias("_salt")), [*keys, "_salt"]).drop("_salt")


def _halves(leaves: DataFrame, least: int) -> DataFrame:
    """The leaves of too large subtrees under longer prefixes: half of the suffixes, the nearer, by what follows the prefix, the others by what precedes it."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    ahead = F.substring("body", F.col("at") + 1, F.lit(least) - mid)
    behind = F.substring("body", F.col("at") - mid, mid + 1 + F.length("body"))
    near = F.when(F.length(ahead) == F.lit(least) - mid, F.struct(F.xxhash64("node", F.lit(0), ahead).alias("node"), "lo", mid.alias("hi")))
    far = F.when(F.col("at") > mid, F.struct(F.xxhash64("node", F.lit(1), F.substring(behind, F.lit(1), mid + 1)).alias("node"), (mid + 1).alias("lo"), "hi"))
    opened = leaves.select("prefix", "leaf", "at", "a", "z", "body", F.explode(F.filter(F.array(near, far), lambda x: x.isNotNull())).alias("n"))
    return opened.select("n.node", "prefix", "leaf", "at", "n.lo", "n.hi", "a", "z", "body")


def shared_stretches(docs: DataFrame, least: int = 200, prefix_chars: int | None = None, subtree: int = SUBTREE) -> DataFrame:
    """(doc_id, start, end), overlapping: stretches of texts that occur identically in the text of another doc_id.

    Positions are code points from 0. Every run of least characters that occurs in another record is inside a stretch, and
    every stretch consists of such runs. Rows without id or text, and texts shorter than least, have none. Rows repeated with
    one doc_id are one record: what only they share does not count. The anchors are computed twice, for the prefixes and for
    the anchors that remain: cheaper than writing all of them.
    """
    k = prefix_chars or max(1, least // 2)
    whole = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= least)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    anchors = whole.mapInArrow(_anchor_kernel(least, k), ANCHOR)
    prefixes = anchors.groupBy("prefix").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count(F.lit(1)).alias("n"))
    alive = cut(prefixes.where("a < z").select("prefix", "n"))
    small = broadcast_if_small(alive, 100_000)
    total = alive.agg(F.sum("n")).first()[0] or 0
    kept = anchors.join(small.select("prefix"), "prefix", "left_semi") if small is not alive else _hot_join(anchors, alive, ["prefix"], "n", total)
    wanted = kept.groupBy("doc_id").agg(F.collect_list(F.struct("prefix", "s", "wins", "at")).alias("anchors"))
    bodies = wanted.join(whole, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_body_kernel(least), "prefix long, doc_id long, s int, at int, body string")
    members = cut(bodies)
    leaves = members.groupBy("prefix", "at", "body").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count(F.lit(1)).alias("n"))
    leaves = cut(leaves.select("prefix", F.unhex(F.sha2(F.concat_ws("|", "at", "body"), 256)).alias("leaf"), "at", "a", "z", "n", "body"))

    todo = leaves.select(F.col("prefix").alias("node"), "prefix", "leaf", "at", F.lit(0).alias("lo"), F.lit(least - k).alias("hi"), "a", "z", "body")
    found, nodes = None, leaves.groupBy(F.col("prefix").alias("node")).agg(F.min("a").alias("least"), F.max("z").alias("most"), F.count(F.lit(1)).alias("k"))
    while True:
        large = cut(nodes.where(F.col("k") > subtree).select("node"))
        split = not large.isEmpty()
        fits = nodes.where((F.col("k") <= subtree) & (F.col("least") < F.col("most"))).select("node")
        fitting = todo.join(fits, "node", "left_semi")
        part = fitting.repartition("node").sortWithinPartitions("node").mapInArrow(_subtree_kernel(least, subtree), FOUND)
        found = part if found is None else found.unionByName(part)
        if not split:
            break
        big = todo.join(large, "node", "left_semi")
        single = big.where("lo = hi AND at >= lo").withColumn("gram", F.substring("body", F.col("at") - F.col("lo") + 1, F.lit(least))).where(F.length("gram") == least)
        deep = single.groupBy("node", "gram").agg(F.min("a").alias("least"), F.max("z").alias("most")).where("least < most").select("node", "gram")
        shared = single.join(deep, ["node", "gram"], "left_semi").select("prefix", "leaf", (F.col("at") - F.col("lo")).alias("from"), (F.col("at") - F.col("lo") + least).alias("to"))
        found = found.unionByName(shared)
        todo = cut(_halves(big.where("lo < hi"), least))
        nodes = todo.groupBy("node").agg(F.min("a").alias("least"), F.max("z").alias("most"), F.count(F.lit(1)).alias("k"))

    per = found.groupBy("prefix", "leaf").agg(F.collect_set(F.struct("from", "to")).alias("stretches"))
    known = cut(leaves.select("prefix", "leaf", "n").join(per, ["prefix", "leaf"]))
    mine = members.select("prefix", "doc_id", "s", F.unhex(F.sha2(F.concat_ws("|", "at", "body"), 256)).alias("leaf"))
    back = _hot_join(mine, known, ["prefix", "leaf"], "n", total)
    opened = back.select("doc_id", "s", F.explode("stretches").alias("x"))
    return opened.select("doc_id", (F.col("s") + F.col("x.from")).alias("start"), (F.col("s") + F.col("x.to")).alias("end"))


def merged_spans(stretches: DataFrame) -> DataFrame:
    """(doc_id, span_start, span_len): overlapping and touching stretches of a record as one."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    ahead = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = stretches.distinct().withColumn("_new", F.when(F.col("start") <= ahead, 0).otherwise(1)).withColumn("_span", F.sum("_new").over(w))
    found = opened.groupBy("doc_id", "_span").agg(F.min("start").alias("a"), F.max("end").alias("z"))
    return found.select("doc_id", F.col("a").cast("long").alias("span_start"), (F.col("z") - F.col("a")).cast("long").alias("span_len"))


def share_of_records(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every record: its characters, how many of them are shared elsewhere, in how many spans, and the share (null if empty)."""
    per = spans.groupBy("doc_id").agg(F.sum("span_len").alias("shared_chars"), F.count(F.lit(1)).alias("n_spans"))
    sizes = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    joined = sizes.join(per, "doc_id", "left").na.fill(0, ["shared_chars", "n_spans"])
    return joined.select("doc_id", "chars", "shared_chars", "n_spans", F.when(F.col("chars") > 0, F.round(F.col("shared_chars") / F.col("chars"), 6)).alias("share"))
