"""Items that appear together: pair counts per group of baskets and their lift.

Heavy-light decomposition inside memory-sized blocks of baskets of one group. Items in at least 1/64 of a block's baskets are
heavy: a dense bit matrix holds them and their pairs are popcounts of ANDed rows. Pairs of two light items are counted by
hash (sort) of the few pairs their baskets hold. Mixed pairs probe the heavy matrix at the baskets of the light item's list.
The three kinds cover every pair once; blocks add up, so the split into blocks never changes a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.session import cut

#: Baskets of a block, sum of their squared sizes (twice its pairs), and entries of one expansion; they bound memory, not results.
BLOCK, WORK, CHUNK = 65_536, 8_000_000, 2_000_000
PARTIAL = "group_id string, a int, b int, n long"


def _sum_pairs(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)


def count_block(offsets: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(items, their counts, a, b, pair counts) of one block of baskets given as offsets into items, distinct per basket."""
    names, code = np.unique(items, return_inverse=True)
    n, k = len(offsets) - 1, len(names)
    basket = np.repeat(np.arange(n), np.diff(offsets))
    seen = np.bincount(code, minlength=k)
    heavy = np.flatnonzero(seen >= max(4, -(-n // 64)))
    is_heavy = np.zeros(k, bool)
    is_heavy[heavy] = True
    row = np.cumsum(is_heavy) - 1
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    dense = np.zeros((len(heavy), n), bool)
    at = is_heavy[code]
    dense[row[code[at]], basket[at]] = True
    words = np.packbits(np.pad(dense, ((0, 0), (0, -n % 64))), axis=1).view(np.uint64)
    for i in range(len(heavy) - 1):
        both = np.bitwise_count(words[i] & words[i + 1 :]).sum(axis=1, dtype=np.int64)
        hit = np.flatnonzero(both)
        keys.append(heavy[i] * k + heavy[i + 1 + hit])
        counts.append(both[hit])

    light = np.flatnonzero(~at)
    order = light[np.argsort(code[light], kind="stable")]
    if len(heavy) and len(order):  # mixed pairs: the columns of the matrix at each light item's list of baskets
        step = max(1, CHUNK // len(heavy))
        for s in range(0, len(order), step):
            part = order[s : s + step]
            first = np.flatnonzero(np.r_[True, np.diff(code[part]) != 0])
            sums = np.add.reduceat(dense[:, basket[part]].astype(np.int32), first, axis=1)
            h, j = np.nonzero(sums)
            x, y = heavy[h], code[part[first[j]]]
            keys.append(np.minimum(x, y) * k + np.maximum(x, y))
            counts.append(sums[h, j].astype(np.int64))

    size = np.bincount(basket[light], minlength=n)  # light pairs: each light entry with the later ones of its basket
    entry = np.argsort(basket[light] * np.int64(k) + code[light], kind="stable")
    ordered = light[entry]
    ends = np.repeat(np.cumsum(size), size)
    more = ends - np.arange(len(ordered)) - 1
    upto = np.concatenate([[0], np.cumsum(more)])
    lo = 0
    while lo < len(ordered):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + CHUNK, "right")) - 1)
        m = more[lo:hi]
        if m.sum():
            left = np.repeat(np.arange(lo, hi), m)
            right = np.arange(m.sum()) - np.repeat(upto[lo:hi] - upto[lo], m) + left + 1
            key, c = np.unique(code[ordered[left]] * np.int64(k) + code[ordered[right]], return_counts=True)
            keys.append(key)
            counts.append(c)
            if len(keys) > 64:
                key, c = _sum_pairs(keys, counts)
                keys, counts = [key], [c]
        lo = hi
    key, total = _sum_pairs(keys, counts)
    return names, seen, names[key // max(k, 1)], names[key % max(k, 1)], total


def _block_kernel(min_together: int):
    """Rows (group_id, items) of one range of groups, sorted, to partial counts; a null b counts the item a, two nulls baskets.

    Only the first and the last group of a range can go on in another one. Of the groups between, counted in one block, the counts
    are final, so their pairs below min_together end here.
    """

    def rows(group: str, a: pa.Array, b: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.string()).take(pa.array(np.zeros(len(a), np.int64))), a, b, pa.array(n, pa.int64())], ["group_id", "a", "b", "n"])

    def flush(group: str, held: list[pa.ListArray], final: bool) -> pa.RecordBatch:
        lists = pa.concat_arrays(held)
        items = lists.flatten().to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        names, seen, a, b, n = count_block(offsets, items)
        if final and min_together > 1:
            a, b, n = (x[keep] for keep in (n >= min_together,) for x in (a, b, n))
        k = len(names)
        left = pa.concat_arrays([pa.nulls(1, pa.int32()), pa.array(names, pa.int32()), pa.array(a, pa.int32())])
        right = pa.concat_arrays([pa.nulls(1 + k, pa.int32()), pa.array(b, pa.int32())])
        return rows(group, left, right, np.concatenate([[len(lists)], seen, n]))

    def alone(group: str, items: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The counts of one basket with more pairs than a block may hold, in parts."""
        items = np.sort(items)
        n = len(items)
        yield rows(group, pa.concat_arrays([pa.nulls(1, pa.int32()), pa.array(items, pa.int32())]), pa.nulls(1 + n, pa.int32()), np.ones(1 + n, np.int64))
        lo = 0
        while lo < n - 1:
            hi = min(n - 1, lo + max(1, CHUNK // (n - lo)))
            more = np.arange(n - lo - 1, n - hi - 1, -1)
            left = np.repeat(np.arange(lo, hi), more)
            right = np.arange(len(left)) - np.repeat(np.cumsum(more) - more, more) + left + 1
            yield rows(group, pa.array(items[left], pa.int32()), pa.array(items[right], pa.int32()), np.ones(len(left), np.int64))
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, size, work, inner, whole = None, [], 0, 0, False, True
        for batch in batches:
            ids = batch["group_id"].to_numpy(zero_copy_only=False)
            square = batch["items"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) ** 2
            upto = np.cumsum(square)
            starts = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)] if len(ids) else [0]
            for s, e in zip(starts[:-1], starts[1:]):
                if ids[s] != group:
                    if held:
                        yield flush(group, held, inner and whole)
                    held, size, work, inner, whole = [], 0, 0, group is not None, True
                group = ids[s]
                while s < e:
                    room = int(np.searchsorted(upto[s:e] - upto[s] + square[s], WORK - work, "right"))
                    take = min(e - s, BLOCK - size, room)
                    if take:
                        held.append(batch["items"].slice(s, take))
                        s, size, work = s + take, size + take, work + int(square[s : s + take].sum())
                    elif not held:
                        whole = False
                        yield from alone(group, batch["items"][s].values.to_numpy(zero_copy_only=False))
                        s += 1
                    if s < e and (size == BLOCK or not take) and held:
                        yield flush(group, held, False)
                        held, size, work, whole = [], 0, 0, False
        if held:
            yield flush(group, held, False)

    return run


def pair_counts(baskets: DataFrame, min_together: int = 1) -> DataFrame:
    """Rows (group_id, a, b, n) summed over all baskets (group_id STRING, basket_id, items ARRAY<INT>).

    a < b: n baskets hold both; b null: n baskets hold a; a and b null: the group has n baskets. Baskets without group or
    items are ignored; null items are dropped and repeated items count once. Baskets are range-partitioned by (group, hash of
    the basket), so a group with a third of all rows is spread over many tasks while small groups stay whole; in a task, blocks
    end by their baskets or their pairs, and a basket with more pairs than a block gives them in parts. Pairs in fewer than
    min_together baskets may be left out; all others are there with their full counts.
    """
    clean = baskets.select(F.col("group_id").cast("string").alias("group_id"), "basket_id", F.array_distinct(F.filter("items", lambda x: x.isNotNull())).alias("items"))
    clean = clean.where(F.col("group_id").isNotNull() & (F.size("items") > 0)).withColumn("salt", F.xxhash64("basket_id"))
    spread = clean.repartitionByRange("group_id", "salt").sortWithinPartitions("group_id").select("group_id", "items")
    return spread.mapInArrow(_block_kernel(min_together), PARTIAL).groupBy("group_id", "a", "b").agg(F.sum("n").alias("n"))


def lifted_pairs(counts: DataFrame, min_together: int, min_lift: float) -> DataFrame:
    """Pairs of pair_counts() in at least min_together baskets and with lift n_ab * B / (n_a * n_b) >= min_lift.

    What can still count is written once, so the baskets are counted once. min_lift has at most nine decimals; the test is done in
    whole numbers, so ties at the limit are exact.
    """
    limit = Decimal(str(min_lift))
    places = max(0, -limit.as_tuple().exponent)
    if places > 9:
        raise ValueError("min_lift has more than nine decimals")
    counts = cut(counts.where(F.col("b").isNull() | (F.col("n") >= min_together)))
    pairs = counts.where(F.col("b").isNotNull()).withColumnRenamed("n", "n_ab")
    items = counts.where(F.col("a").isNotNull() & F.col("b").isNull())
    sizes = counts.where(F.col("a").isNull()).select("group_id", F.col("n").alias("n_baskets"))
    joined = pairs.join(items.select("group_id", "a", F.col("n").alias("n_a")), ["group_id", "a"]).join(items.select("group_id", F.col("a").alias("b"), F.col("n").alias("n_b")), ["group_id", "b"]).join(sizes, "group_id")
    product = lambda a, b, k: (F.col(a).cast("decimal(18,0)") * F.col(b).cast("decimal(18,0)")).cast("decimal(27,0)") * F.lit(k).cast("decimal(11,0)")
    ok = product("n_ab", "n_baskets", 10**places) >= product("n_a", "n_b", int(limit * 10**places))
    lift = F.col("n_ab") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b"))
    return joined.where(ok).select("group_id", "a", "b", "n_ab", "n_a", "n_b", "n_baskets", F.round(lift, 6).alias("lift"))
