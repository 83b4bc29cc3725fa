"""Fixed-capacity containers filled with items of varying length.

The global histogram of lengths, at most HISTOGRAM rows for each kind of container, goes to the driver. Dynamic programming over
it chooses the bucket boundaries with the least padding, which is the space of containers that their items leave unused when
batches are formed inside the buckets. Items are spread by hash into shards of bounded size; in a shard every bucket is batched
by itself: each batch has the container's capacity as its token budget and takes the longest item that still fits, until none
does. No container holds items of two buckets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTENT = "bin_kind string, capacity_tokens int, bucket int, container_id string, slot int, item_id long, piece int, token_start long, n_tokens int, used_tokens int"
#: Rows of a histogram (longer scales are rounded up to so many steps), kinds of containers, and cuts that the programme weighs.
HISTOGRAM, KINDS, CUTS = 512, 1_000, 16


def batches(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Token-budget batches of items given as a histogram: (how many alike, [(place in lengths, items of it)]), all items once.

    lengths ascend, are distinct and within 1..capacity. A batch begins with the longest item left and goes on with the
    longest that fits; a batch is repeated as often as the counts allow.
    """
    size, left = lengths.tolist(), counts.tolist()
    below = list(range(-1, len(size) - 1))  # the next shorter length that may have items

    def longest(i: int) -> int:
        path = []
        while i >= 0 and not left[i]:
            path.append(i)
            i = below[i]
        for p in path:
            below[p] = i
        return i

    out, top = [], longest(len(size) - 1)
    while top >= 0:
        room, batch, i = capacity, [], top
        while i >= 0:
            k = min(left[i], room // size[i])
            if k:
                batch.append((i, k))
                room -= k * size[i]
            i = longest(min(i - 1, bisect_right(size, room) - 1))
        alike = min(left[i] // k for i, k in batch)
        for i, k in batch:
            left[i] -= alike * k
        out.append((alike, batch))
        top = longest(top)
    return out


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int, padding: Callable[[int, int], float]) -> np.ndarray:
    """Ascending upper bounds of at most so many buckets over all lengths with the least total padding, of equals the most buckets.

    lengths ascend and are distinct; padding(i, j) is that of a bucket with the lengths i..j-1. Up to CUTS lengths every one may be a
    bound; of more, bounds are among CUTS cuts at equal shares of all tokens, beside the half and all of the longest length, so at most CUTS * (CUTS + 3) / 2 + 6 paddings are asked for.
    """
    n = len(lengths)
    share = np.cumsum(lengths * counts)
    cuts = np.arange(n + 1) if n <= CUTS else np.unique(np.concatenate([[0, n], np.searchsorted(share, share[-1] * np.arange(1, CUTS) / CUTS) + 1, [np.searchsorted(lengths, lengths[-1] / 2, "right"), n - 1]]))
    cost = {(a, z): padding(int(cuts[a]), int(cuts[z])) for z in range(1, len(cuts)) for a in range(z)}
    best: list[list[tuple[float, int]]] = [[(0.0, -1)] + [(np.inf, -1)] * (len(cuts) - 1)]
    for _ in range(min(buckets, len(cuts) - 1)):
        best.append([(np.inf, -1)] + [min((best[-1][a][0] + cost[a, z], a) for a in range(z)) for z in range(1, len(cuts))])
    many = min(range(1, len(best)), key=lambda b: (best[b][-1][0], -b))
    bounds, z = [], len(cuts) - 1
    for b in range(many, 0, -1):
        bounds.append(lengths[cuts[z] - 1])
        z = best[b][z][1]
    return np.asarray(bounds[::-1])


def least_padding(lengths: np.ndarray, counts: np.ndarray, capacity: int, buckets: int) -> np.ndarray:
    """optimal_buckets with the space that batches formed on the histogram leave unused as padding."""

    def unused(i: int, j: int) -> float:
        u, n = lengths[i:j], counts[i:j]
        return float(sum(k for k, _ in batches(u, n, capacity)) * capacity - (u * n).sum())

    return optimal_buckets(lengths, counts, buckets, unused)


def fill_containers(lengths: np.ndarray, bounds: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, container, slot) of each item; containers are numbered through, buckets one after the other.

    lengths are within 1..capacity and at most the last bound. Deterministic in the order of the items.
    """
    bucket = np.searchsorted(bounds, lengths, "left")
    container, slot = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    first = 0
    for b in np.unique(bucket):
        mine = np.flatnonzero(bucket == b)
        order = mine[np.argsort(lengths[mine], kind="stable")]
        u, start, n = np.unique(lengths[order], return_index=True, return_counts=True)
        at = start.tolist()
        for alike, batch in batches(u, n, capacity):
            held = 0
            for i, k in batch:
                items = order[at[i] : at[i] + alike * k]
                at[i] += alike * k
                container[items] = np.repeat(np.arange(first, first + alike), k)
                slot[items] = np.tile(np.arange(held, held + k), alike)
                held += k
            first += alike
    return bucket, container, slot


def cut_items(items: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """(kind, item_id, piece, token_start, n_tokens) for each kind of container, by place in kinds: items above its capacity in pieces of it and a rest, the others whole.

    items: item_id, n_tokens. Null sizes give no row, size 0 gives one piece of 0.
    """
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.lit(c).alias("capacity")) for i, (_, c) in enumerate(kinds)))).alias("k")
    wide = items.where(F.col("n_tokens").isNotNull()).select("item_id", "n_tokens", each).select("item_id", "n_tokens", "k.kind", "k.capacity")
    pieces = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.col("capacity"))).cast("int"))
    opened = wide.select("item_id", "n_tokens", "kind", "capacity", F.explode(pieces).alias("piece"))
    start = F.col("piece").cast("long") * F.col("capacity")
    return opened.select("kind", "item_id", "piece", start.alias("token_start"), F.least(F.col("capacity"), F.col("n_tokens") - start).cast("int").alias("n_tokens"))


def _fill_kernel(kinds: list[tuple[str, int]], bounds: list[np.ndarray]):
    """Arrow kernel over one shard of one kind of container."""
    names = ["kind", "item_id", "piece", "token_start", "n_tokens"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [f for f in frames if f.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        shard, kind = t["shard"][0].as_py(), t["kind"][0].as_py()
        t = t.select(names).sort_by([("item_id", "ascending"), ("piece", "ascending"), ("n_tokens", "ascending")]).combine_chunks()
        name, capacity = kinds[kind]
        sizes = t["n_tokens"].to_numpy()
        bucket, container, slot = fill_containers(sizes, bounds[kind], capacity)
        used = np.bincount(container, sizes).astype(np.int32)[container]
        cols = [[name] * len(sizes), np.full(len(sizes), capacity, np.int32), bounds[kind][bucket].astype(np.int32), np.char.add(f"{shard}-", container.astype(str)), slot.astype(np.int32), *(t[c] for c in names[1:]), used]
        yield from pa.table([pa.array(c) if not isinstance(c, pa.ChunkedArray) else c for c in cols], names=[c.split()[0] for c in CONTENT.split(", ")]).combine_chunks().to_batches(max_chunksize=50_000)

    return run


def pack_kinds(items: DataFrame, kinds: list[tuple[str, int]], buckets: int = 8, shard_items: int = 100_000) -> DataFrame:
    """The contents of all containers of each kind (name, capacity): bin_kind, capacity_tokens, bucket (its upper bound), container_id,
    slot, item_id, piece, token_start, n_tokens, used_tokens.

    items: item_id LONG, n_tokens INT. For each kind every item is placed: whole if it fits a container, else in pieces of the
    capacity and a rest. Items of size 0 need no container and have a null container_id; items without size give no row.
    Repeated ids are separate items. Shards take items by hash and hold about shard_items (a bound on memory), whatever the
    lengths, so a length that a third of all items share is spread like any other; a shard leaves a few containers partly filled.
    More than KINDS kinds are refused. One histogram job and one plan serve all kinds.
    """
    if len(kinds) > KINDS or any(c < 1 for _, c in kinds):
        raise ValueError(f"1 to {KINDS} kinds with a capacity of at least 1")
    pieces = cut_items(items, kinds) if kinds else items.select(F.lit(0).alias("kind"), "item_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("token_start"), "n_tokens").limit(0)
    lookup = lambda values: F.element_at(F.array(*map(F.lit, values or [0])), F.col("kind") + 1)
    step = [-(-c // HISTOGRAM) for _, c in kinds]
    rounded = F.least(lookup([c for _, c in kinds]), F.ceil(F.col("n_tokens") / lookup(step)) * lookup(step)).cast("int")
    histogram = pieces.where(F.col("n_tokens") > 0).groupBy("kind", rounded.alias("u")).agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "u").collect()
    empty = pieces.where(F.col("n_tokens") == 0).select(lookup([k for k, _ in kinds]).cast("string").alias("bin_kind"), lookup([c for _, c in kinds]).cast("int").alias("capacity_tokens"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("string").alias("container_id"), F.lit(0).alias("slot"), "item_id", "piece", "token_start", "n_tokens", F.lit(0).alias("used_tokens"))
    bounds, shards = [], []
    for i, (_, c) in enumerate(kinds):
        mine = [r for r in histogram if r.kind == i]
        u, n = (np.asarray([r[x] for r in mine], np.int64) for x in ("u", "n"))
        bounds.append(least_padding(u, n, c, buckets) if len(u) else np.array([c]))
        shards.append(max(1, int(-(-n.sum() // shard_items))))
    if not histogram:
        return empty
    before = (np.cumsum(shards) - shards).tolist()
    spread = pieces.where(F.col("n_tokens") > 0).withColumn("shard", (lookup(before) + F.pmod(F.xxhash64("item_id", "piece"), lookup(shards))).cast("int"))
    filled = spread.repartitionById(sum(shards), "shard").mapInArrow(_fill_kernel(kinds, bounds), CONTENT)
    return filled.unionByName(empty)


def pack(items: DataFrame, capacity: int, buckets: int = 8, shard_items: int = 100_000) -> DataFrame:
    """pack_kinds() for one kind, without its columns bin_kind and capacity_tokens."""
    return pack_kinds(items, [("", capacity)], buckets, shard_items).drop("bin_kind", "capacity_tokens")


def fill_report(packed: DataFrame, *by: str) -> DataFrame:
    """Per kind and the further columns: containers, tokens, padding (unused space) and the share of space used."""
    held = packed.where("container_id IS NOT NULL").groupBy("bin_kind", "capacity_tokens", *by).agg(F.sum((F.col("slot") == 0).cast("int")).alias("n_containers"), F.sum("n_tokens").alias("tokens"))
    space = F.col("n_containers") * F.col("capacity_tokens")
    return held.withColumns({"padding": space - F.col("tokens"), "used_share": F.round(F.col("tokens") / space, 6)})
