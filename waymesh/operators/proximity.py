"""Points near other points, and the regions that contain a point.

Latitude is cut into strips of about equal numbers of rows. Every point goes to its home strip and, as a guest, to the strips
just below it within its reach. Each strip is sorted by latitude and swept upwards: the active set holds the home points
within reach below the sweep line, ordered by longitude, and every arriving point is probed against it. A pair is found
exactly once, in the home strip of its lower point, which owns it. Memory is bounded by the active set, not by the strip.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.session import shuffle_partitions

EARTH_M = 6_371_000.0
#: Rows of candidate pairs that a probe expands at a time.
CHUNK = 2_000_000


@dataclass(frozen=True)
class Near:
    """Find pairs of the point sets left and right at most limit_m metres apart (great circle) and call them kind."""

    kind: str
    left: str
    right: str
    limit_m: float


def usable(df: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(id, lat, lon) of the rows with a key and with finite coordinates in range that are not both zero."""
    y, x = F.col(lat), F.col(lon)
    ok = y.between(-90.0, 90.0) & x.between(-180.0, 180.0) & ((y != 0.0) | (x != 0.0)) & F.col(key).isNotNull()
    return df.where(ok).select(F.col(key).cast("long").alias("id"), y.cast("double").alias("lat"), x.cast("double").alias("lon"))


def strip_bounds(points: DataFrame, rows_per_strip: int = 250_000, max_strips: int = 4096) -> np.ndarray:
    """Ascending inner bounds of the strips: approximate latitude quantiles of all points, one aggregate of bounded size."""
    n, q = points.agg(F.count(F.lit(1)), F.percentile_approx("lat", [i / max_strips for i in range(1, max_strips)], 4 * max_strips)).first()
    strips = min(max_strips, max(shuffle_partitions(points.sparkSession), n // rows_per_strip))
    if not q or strips < 2:
        return np.empty(0)
    return np.unique(np.asarray(q)[[min(len(q) - 1, round(i * max_strips / strips) - 1) for i in range(1, strips)]])


def great_circle_m(lat1, lon1, lat2, lon2):
    """Haversine distance of numpy arrays in degrees."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _spread(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each i the integers first[i] .. last[i]-1: (i repeated, integers), in chunks of bounded size."""
    count = np.maximum(last - first, 0)
    total = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + CHUNK, "right")) - 1)
        n = count[lo:hi]
        if n.sum():
            owner = np.repeat(np.arange(lo, hi), n)
            yield owner, np.arange(n.sum()) - np.repeat(total[lo:hi] - total[lo], n) + first[owner]
        lo = hi


class _Set:
    """Points as parallel arrays; seq is the place in the sweep order."""

    def __init__(self, lat, lon, ids, seq):
        self.lat, self.lon, self.ids, self.seq = lat, lon, ids, seq

    def where(self, mask) -> _Set:
        return _Set(self.lat[mask], self.lon[mask], self.ids[mask], self.seq[mask])

    def plus(self, other: _Set) -> _Set:
        return _Set(*(np.concatenate([a, b]) for a, b in ((self.lat, other.lat), (self.lon, other.lon), (self.ids, other.ids), (self.seq, other.seq))))

    @staticmethod
    def none() -> _Set:
        return _Set(np.empty(0), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))


def _probe(active: _Set, arriving: _Set, limit_m: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id from active, id arriving, metres) of pairs in sweep order within the limit. Longitudes wrap at 180 degrees."""
    if not len(active.ids) or not len(arriving.ids):
        return
    angle = limit_m / EARTH_M * (1 + 1e-9)
    with np.errstate(invalid="ignore", divide="ignore"):
        wide = np.degrees(np.arcsin(np.minimum(1.0, np.sin(angle) / np.cos(np.radians(arriving.lat)))))
    wide = np.where(np.abs(arriving.lat) + np.degrees(angle) >= 90 - 1e-9, 180.0, wide) + 1e-9
    most = wide.max()
    lon, at = active.lon, np.arange(len(active.ids))
    for turn in (360.0, -360.0):
        edge = np.flatnonzero(active.lon * np.sign(turn) < most - 180.0)
        lon, at = np.concatenate([lon, active.lon[edge] + turn]), np.concatenate([at, edge])
    order = np.argsort(lon, kind="stable")
    lon, at = lon[order], at[order]
    first, last = np.searchsorted(lon, arriving.lon - wide, "left"), np.searchsorted(lon, arriving.lon + wide, "right")
    for j, k in _spread(first, last):
        i = at[k]
        keep = (active.seq[i] < arriving.seq[j]) & (arriving.lat[j] - active.lat[i] <= np.degrees(angle))
        i, j = i[keep], j[keep]
        d = great_circle_m(active.lat[i], active.lon[i], arriving.lat[j], arriving.lon[j])
        ok = d <= limit_m
        yield active.ids[i[ok]], arriving.ids[j[ok]], d[ok]


def _placer(bounds: np.ndarray, reach: list[float]):
    """Arrow kernel: rows (set, id, lat, lon) with home strip, and a guest copy for each lower strip within reach."""
    degrees = np.degrees(np.asarray(reach) / EARTH_M) * (1 + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lat, code = b["lat"].to_numpy(), b["set"].to_numpy()
            home = np.searchsorted(bounds, lat, "right")
            low = np.searchsorted(bounds, lat - degrees[code], "right")
            row = np.repeat(np.arange(len(lat)), home - low + 1)
            strip = np.concatenate([np.arange(a, z + 1) for a, z in zip(low, home)]) if (low < home).any() else home
            t = b.take(pa.array(row)) if len(row) > len(lat) else b
            yield pa.RecordBatch.from_arrays([pa.array(strip.astype(np.int32)), pa.array(strip == home[row]), *t.columns], ["strip", "home", *t.schema.names])

    return run


def _sweeper(rules: list[tuple[str, int, int, float]], reach: list[float]):
    """Arrow kernel over one strip, sorted by (lat, set, id): found pairs (kind, first_id, second_id, metres)."""
    names, kinds = ["kind", "first_id", "second_id", "metres"], [r[0] for r in rules]

    def out(kind: str, a, b, d) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = [_Set.none() for _ in reach]
        seq, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            code, ids, lat, lon, home = (b[c].to_numpy(zero_copy_only=False) for c in ("set", "id", "lat", "lon", "home"))
            new = np.ones(len(ids), bool)  # rows repeated in the table are adjacent here
            new[1:] = (code[1:] != code[:-1]) | (ids[1:] != ids[:-1]) | (lat[1:] != lat[:-1]) | (lon[1:] != lon[:-1])
            new[0] = last != (code[0], ids[0], lat[0], lon[0])
            last = (code[-1], ids[-1], lat[-1], lon[-1])
            place = np.arange(seq, seq + len(ids))
            seq += len(ids)
            come = [_Set(lat, lon, ids, place).where(new & (code == s)) for s in range(len(reach))]
            stay = [_Set(lat, lon, ids, place).where(new & (code == s) & home) for s in range(len(reach))]
            for s in range(len(reach)):
                active[s] = active[s].plus(stay[s])
            for kind, a, z, limit in rules:
                for i, j, d in _probe(active[a], come[z], limit):
                    if a == z:
                        apart = i != j
                        yield out(kind, np.minimum(i, j)[apart], np.maximum(i, j)[apart], d[apart])
                    else:
                        yield out(kind, i, j, d)
                if a != z:
                    for j, i, d in _probe(active[z], come[a], limit):
                        yield out(kind, i, j, d)
            for s, r in enumerate(reach):
                active[s] = active[s].where(active[s].lat >= lat[-1] - np.degrees(r / EARTH_M) * (1 + 1e-9) - 1e-12)

    assert len(set(kinds)) == len(kinds)
    return run


def near_pairs(sets: dict[str, DataFrame], rules: list[Near], bounds: np.ndarray | None = None) -> DataFrame:
    """Distinct (kind, first_id, second_id, metres) of all pairs of points that a rule of their sets admits.

    sets: usable() points (id, lat, lon) by name. Within one set the smaller id comes first and a point is never paired with
    itself; between two sets left comes first. An id at several places counts with its least distance. Rows repeated in a set
    count once. Empty sets give no pairs. Points at the antimeridian and around the poles meet across them. Coincident
    points are not a special case: their pairs are the result, so its size is the only thing that grows. bounds: those of
    strip_bounds(), where they are known.
    """
    names = list(sets)
    reach = [max([r.limit_m for r in rules if n in (r.left, r.right)], default=0.0) for n in names]
    coded = [df.select(F.lit(i).cast("int").alias("set"), "id", "lat", "lon") for i, df in enumerate(sets.values())]
    points = reduce(DataFrame.unionByName, coded)
    bounds = strip_bounds(points) if bounds is None else bounds
    placed = points.mapInArrow(_placer(bounds, reach), "strip int, home boolean, set int, id long, lat double, lon double")
    swept = placed.repartitionById(len(bounds) + 1, "strip").sortWithinPartitions("lat", "set", "id", "lon")
    plan = [(r.kind, names.index(r.left), names.index(r.right), float(r.limit_m)) for r in rules]
    found = swept.drop("strip").mapInArrow(_sweeper(plan, reach), "kind string, first_id long, second_id long, metres double")
    return found.groupBy("kind", "first_id", "second_id").agg(F.min("metres").alias("metres"))


def _region_placer(bounds: np.ndarray):
    """Arrow kernel: a row per strip that [lat, top] meets (points have top = lat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = np.searchsorted(bounds, b["lat"].to_numpy(), "right")
            high = np.searchsorted(bounds, b["top"].to_numpy(), "right")
            row = np.repeat(np.arange(b.num_rows), high - low + 1)
            strip = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[row]
            yield pa.RecordBatch.from_arrays([pa.array(strip.astype(np.int32)), *b.take(pa.array(row)).columns], ["strip", *b.schema.names])

    return run


@dataclass
class _Rings:
    """Rings as flat arrays: the vertices of ring k are those from first[k], size[k] of them; boxes beside."""

    ids: np.ndarray
    first: np.ndarray
    size: np.ndarray
    x: np.ndarray
    y: np.ndarray
    west: np.ndarray
    east: np.ndarray
    south: np.ndarray
    north: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, lon: pa.ListArray, lat: pa.ListArray) -> _Rings:
        x, y = lon.flatten().to_numpy(), lat.flatten().to_numpy()
        size = lon.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(size) - size
        box = [f.reduceat(v, first) if len(ids) else np.empty(0) for v in (x, y) for f in (np.minimum, np.maximum)]
        return _Rings(ids, first, size, x, y, *box)

    def where(self, mask: np.ndarray) -> _Rings:
        at, size = np.repeat(mask, self.size), self.size[mask]
        return _Rings(self.ids[mask], np.cumsum(size) - size, size, self.x[at], self.y[at], *(v[mask] for v in (self.west, self.east, self.south, self.north)))

    def plus(self, other: _Rings) -> _Rings:
        both = lambda name: np.concatenate([getattr(self, name), getattr(other, name)])
        return _Rings(both("ids"), np.concatenate([self.first, other.first + len(self.x)]), *map(both, ("size", "x", "y", "west", "east", "south", "north")))


def inside_rings(x: np.ndarray, y: np.ndarray, rings: _Rings, ring: np.ndarray) -> np.ndarray:
    """Even-odd test of each point against its own ring (place in rings) with straight edges; closed or not, in either direction."""
    hit = np.empty(len(x), bool)
    upto = np.concatenate([[0], np.cumsum(rings.size[ring])])
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + CHUNK, "right")) - 1)
        n = rings.size[ring[lo:hi]]
        pair = np.repeat(np.arange(lo, hi), n)
        k = np.arange(len(pair)) - np.repeat(upto[lo:hi] - upto[lo], n)
        r = ring[pair]
        a, b = rings.first[r] + k, rings.first[r] + np.where(k + 1 < rings.size[r], k + 1, 0)
        spans = (rings.y[a] > y[pair]) != (rings.y[b] > y[pair])
        a, b, pair = a[spans], b[spans], pair[spans]
        right = x[pair] < (rings.x[b] - rings.x[a]) * (y[pair] - rings.y[a]) / (rings.y[b] - rings.y[a]) + rings.x[a]
        hit[lo:hi] = np.bincount(pair[right] - lo, minlength=hi - lo) % 2 == 1
        lo = hi
    return hit


def _region_sweeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow kernel over one strip, sorted by (lat, region first): (region_id, point_id) of containment.

    Points are ordered by longitude, so the rings that are open find the points between their west and east ends by search, all at once.
    """
    kind = pa.list_(pa.float64())
    open_ = _Rings.of(np.empty(0, np.int64), pa.array([], kind), pa.array([], kind))
    for b in batches:
        if not b.num_rows:
            continue
        is_region = b["ring_lon"].is_valid()
        ids, lat, lon = (b[c].to_numpy() for c in ("id", "lat", "lon"))
        region = is_region.to_numpy(zero_copy_only=False)
        if region.any():
            come = b.filter(is_region)
            open_ = open_.plus(_Rings.of(ids[region], come["ring_lon"], come["ring_lat"]))
        at = np.flatnonzero(~region)
        if len(at) and len(open_.ids):
            at = at[np.argsort(lon[at], kind="stable")]
            x, y = lon[at], lat[at]
            near = np.flatnonzero((open_.north >= y.min()) & (open_.south <= y.max()))
            first, last = np.searchsorted(x, open_.west[near], "left"), np.searchsorted(x, open_.east[near], "right")
            for r, p in _spread(first, last):
                ring = near[r]
                tall = (y[p] >= open_.south[ring]) & (y[p] <= open_.north[ring])
                ring, p = ring[tall], p[tall]
                held = inside_rings(x[p], y[p], open_, ring)
                yield pa.RecordBatch.from_arrays([pa.array(open_.ids[ring[held]], pa.int64()), pa.array(ids[at[p[held]]], pa.int64())], ["region_id", "point_id"])
        open_ = open_.where(open_.north >= lat[-1])


def regions_of_points(points: DataFrame, regions: DataFrame, key: str, ring: str, bounds: np.ndarray | None = None) -> DataFrame:
    """Distinct (region_id, point_id) where the point lies in the ring (ARRAY of STRUCT with lon and lat).

    Edges are straight in lon/lat; rings do not wrap at the antimeridian. A region without key, with fewer than three
    vertices or with any missing coordinate holds nothing. A region goes to every strip that its latitudes meet. bounds: those of
    strip_bounds(), where they are known.
    """
    bounds = strip_bounds(points) if bounds is None else bounds
    xs, ys = F.col(f"{ring}.lon"), F.col(f"{ring}.lat")
    whole = (F.size(ring) >= 3) & ~F.exists(xs, lambda v: v.isNull() | F.isnan(v)) & ~F.exists(ys, lambda v: v.isNull() | F.isnan(v))
    zones = regions.where(F.col(key).isNotNull() & whole).select(F.col(key).cast("long").alias("id"), F.array_min(ys).alias("lat"), F.lit(0.0).alias("lon"), F.array_max(ys).alias("top"), xs.alias("ring_lon"), ys.alias("ring_lat"))
    none = F.lit(None).cast("array<double>")
    dots = points.select("id", "lat", "lon", F.col("lat").alias("top"), none.alias("ring_lon"), none.alias("ring_lat"))
    kind = "id long, lat double, lon double, top double, ring_lon array<double>, ring_lat array<double>"
    placed = dots.unionByName(zones).mapInArrow(_region_placer(bounds), f"strip int, {kind}")
    swept = placed.repartitionById(len(bounds) + 1, "strip").sortWithinPartitions("lat", F.col("ring_lon").isNull(), "id").drop("strip")
    return swept.mapInArrow(_region_sweeper, "region_id long, point_id long").distinct()
