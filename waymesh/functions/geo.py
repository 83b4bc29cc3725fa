"""Geodesy as column expressions: WGS84, local tangent frames, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the WGS84 ellipsoid and of the spherical and flat approximations.
A, B = 6378137.0, 6356752.31424518
E2, EP2 = 1 - B * B / (A * A), A * A / (B * B) - 1
EARTH_M = 6371000.0
FLAT_M_PER_DEG = 111320.0
KM_PER_DEG = 111.0


def ecef(lat: Column, lon: Column, alt: Column | float = 0.0) -> tuple[Column, Column, Column]:
    """Earth-centred x, y, z of a point in degrees and metres."""
    h = alt if isinstance(alt, Column) else F.lit(alt)
    p, q = F.radians(lat), F.radians(lon)
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return (n + h) * F.cos(p) * F.cos(q), (n + h) * F.cos(p) * F.sin(q), (n * (1 - E2) + h) * F.sin(p)


def lla(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """lat, lon, alt of an earth-centred point, by one step of Bowring's method."""
    p = F.hypot(x, y)
    t = F.atan2(z * A, p * B)
    lat = F.atan2(z + EP2 * B * F.pow(F.sin(t), 3), p - E2 * A * F.pow(F.cos(t), 3))
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), p / F.cos(lat) - n


def enu(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column, Column]:
    """East, north, up of a point in the tangent frame at (lat0, lon0), altitude 0."""
    here, there = ecef(lat, lon), ecef(lat0, lon0)
    dx, dy, dz = (a - b for a, b in zip(here, there))
    p, q = F.radians(lat0), F.radians(lon0)
    east = F.cos(q) * dy - F.sin(q) * dx
    north = F.cos(p) * dz - F.sin(p) * (F.cos(q) * dx + F.sin(q) * dy)
    up = F.sin(p) * dz + F.cos(p) * (F.cos(q) * dx + F.sin(q) * dy)
    return east, north, up


def lla_of_enu(east: Column, north: Column, up: Column, lat0: Column, lon0: Column) -> tuple[Column, Column, Column]:
    """lat, lon, alt of a point of the tangent frame at (lat0, lon0)."""
    p, q = F.radians(lat0), F.radians(lon0)
    x0, y0, z0 = ecef(lat0, lon0)
    r = F.cos(p) * up - F.sin(p) * north
    return lla(x0 + F.cos(q) * r - F.sin(q) * east, y0 + F.sin(q) * r + F.cos(q) * east, z0 + F.sin(p) * up + F.cos(p) * north)


def span3(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Straight distance of two points in space; the same in every frame."""
    return F.sqrt(sum(((u - v) * (u - v) for u, v in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0])))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on the sphere."""
    s, t = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t)))


def is_lonlat(x: Column, y: Column) -> Column:
    return (F.abs(x) <= 180.0) & (F.abs(y) <= 90.0)


def flat_metres(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Equirectangular metres between lon/lat points, plain distance between others."""
    wide = FLAT_M_PER_DEG * F.cos(F.radians((y1 + y2) / 2))
    return F.when(is_lonlat(x1, y1) & is_lonlat(x2, y2), F.hypot(wrapped_lon(x1 - x2) * wide, (y1 - y2) * FLAT_M_PER_DEG)).otherwise(F.hypot(x1 - x2, y1 - y2))


def wrapped_lon(lon: Column) -> Column:
    """A longitude up to one turn off, in -180..180."""
    return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)


def bounds_center(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> tuple[Column, Column]:
    """The middle of a box; one that crosses the antimeridian (min_lon > max_lon) has its middle on the far side."""
    mid = (min_lon + max_lon) / 2
    turned = mid + F.when(mid > 0, -180.0).otherwise(180.0)
    return (min_lat + max_lat) / 2, F.when(min_lon > max_lon, turned).otherwise(mid)


def span_km(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> tuple[Column, Column]:
    """North-south and east-west extent of a box in km."""
    wide = F.greatest(F.lit(0.0), F.cos(F.radians((min_lat + max_lat) / 2)))
    return F.abs(max_lat - min_lat) * KM_PER_DEG, F.abs(max_lon - min_lon) * KM_PER_DEG * wide
