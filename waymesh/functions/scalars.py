"""Names, seeds, counter-based random numbers and small rules as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Road classes of highway tags, free speeds in km/h and hourly capacities of the classes.
ROAD_CLASSES = {
    "motorway": 1, "trunk": 2, "primary": 3, "secondary": 4, "tertiary": 5, "unclassified": 6, "residential": 6, "service": 7,
    "motorway_link": 1, "trunk_link": 2, "primary_link": 3, "secondary_link": 4, "tertiary_link": 5, "living_street": 8, "pedestrian": 8, "road": 6,
}
FREE_KMH = {1: 100.0, 2: 90.0, 3: 90.0, 4: 70.0, 5: 50.0, 6: 40.0, 7: 20.0, 8: 10.0}
CAPACITY_VEH_H = {1: 1900.0, 2: 1600.0, 3: 1400.0, 4: 1100.0, 5: 900.0, 6: 600.0, 7: 400.0, 8: 300.0}
# Bands of the target route size and of the demand types.
ROUTE_SIZE_BANDS = {1: (3.0, 5.0), 2: (5.0, 8.0), 3: (8.0, 12.0), 4: (12.0, 16.0), 5: (16.0, 25.0), 6: (25.0, 50.0), 7: (50.0, 200.0)}
DEMAND_BANDS = {1: (1, 1), 2: (1, 10), 3: (5, 10), 4: (1, 100), 5: (50, 100), 6: (1, 50), 7: (1, 10)}
HORIZON = 86400
# Categories of points of interest, the first seven are taken where none are named.
POI_CATEGORIES = (
    "restaurant", "cafe", "bar", "fast_food", "pub", "school", "university", "hospital", "clinic", "pharmacy", "dentist", "doctors",
    "veterinary", "bank", "atm", "post_office", "police", "fire_station", "townhall", "courthouse", "library", "theatre", "cinema",
    "arts_centre", "community_centre", "museum", "place_of_worship", "marketplace", "fuel", "charging_station", "car_wash", "parking",
    "bus_station", "taxi", "bicycle_rental", "ferry_terminal", "kindergarten", "college", "nightclub", "biergarten", "ice_cream",
    "food_court", "bench", "drinking_water", "toilets", "shower", "shelter", "waste_basket", "recycling",
)
DEFAULT_CATEGORIES = POI_CATEGORIES[:7]


def lookup(table: dict, key: Column) -> Column:
    """The table's value for key, null if it has none; a literal map, so no join."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def uniform(seed: Column | int, label: str, *key: Column) -> Column:
    """A number in (0, 1) that depends only on seed, label and key: the same on every run and partitioning."""
    s = seed if isinstance(seed, Column) else F.lit(seed)
    text = F.concat_ws("|", s.cast("string"), F.lit(label), *(k.cast("string") for k in key))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def gauss(seed: Column | int, label: str, *key: Column) -> Column:
    """A standard normal number, by Box and Muller from two uniforms."""
    return F.sqrt(-2 * F.log(uniform(seed, label + ":r", *key))) * F.cos(6.283185307179586 * uniform(seed, label + ":a", *key))


def whole_between(lo: Column | int, hi: Column | int, u: Column) -> Column:
    """The whole number of lo..hi that the uniform u picks."""
    a, z = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return (a + F.floor(u * (z - a + 1))).cast("long")


def clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    a, z = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.least(F.greatest(x, a), z)


def slug(x: Column) -> Column:
    """Lower case, runs of anything else than a-z and 0-9 as one underscore, none at the ends; x if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "x").otherwise(s)


# Short names of the ways to choose customers.
METHOD_NAMES = {"poi_categories": "poi", "parametric_attach": "par", "hybrid": "hyb"}


def method_name(method: Column) -> Column:
    """The short name of a method, its slug if it has none."""
    return F.coalesce(lookup(METHOD_NAMES, F.lower(F.trim(method))), slug(method))


def city_label(name: Column) -> Column:
    """A city's name for display: hyphens and underscores as spaces, none at the ends."""
    return F.trim(F.translate(name, "-_", "  "))


def _text(part: Column) -> Column:
    """A part of a key as text; null is a text of its own, so that it never vanishes."""
    return F.coalesce(part.cast("string"), F.lit("None"))


def edge_key(a: Column, b: Column) -> Column:
    return F.concat(F.lit("node:"), a.cast("string"), F.lit("_"), b.cast("string"))


def sha_seed(*parts: Column) -> Column:
    """Unsigned 64-bit seed: the first 8 bytes of the sha256 of the parts joined by a unit separator."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *map(_text, parts)), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def crc_seed(*parts: Column) -> Column:
    """crc32 of the parts joined by a vertical bar."""
    return F.crc32(F.concat_ws("|", *map(_text, parts)))


def bridge_seed(base: Column | int, model: str, intensity: str) -> Column:
    """The seed of one traffic combination."""
    b = base if isinstance(base, Column) else F.lit(base)
    return b + 101 * (("bpr", "wave").index(model) + 1) + 10007 * (("light", "moderate", "heavy").index(intensity) + 1)


def short_id(*parts: Column) -> Column:
    """The first 20 hex digits of the sha256 of the parts joined by a null character."""
    return F.substring(F.sha2(F.concat_ws("\x00", *map(_text, parts)), 256), 1, 20)


def regex_of(values: tuple[str, ...]) -> str:
    """A pattern that matches exactly the given values."""
    return "^(" + "|".join(map(re.escape, values)) + ")$"


def capacity_for(r: Column, total: Column, most: Column, n: Column) -> Column:
    """Vehicle capacity for about r customers a route, at least the largest demand and less than the total if n > 1."""
    wanted = F.when(total == n, F.floor(r)).otherwise(F.greatest(most, F.ceil(r * total / n)))
    return F.when(n < 2, F.greatest(most, wanted)).otherwise(F.least(F.greatest(wanted, most), total - 1)).cast("long")


def repaired_window(start: Column, end: Column, to: Column, back: Column, service: Column, h0: int = 0, h1: int = HORIZON) -> Column:
    """STRUCT(earliest, latest): the window cut to what depot travel allows; a point if nothing is, all of it if they miss."""
    e, z = h0 + to, h1 - service - back
    point = clamp(F.floor((e + z) / 2), h0, h1).cast("long")
    a, b = F.greatest(start, e).cast("long"), F.least(end, z).cast("long")
    pair = lambda x, y: F.struct(x.cast("long").alias("earliest"), y.cast("long").alias("latest"))
    return F.when(z < e, pair(point, point)).when(a > b, pair(e, z)).otherwise(pair(a, b))


def rounded_speed(v: Column) -> Column:
    """Speed to a thousandth, never zero."""
    return F.greatest(F.bround(v, 3), F.lit(0.001))
