"""Distances, boxes and geohash cells as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0
# Fixed value: the geohash alphabet.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
#: (longitude bits, latitude bits) by geohash precision.
BITS = {3: (8, 7), 4: (10, 10)}
#: Beyond this many cells a cover isn't worth its lookups.
MOST_CELLS = 50


#: Kilometres in a mile, as the search form counts them.
KM_PER_MILE = 1.60934


def miles_to_km(miles: Column) -> Column:
    """Kilometres."""
    return miles * KM_PER_MILE


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in km, the atan2 form."""
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lng) * F.sin(half_lng)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_text(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """:func:`haversine_km` as SQL text of expressions; long plans are built faster from text."""
    half_lat, half_lng = f"radians(({lat2}) - ({lat1})) / 2", f"radians(({lng2}) - ({lng1})) / 2"
    a = f"sin({half_lat}) * sin({half_lat}) + cos(radians({lat1})) * cos(radians({lat2})) * sin({half_lng}) * sin({half_lng})"
    return f"(2 * {EARTH_KM}D * atan2(sqrt({a}), sqrt(1 - ({a}))))"


def law_of_cosines_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """The same distance by the spherical law of cosines; the cosine is clamped so that equal points give 0."""
    cosine = F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2 - lng1))
    return EARTH_KM * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def bounding_box(lat: float, lng: float, radius_km: float, exact: bool = False) -> tuple[float, float, float, float]:
    """(min_lat, max_lat, min_lng, max_lng). The plain box can clip the circle away from the equator; the exact one holds it."""
    if not exact:
        d_lat, d_lng = radius_km / KM_PER_DEGREE, radius_km / (KM_PER_DEGREE * math.cos(math.radians(lat)))
        return lat - d_lat, lat + d_lat, lng - d_lng, lng + d_lng
    angle = radius_km / EARTH_KM
    d_lat = math.degrees(angle) * (1 + 1e-12)
    if lat - d_lat <= -90 or lat + d_lat >= 90:
        return lat - d_lat, lat + d_lat, -180.0, 180.0
    d_lng = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) * (1 + 1e-12)
    if lng - d_lng < -180 or lng + d_lng > 180:
        return lat - d_lat, lat + d_lat, -180.0, 180.0
    return lat - d_lat, lat + d_lat, lng - d_lng, lng + d_lng


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    """Coordinates are there and inside ``box``; plain comparisons, so Parquet can skip row groups."""
    return lat.isNotNull() & lng.isNotNull() & lat.between(box[0], box[1]) & lng.between(box[2], box[3])


def cell_index(value: Column, low: float, span: float, bits: int) -> Column:
    """Index of the cell of ``value``; a point on an edge belongs to the lower cell."""
    return F.greatest(F.ceil((value - low) / span * float(1 << bits)) - 1, F.lit(0)).cast("long")


def geohash(lat: Column, lng: Column, precision: int) -> Column:
    """Geohash text of 3 or 4 characters; null where a coordinate is null."""
    lng_bits, lat_bits = BITS[precision]
    x, y = cell_index(lng, -180.0, 360.0, lng_bits), cell_index(lat, -90.0, 180.0, lat_bits)
    bits = []
    for k in range(lng_bits + lat_bits):
        axis, width, place = (x, lng_bits, k // 2) if k % 2 == 0 else (y, lat_bits, k // 2)
        bits.append(F.shiftright(axis, width - 1 - place).bitwiseAND(F.lit(1)))
    letters = []
    for at in range(0, len(bits), 5):
        index = sum((bits[at + j] * (1 << (4 - j)) for j in range(1, 5)), bits[at] * 16)
        letters.append(F.substring(F.lit(BASE32), index.cast("int") + 1, F.lit(1)))
    return F.when(lat.isNotNull() & lng.isNotNull(), F.concat(*letters))


def _index(value: float, low: float, span: float, bits: int) -> int:
    return min(max(math.ceil((value - low) / span * (1 << bits)) - 1, 0), (1 << bits) - 1)


def _text(x: int, y: int, precision: int) -> str:
    lng_bits, lat_bits = BITS[precision]
    bits = [(x >> (lng_bits - 1 - k // 2)) & 1 if k % 2 == 0 else (y >> (lat_bits - 1 - k // 2)) & 1 for k in range(lng_bits + lat_bits)]
    return "".join(BASE32[int("".join(map(str, bits[at : at + 5])), 2)] for at in range(0, len(bits), 5))


def choose_precision(radius_km: float) -> int:
    """Coarse cells for wide circles."""
    return 3 if radius_km > 40 else 4


def cover_cells(lat: float, lng: float, radius_km: float, precision: int, most: int = MOST_CELLS) -> list[str] | None:
    """Geohashes of the cells that meet the circle's box; None beyond ``most``, where a date scan is better."""
    lng_bits, lat_bits = BITS[precision]
    box = bounding_box(lat, lng, radius_km, exact=True)
    ys = range(_index(box[0], -90, 180, lat_bits), _index(box[1], -90, 180, lat_bits) + 1)
    xs = range(_index(box[2], -180, 360, lng_bits), _index(box[3], -180, 360, lng_bits) + 1)
    return [_text(x, y, precision) for y in ys for x in xs] if len(xs) * len(ys) <= most else None
