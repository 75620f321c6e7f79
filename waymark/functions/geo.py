"""Distances and walking estimates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_000.0
#: Fixed values of the service area: least and greatest latitude and longitude, inclusive.
SERVICE_AREA = (15.40, 16.35, 107.90, 108.65)
WALK_METRES_PER_MINUTE = 75.0


def valid_coordinate(lat: Column, lng: Column) -> Column:
    """True for finite numbers in range; null and NaN are invalid."""
    fine = ~F.isnan(lat) & ~F.isnan(lng) & lat.between(-90, 90) & lng.between(-180, 180)
    return F.coalesce(fine, F.lit(False))


def half_up(value: Column, step: float = 1.0) -> Column:
    """Round to a multiple of 1 / ``step``, halves towards plus infinity."""
    return F.floor(value * step + 0.5) / step


def exact_haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lng) * F.sin(half_lng)
    return 2 * EARTH_METRES * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres to 0.1, or null if a coordinate is invalid."""
    fine = valid_coordinate(lat1, lng1) & valid_coordinate(lat2, lng2)
    return F.when(fine, half_up(exact_haversine(lat1, lng1, lat2, lng2), 10.0))


def in_service_area(lat: Column, lng: Column, area: tuple[float, float, float, float] = SERVICE_AREA) -> Column:
    return valid_coordinate(lat, lng) & lat.between(area[0], area[1]) & lng.between(area[2], area[3])


def point_to_segment(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """struct<metres, t>: distance to a segment on a local plane, and how far along it the nearest point lies (0 to 1)."""
    wide, high = 111_320.0 * F.cos(F.radians(lat)), 110_540.0
    x1, y1, x2, y2 = (lng1 - lng) * wide, (lat1 - lat) * high, (lng2 - lng) * wide, (lat2 - lat) * high
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x1 * dx + y1 * dy) / F.nullif(square, F.lit(0.0)))))
    x, y = x1 + t * dx, y1 + t * dy
    return F.struct(F.sqrt(x * x + y * y).alias("metres"), t.alias("t"))


def walking_minutes(metres: Column) -> Column:
    """At least one minute, whole minutes at walking speed."""
    return F.greatest(F.lit(1), half_up(half_up(metres) / WALK_METRES_PER_MINUTE).cast("int"))


def confidence_penalty(verified: Column, total: Column) -> Column:
    """0 from 80 % of verified places, 2.5 from 60 %, else 5; 0 without figures."""
    share = F.try_divide(verified.cast("double"), total.cast("double"))
    return F.when(share.isNull() | (share >= 0.8), F.lit(0.0)).when(share >= 0.6, F.lit(2.5)).otherwise(F.lit(5.0))


def fallback_position(key: Column) -> tuple[Column, Column]:
    """A made-up position inside the service area for tables without coordinates."""
    return F.lit(15.40) + (key * 37 % 9500) / F.lit(10000.0), F.lit(107.90) + (key * 53 % 7500) / F.lit(10000.0)


#: Latitudes under which places lie in the southern province, and in its far south; words of streets there; names of the localities.
SOUTH, FAR_SOUTH = 15.90, 15.65
OLD_TOWN, FAR_TOWNS = ("hội an", "cửa đại"), ("tam kỳ", "núi thành")
LOCALITIES = ("Hội An, Quảng Nam, Việt Nam", "Tam Kỳ, Quảng Nam, Việt Nam", "Quảng Nam, Việt Nam", "Đà Nẵng, Việt Nam")


def locality(lat: Column, street: Column) -> Column:
    """The name of the locality by latitude and street."""
    words = F.lower(F.coalesce(street, F.lit("")))
    has = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: words.contains(n))
    south = F.when(has(OLD_TOWN), F.lit(LOCALITIES[0])).when(has(FAR_TOWNS) | (lat <= FAR_SOUTH), F.lit(LOCALITIES[1])).otherwise(F.lit(LOCALITIES[2]))
    return F.when(F.coalesce(lat < SOUTH, F.lit(False)), south).otherwise(F.lit(LOCALITIES[3]))


def bounds(lat: Column | str = "lat", lng: Column | str = "lng") -> list[Column]:
    """Aggregates for the box around points: south, west, north, east; points without valid coordinates do not count."""
    y, x = (F.col(c) if isinstance(c, str) else c for c in (lat, lng))
    fine = valid_coordinate(y, x)
    return [f(F.when(fine, c)).alias(n) for n, f, c in (("south", F.min, y), ("west", F.min, x), ("north", F.max, y), ("east", F.max, x))]
