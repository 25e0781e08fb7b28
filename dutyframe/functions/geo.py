"""Coordinates and distances as native expressions."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius and kilometres of a degree, the widest radius, the limits of Attica.
EARTH_KM, DEGREE_KM, MAX_RADIUS_KM = 6371.0, 111.0, 50.0
ATTICA = (37.5, 38.4, 23.0, 24.2)


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance (haversine)."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bounding_box(lat: float, lon: float, radius_km: float) -> tuple[float, float, float, float]:
    """(south, north, west, east) around a point, computed once on the driver, so that the limits reach the scan."""
    import math

    radius = min(max(radius_km, 0.0), MAX_RADIUS_KM)
    high = radius / DEGREE_KM
    wide = radius / (DEGREE_KM * max(abs(math.cos(math.radians(lat))), 0.01))
    return lat - high, lat + high, lon - wide, lon + wide


def valid_point(lat: Column, lon: Column) -> Column:
    """struct(lat, lon), null where a coordinate is out of range."""
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def point_of_map_link(href: Column) -> Column:
    """The `query=lat,lon` of a map link, the comma possibly percent-encoded."""
    query = F.regexp_replace(F.regexp_extract(href, r"query=([^&]*)", 1), "(?i)%2C", ",")
    return valid_point(_number(F.regexp_extract(query, r"^([^,]*),(.*)$", 1)), _number(F.regexp_extract(query, r"^([^,]*),(.*)$", 2)))


def point_of_wkt(text: Column) -> Column:
    """`Point(lon lat)`, longitude first."""
    pattern = r"^Point\(([^ )]+) ([^ )]+)\)$"
    return valid_point(_number(F.regexp_extract(text, pattern, 2)), _number(F.regexp_extract(text, pattern, 1)))


def in_attica(lat: Column, lon: Column) -> Column:
    south, north, west, east = ATTICA
    return lat.between(south, north) & lon.between(west, east)


def read_point(text: str) -> tuple[float, float]:
    """`lat,lon` of an API argument."""
    found = re.fullmatch(r"\s*([^,]+?)\s*,\s*([^,]+?)\s*", text)
    try:
        lat, lon = (float(x) for x in found.groups())
    except (AttributeError, ValueError):
        raise ValueError(f"expected `lat,lon`, got {text!r}") from None
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):
        raise ValueError(f"coordinates out of range: {text!r}")
    return lat, lon


def read_date(text: str) -> date:
    try:
        return date.fromisoformat(text)
    except ValueError:
        raise ValueError(f"expected a date as YYYY-MM-DD, got {text!r}") from None
