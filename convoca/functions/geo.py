"""Great-circle distances in kilometres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = EARTH_KM * 3.141592653589793 / 180


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    lat1, lng1, lat2, lng2 = (c.cast("double") for c in (lat1, lng1, lat2, lng2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def law_of_cosines_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Spherical law of cosines.

    Rounding can push the cosine of a zero angle just over 1, where ``acos`` is
    undefined, so it is clamped: a place is always at distance 0 from itself.
    """
    lat1, lng1, lat2, lng2 = (F.radians(c.cast("double")) for c in (lat1, lng1, lat2, lng2))
    cosine = F.cos(lat1) * F.cos(lat2) * F.cos(lng2 - lng1) + F.sin(lat1) * F.sin(lat2)
    return EARTH_KM * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))
