"""Distance columns (F3 planar kilometres, F4 great-circle miles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kilometres per degree for the planar feature, earth radius in miles.
KM_PER_DEGREE = 111.32
EARTH_RADIUS_MILES = 3958.8


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def planar_distance_km(
    lat: str | Column = "lat",
    lon: str | Column = "long",
    merch_lat: str | Column = "merch_lat",
    merch_lon: str | Column = "merch_long",
) -> Column:
    """Equirectangular distance used as a model feature (no antimeridian wrap)."""
    dlat = _col(lat) - _col(merch_lat)
    dlon = (_col(lon) - _col(merch_lon)) * F.cos(F.radians(_col(lat)))
    return F.sqrt(F.pow(dlat, 2) + F.pow(dlon, 2)) * F.lit(KM_PER_DEGREE)


def great_circle_miles(
    lat1: str | Column = "lat",
    lon1: str | Column = "long",
    lat2: str | Column = "merch_lat",
    lon2: str | Column = "merch_long",
) -> Column:
    """Haversine distance in miles: 2R * atan2(sqrt(a), sqrt(1 - a))."""
    dlat = F.radians(_col(lat2) - _col(lat1))
    dlon = F.radians(_col(lon2) - _col(lon1))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(_col(lat1))) * F.cos(
        F.radians(_col(lat2))
    ) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_MILES) * F.atan2(F.sqrt(a), F.sqrt(1 - a))
