"""Great-circle distance and travel speed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.numeric import round_dp

EARTH_RADIUS_KM = 6371.0


def raw_haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Unrounded distance in km; 0.0 when a coordinate is unknown."""
    dlat = F.radians(lat2 - lat1) / 2
    dlng = F.radians(lng2 - lng1) / 2
    a = (F.sin(dlat) * F.sin(dlat)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng) * F.sin(dlng))
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    km = F.lit(2.0 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))
    return F.coalesce(km, F.lit(0.0))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Distance in km, 3 places; 0.0 when a coordinate is unknown."""
    return round_dp(raw_haversine_km(lat1, lng1, lat2, lng2), 3)


def known_location(lat: Column, lng: Column) -> Column:
    """True when both coordinates are present (NaN counts as absent)."""
    return lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng)
