"""Distances between coordinates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in kilometres.
EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in km; null when a coordinate is. The chord is held at 1 so antipodes
    stay defined (not with ``least``, which would skip a null)."""
    dlat = F.sin(F.radians(lat2 - lat1) / 2)
    dlng = F.sin(F.radians(lng2 - lng1) / 2)
    chord = dlat * dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlng * dlng
    held = F.when(chord > 1, 1.0).otherwise(chord)
    return F.asin(F.sqrt(held)) * (2 * EARTH_RADIUS_KM)


def located(df, lat="lat", lng="lng"):
    """Rows that have both coordinates."""
    return df.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull())
