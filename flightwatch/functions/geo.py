"""Distances, local coordinates and offsets on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flightwatch.schema import EARTH_RADIUS_KM, EARTH_RADIUS_M


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    north = F.sin(F.radians(lat2 - lat1) / 2)
    east = F.sin(F.radians(lon2 - lon1) / 2)
    return north * north + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * east * east


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(_half_chord(lat1, lon1, lat2, lon2)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = _half_chord(lat1, lon1, lat2, lon2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def local_north_m(lat: Column, lat0: Column) -> Column:
    return F.radians(lat - lat0) * F.lit(EARTH_RADIUS_M)


def local_east_m(lon: Column, lon0: Column, lat0: Column) -> Column:
    return F.radians(lon - lon0) * F.lit(EARTH_RADIUS_M) * F.cos(F.radians(lat0))


def offset_position(lat: Column, lon: Column, north_m: Column, east_m: Column) -> tuple[Column, Column]:
    return (lat + F.degrees(north_m / F.lit(EARTH_RADIUS_M)),
            lon + F.degrees(east_m / (F.lit(EARTH_RADIUS_M) * F.cos(F.radians(lat)))))


def in_box(lat: Column, lon: Column, lat_min, lat_max, lon_min, lon_max) -> Column:
    """Inclusive on all sides."""
    return lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max)
