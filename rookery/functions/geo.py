"""Positions: validation, boxes and distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rookery.functions.sphere import RADIUS_M


def require_position(lat: float, lon: float) -> None:
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):
        raise ValueError(f"no position: {lat}, {lon}")


def is_position(lat: Column, lon: Column) -> Column:
    """False for a missing coordinate, NaN, or one out of range."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside (south, west, north, east), all sides included; a missing coordinate is outside."""
    return F.coalesce(lat.between(box[0], box[2]) & lon.between(box[1], box[3]), F.lit(False))


def haversine_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle metres."""
    h = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), F.lit(2)) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), F.lit(2))
    return 2 * RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
