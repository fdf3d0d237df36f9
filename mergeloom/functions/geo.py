"""Distances and centres on the sphere, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), s)))


def centre(lat: str, lon: str) -> list[Column]:
    """Aggregates ``c_lat`` and ``c_lon``: the direction of the mean of the unit vectors. It holds across the date line."""
    a, b = F.radians(lat), F.radians(lon)
    x, y, z = F.avg(F.cos(a) * F.cos(b)), F.avg(F.cos(a) * F.sin(b)), F.avg(F.sin(a))
    return [F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("c_lat"), F.degrees(F.atan2(y, x)).alias("c_lon")]


def absent(lat: Column, lon: Column) -> Column:
    """Coordinates that say nothing: null, out of range, or exactly (0, 0)."""
    return lat.isNull() | lon.isNull() | ((lat == 0) & (lon == 0)) | (F.abs(lat) > 90) | (F.abs(lon) > 180)


def cells(lat: Column, lon: Column, size: float, wrap: bool = True) -> Column:
    """The nine grid cells around a point, as an array of (cy, cx); longitudes wrap around."""
    cy, cx = F.floor(lat / size), F.floor(lon / size)
    n = int(360 / size)
    near = []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            x = F.pmod(cx + dx, F.lit(n)) if wrap else cx + dx
            near.append(F.struct((cy + dy).alias("cy"), x.alias("cx")))
    return F.array(*near)


def cell(lat: Column, lon: Column, size: float, wrap: bool = True) -> tuple[Column, Column]:
    cx = F.floor(lon / size)
    return F.floor(lat / size).alias("cy"), (F.pmod(cx, F.lit(int(360 / size))) if wrap else cx).alias("cx")
