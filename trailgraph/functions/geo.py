"""Coordinate expressions: everything here is a Column built from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres (IUGG), as public geometry libraries use it.
EARTH_RADIUS_M = 6371008.8


def haversine_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in metres of two points in degrees."""
    half_lat = F.sin(F.radians(lat_b - lat_a) / 2)
    half_lon = F.sin(F.radians(lon_b - lon_a) / 2)
    inner = F.pow(half_lat, F.lit(2)) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(half_lon, F.lit(2))
    return F.asin(F.sqrt(inner)) * (2 * EARTH_RADIUS_M)


def to_e7(degrees: Column) -> Column:
    """Degrees as whole ten-millionths; the rest is cut off."""
    return (degrees * F.lit(1e7)).cast("int")


def from_e7(value: Column) -> Column:
    """Degrees of a stored coordinate, by division (points of all kinds)."""
    return value / F.lit(1e7)


def from_e7_scaled(value: Column) -> Column:
    """Degrees of a stored coordinate, by multiplication (ends of edges); the last bit may differ from ``from_e7``."""
    return value * F.lit(1e-7)


def cell(degrees: Column, step: float) -> Column:
    """Number of the grid cell of a coordinate."""
    return F.floor(degrees / F.lit(step)).cast("long")


def space_order(lat_e7: Column, lon_e7: Column) -> Column:
    """Place of a stored coordinate along a Z-order curve: what has near numbers is near."""

    def spread(value: Column) -> Column:
        """A free bit beside each of 31."""
        for shift in (16, 8, 4, 2, 1):
            mask = (1 << 64) // ((1 << shift) + 1)  # runs of ``shift`` ones, each followed by as many zeros
            value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask & ((1 << 63) - 1)))
        return value

    north = F.shiftright(lat_e7.cast("long") + 900_000_000, 1)
    east = F.shiftright(lon_e7.cast("long") + 1_800_000_000, 1)
    return spread(north).bitwiseOR(F.shiftleft(spread(east), 1))


def in_bbox(lat: Column, lon: Column, bbox: tuple[float, float, float, float]) -> Column:
    """Closed box (min_lon, min_lat, max_lon, max_lat)."""
    min_lon, min_lat, max_lon, max_lat = bbox
    return lat.between(min_lat, max_lat) & lon.between(min_lon, max_lon)


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """``minlon,minlat,maxlon,maxlat``."""
    parts = text.split(",")
    if len(parts) != 4:
        raise ValueError(f"bounding box needs four comma-separated numbers, got {text!r}")
    try:
        min_lon, min_lat, max_lon, max_lat = (float(p.strip()) for p in parts)
    except ValueError as error:
        raise ValueError(f"bounding box has a part that is no number: {text!r}") from error
    return min_lon, min_lat, max_lon, max_lat


def degree_distance(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Squared distance in degrees: the order in which nearest points are searched."""
    return (lat_a - lat_b) * (lat_a - lat_b) + (lon_a - lon_b) * (lon_a - lon_b)
