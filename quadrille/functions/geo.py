"""Coordinates and grids, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; the half-chord is held within 0 and 1."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def equirectangular(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """(x, y) metres from an origin; the east-west scale follows each point's own latitude."""
    return (lon - lon0) * METRES_PER_DEGREE * F.cos(F.radians(lat)), (lat - lat0) * METRES_PER_DEGREE


def is_geographic(x: Column) -> Column:
    """Aggregate: coordinates are degrees if none is beyond 181."""
    return F.max(F.abs(x)) <= 181


def cell_of(x: Column, side: float | Column) -> Column:
    """Grid index. Floor in all engines: a cast would truncate or round."""
    return F.floor(x / side).cast("bigint")


def block_id(gx: Column, gy: Column, rows: Column) -> Column:
    """One number for a block; ``rows`` is the largest gy plus one."""
    return gx * rows + gy


def edge_distance(x: Column, y: Column, side: float) -> Column:
    """Distance to the border of the own block."""
    dx, dy = x - F.floor(x / side) * side, y - F.floor(y / side) * side
    return F.least(dx, side - dx, dy, side - dy)


def pixel_position(row: Column, col: Column, lon0: float, lat0: float, lon_step: float, lat_step: float) -> tuple[Column, Column]:
    """(lon, lat) of a pixel under an affine transform without rotation."""
    return F.lit(lon0) + col * lon_step, F.lit(lat0) + row * lat_step


def parent_pixel(row: Column, col: Column, factor: int, width: int) -> Column:
    """Row-major index of the coarse pixel that holds a fine one."""
    return F.floor(row / factor).cast("bigint") * width + F.floor(col / factor).cast("bigint")
