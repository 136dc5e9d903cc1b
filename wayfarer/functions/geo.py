"""Distances, projections and spatial keys as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6_371_000.0
#: Cell of the point index in degrees of latitude and longitude.
CELL_LAT, CELL_LON = 0.0045, 0.006


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on a sphere."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def along(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column, cos_lat: Column) -> Column:
    """Place of a point's projection on a segment, 0 to 1; 0 where the segment has no length."""
    dx, dy = (lon2 - lon1) * cos_lat, lat2 - lat1
    px, py = (lon - lon1) * cos_lat, lat - lat1
    length = dx * dx + dy * dy
    t = (px * dx + py * dy) / length
    return F.when(length < 1e-20, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def between(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.floor(lat / F.lit(CELL_LAT)).cast("int"), F.floor(lon / F.lit(CELL_LON)).cast("int")


def around(cell_lat: Column, cell_lon: Column) -> Column:
    """The 3 x 3 cells around one, as an array of (y, x)."""
    return F.flatten(F.transform(F.sequence(cell_lat - 1, cell_lat + 1), lambda y: F.transform(F.sequence(cell_lon - 1, cell_lon + 1), lambda x: F.struct(y.alias("y"), x.alias("x")))))


def morton(x: Column, y: Column) -> Column:
    """Interleaved bits of two 16-bit numbers, those of x first."""

    def spread(v: Column) -> Column:
        v = v.cast("long").bitwiseAND(F.lit(0xFFFF))
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def fixed(value: Column, least: Column, scale: float) -> Column:
    """Fixed-point number of a coordinate above ``least``."""
    return F.round((value - least) * F.lit(scale)).cast("int")


def unfixed(number: Column, least: Column, scale: float) -> Column:
    return least + number / F.lit(scale)


def mercator(lat: Column, lon: Column, scale: float) -> tuple[Column, Column]:
    """Web-Mercator pixels at 256 * 2 ** zoom = ``scale``."""
    y = F.lit(0.5) - F.ln(F.tan(F.lit(math.pi / 4) + lat * F.lit(math.pi) / 360)) / F.lit(2 * math.pi)
    return F.lit(scale) * (lon / 360 + F.lit(0.5)), F.lit(scale) * y


def dot_size(zoom: int) -> float:
    """Pixels of a node's dot: five metres, or 2 to 6 by zoom if that is more."""
    metres = 40_075_016 / (256 * 2**zoom)
    return max(5 / metres, max(2, min(6, 14 - zoom)))
