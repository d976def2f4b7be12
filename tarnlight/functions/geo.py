"""Points [lon, lat] in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the earth's radius in metres that distances are worked out with.
RADIUS = 6_372_797.560856


def lon(p: Column) -> Column:
    return F.get(p, F.lit(0)).cast("double")


def lat(p: Column) -> Column:
    return F.get(p, F.lit(1)).cast("double")


def checked(p: Column) -> Column:
    """p, or an error where it's no point on the earth."""
    fine = (F.size(p) == 2) & lon(p).between(-180, 180) & lat(p).between(-90, 90)
    return F.when(p.isNull() | fine, p).otherwise(F.raise_error(F.lit("a point is [longitude, latitude] in degrees")).cast("array<double>"))


def distance(p: Column, q: Column) -> Column:
    """Metres along a great circle; null where a point is missing."""
    dlat, dlon = F.radians(lat(q) - lat(p)), F.radians(lon(q) - lon(p))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat(p))) * F.cos(F.radians(lat(q))) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * RADIUS) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def within(p: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside [west, south, east, north], edges too; a box with west > east crosses the antimeridian."""
    west, south, east, north = (float(x) for x in box)
    across = lon(p).between(west, east) if west <= east else (lon(p) >= west) | (lon(p) <= east)
    return F.coalesce(lat(p).between(south, north) & across, F.lit(False))


def box_around(center: tuple[float, float], metres: float) -> tuple[float, float, float, float] | None:
    """A box that holds the circle, for a cheap first test; None where it would hold a pole."""
    import math

    x, y = center
    dy = math.degrees(metres / RADIUS) * (1 + 1e-9) + 1e-9
    if y + dy >= 90 or y - dy <= -90:
        return None
    dx = math.degrees(math.asin(min(1.0, math.sin(min(math.pi / 2, metres / RADIUS)) / math.cos(math.radians(y))))) * (1 + 1e-9) + 1e-9
    if dx >= 180:
        return None
    wrap = lambda v: (v + 180) % 360 - 180
    return wrap(x - dx), y - dy, wrap(x + dx), y + dy
