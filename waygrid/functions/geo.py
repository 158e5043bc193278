"""Geodesy and planar geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres: mean radius that all distances use.
RADIUS = 6_371_000.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def distance_3d(lon1: Column, lat1: Column, z1: Column, lon2: Column, lat2: Column, z2: Column) -> Column:
    """Slant distance; a missing height counts as level."""
    flat, rise = haversine(lon1, lat1, lon2, lat2), F.coalesce(z2 - z1, F.lit(0.0))
    return F.sqrt(flat * flat + rise * rise)


def planar(lon0: Column, lat0: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * RADIUS, F.radians(lat - lat0) * RADIUS


def heading(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    x, y = planar(lon1, lat1, lon2, lat2)
    return F.pmod(F.degrees(F.atan2(x, y)), F.lit(360.0))


def along_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """(fraction, distance) of the nearest point of a planar segment."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    raw = ((px - ax) * dx + (py - ay) * dy) / F.nullif(square, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw, F.lit(0.0))))
    return t, F.hypot(px - ax - t * dx, py - ay - t * dy)


def point_in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Ray casting; ring is an array of (x, y) structs, closed or not."""
    n = F.size(ring)
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1)).alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.size(F.filter(pairs, crosses)) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Signed shoelace area."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(ring, i)["x"] * F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))["y"] - F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))["x"] * F.element_at(ring, i)["y"])
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Web Mercator tile numbers."""
    n = float(1 << zoom)
    y = (1 - F.ln(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / F.lit(3.141592653589793)) / 2 * n
    return F.floor((lon + 180) / 360 * n), F.floor(y)


def turn_angle(heading_in: Column, heading_out: Column) -> Column:
    """Positive to the left, from -180 to 180."""
    return F.lit(180.0) - F.pmod(heading_out - heading_in + 180.0, F.lit(360.0))


def turn_class(angle: Column, straight: float = 30.0, reverse: float = 150.0) -> Column:
    return F.when(F.abs(angle) <= straight, "straight").when(F.abs(angle) >= reverse, "u_turn").when(angle > 0, "left").otherwise("right")
