"""Geometry as columns: points are (x, y) pairs, rings arrays of structs, boxes four numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
#: Metres in a unit of length.
METRES = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.344, "nmi": 1852.0, "yd": 0.9144}


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres; up to 0.5 % off the ellipsoid."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * EARTH_M)


def in_box(x: Column, y: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Half-open, so that a point on a shared edge lies in one box."""
    return (x >= xmin) & (x < xmax) & (y >= ymin) & (y < ymax)


def _next_vertices(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray-cast parity over the edges of a closed ring (first vertex not repeated). Points on an edge are undecided."""
    crossed = F.zip_with(
        ring, _next_vertices(ring),
        lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(1e-300)).otherwise(b["y"] - a["y"]) + a["x"]), 1).otherwise(0),
    )
    return F.aggregate(crossed, F.lit(0), lambda s, v: s + v) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Shoelace area in square units of the coordinates."""
    parts = F.zip_with(ring, _next_vertices(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)) / 2


def ring_length(ring: Column) -> Column:
    parts = F.zip_with(ring, _next_vertices(ring), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Area centroid of a ring that isn't degenerate."""
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    total = F.aggregate(F.zip_with(ring, _next_vertices(ring), cross), F.lit(0.0), lambda s, v: s + v)
    cx = F.aggregate(F.zip_with(ring, _next_vertices(ring), lambda a, b: (a["x"] + b["x"]) * cross(a, b)), F.lit(0.0), lambda s, v: s + v)
    cy = F.aggregate(F.zip_with(ring, _next_vertices(ring), lambda a, b: (a["y"] + b["y"]) * cross(a, b)), F.lit(0.0), lambda s, v: s + v)
    return cx / (total * 3), cy / (total * 3)


def utm_xy(lon: Column, lat: Column, central: Column) -> tuple[Column, Column]:
    """Metres east and north in the transverse Mercator zone of ``central`` (Krueger series of third order, WGS84)."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - central)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * big * x, F.when(lat < 0, 1e7).otherwise(0.0) + 0.9996 * big * y


def utm_central(mean_lon: float) -> float:
    """The central meridian of the zone that holds a longitude."""
    return (int((mean_lon + 180) // 6) % 60) * 6 - 177.0


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Mercator metres."""
    r = 6378137.0
    return r * F.radians(lon), r * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - 1.5707963267948966)


def square_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    return F.floor(x / size), F.floor(y / size)


def hex_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """(row, column) of the pointy-top hexagon with width ``size``: the nearer centre of the two rows about a point.

    Rows are 1.5 R apart, odd rows are moved by half a width; numbers are rounded half to even.
    """
    rise = 1.5 * size / 3**0.5
    low = F.floor(y / rise)

    def centre(row: Column) -> tuple[Column, Column]:
        moved = F.pmod(row, F.lit(2)) * (size / 2)
        column = F.rint((x - moved) / size)
        dx, dy = x - (column * size + moved), y - row * rise
        return column, dx * dx + dy * dy

    (c0, d0), (c1, d1) = centre(low), centre(low + 1)
    nearer = d1 < d0
    return F.when(nearer, low + 1).otherwise(low).cast("long"), F.when(nearer, c1).otherwise(c0).cast("long")


def hex_area(size: float) -> float:
    return 3**0.5 / 2 * size * size


def dms_to_degrees(text: Column) -> Column:
    """Decimal degrees from decimal or degree-minute-second text with an optional hemisphere letter; else null."""
    t = F.trim(F.upper(text))
    number = r"(\d+(?:\.\d+)?)"
    pattern = rf"^([-+]?){number}(?:[°\s]+{number}(?:['′\s]+(?:{number}[\"″]?)?)?)?\s*°?\s*([NSEW]?)$"
    part = lambda k: F.coalesce(F.regexp_extract(t, pattern, k).try_cast("double"), F.lit(0.0))
    size = part(2) + part(3) / 60 + part(4) / 3600
    negative = (F.regexp_extract(t, pattern, 1) == "-") | F.regexp_extract(t, pattern, 5).isin("S", "W")
    return F.when(t.rlike(pattern), F.when(negative, -size).otherwise(size))


def convert_length(value: Column, source: Column, target: Column) -> Column:
    """The value in another unit of length, null for units that aren't known."""
    factors = F.create_map(*[F.lit(x) for pair in METRES.items() for x in pair])
    return value * F.try_element_at(factors, source) / F.try_element_at(factors, target)


def plausible_lonlat(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Whether bounds look like degrees of longitude and latitude."""
    return (xmin >= -180) & (xmax <= 180) & (ymin >= -90) & (ymax <= 90) & (xmin <= xmax) & (ymin <= ymax)


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (xmin, ymin, xmax, ymax); 0 where both are empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.coalesce(w * h / F.nullif(union, F.lit(0.0)), F.lit(0.0))
