"""Planar geometry and the Albers projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GRS80, and the conterminous Albers equal-area projection (EPSG:5070).
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
PARALLELS = (29.5, 45.5)
ORIGIN = (-96.0, 23.0)

E2 = FLATTENING * (2 - FLATTENING)
ECC = math.sqrt(E2)


def _q(phi: float) -> float:
    s = math.sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - ECC * s) / (1 + ECC * s)) / (2 * ECC))


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2)


_P1, _P2 = (math.radians(x) for x in PARALLELS)
CONE = (_m(_P1) ** 2 - _m(_P2) ** 2) / (_q(_P2) - _q(_P1))
SHIFT = _m(_P1) ** 2 + CONE * _q(_P1)
RHO0 = SEMI_MAJOR * math.sqrt(SHIFT - CONE * _q(math.radians(ORIGIN[1]))) / CONE


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to metres, ellipsoidal forward formulas."""
    s = F.sin(F.radians(lat))
    q = (F.lit(1.0) - E2) * (s / (F.lit(1.0) - F.lit(E2) * s * s) - F.log((F.lit(1.0) - F.lit(ECC) * s) / (F.lit(1.0) + F.lit(ECC) * s)) / (2 * ECC))
    rho = F.lit(SEMI_MAJOR) * F.sqrt(F.lit(SHIFT) - F.lit(CONE) * q) / CONE
    theta = F.lit(CONE) * F.radians(lon - ORIGIN[0])
    return rho * F.sin(theta), F.lit(RHO0) - rho * F.cos(theta)


def albers_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Metres to degrees, by the authalic latitude's series."""
    dy = F.lit(RHO0) - y
    rho = F.hypot(x, dy)
    theta = F.atan2(x, dy)
    q = (F.lit(SHIFT) - (rho * F.lit(CONE / SEMI_MAJOR)) * (rho * F.lit(CONE / SEMI_MAJOR))) / CONE
    beta = F.asin(q / _q(math.pi / 2))
    e4, e6 = E2 * E2, E2**3
    phi = beta + F.lit(E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + F.lit(23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + F.lit(761 * e6 / 45360) * F.sin(6 * beta)
    return F.lit(ORIGIN[0]) + F.degrees(theta / CONE), F.degrees(phi)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment, the foot clamped to its ends."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.try_divide((px - ax) * dx + (py - ay) * dy, length))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def polyline_distance(px: Column, py: Column, line: Column) -> Column:
    """From a point to a polyline, an array of structs x, y with two vertices or more."""
    steps = F.sequence(F.lit(1), F.size(line) - 1)
    at = lambda i: line[i]
    return F.array_min(F.transform(steps, lambda i: segment_distance(px, py, at(i - 1)["x"], at(i - 1)["y"], at(i)["x"], at(i)["y"])))


def ring_moments(ring: Column) -> Column:
    """Struct a, mx, my of a closed ring (array of structs x, y): twice its signed area and its first moments, about its first vertex.

    The ring is bound to a lambda's variable: an expression would be made anew at each vertex.
    """
    return F.transform(F.array(ring), _moments)[0]


def _moments(ring: Column) -> Column:
    first = ring[0]
    steps = F.sequence(F.lit(1), F.size(ring) - 1)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(s: Column, i: Column) -> Column:
        x0, y0 = ring[i - 1]["x"] - first["x"], ring[i - 1]["y"] - first["y"]
        x1, y1 = ring[i]["x"] - first["x"], ring[i]["y"] - first["y"]
        cross = x0 * y1 - x1 * y0
        return F.struct((s["a"] + cross).alias("a"), (s["mx"] + (x0 + x1) * cross).alias("mx"), (s["my"] + (y0 + y1) * cross).alias("my"))

    return F.when(F.size(ring) >= 4, F.aggregate(steps, zero, add))


def ring_point(ring: Column) -> Column:
    """Struct x, y: the area-weighted centroid; nulls for a ring without area or with fewer than four vertices.

    Ring and moments are bound to lambdas' variables, so that they are computed once.
    """
    return F.transform(F.array(ring), _point)[0]


def _point(ring: Column) -> Column:
    first = ring[0]
    return F.transform(
        F.array(_moments(ring)),
        lambda m: F.struct((first["x"] + F.try_divide(m["mx"], 3 * m["a"])).alias("x"), (first["y"] + F.try_divide(m["my"], 3 * m["a"])).alias("y")),
    )[0]


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Coordinates of ring_point()."""
    point = ring_point(ring)
    return point["x"], point["y"]


def polygon_centroid(rings: Column) -> tuple[Column, Column]:
    """Centroid of polygons given as an array of rings; holes run the other way round and subtract."""
    kept = F.filter(rings, lambda r: F.size(r) >= 4)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, r: Column) -> Column:
        m, first = ring_moments(r), r[0]
        return F.struct(
            (s["a"] + m["a"]).alias("a"), (s["x"] + m["a"] * first["x"] + m["mx"] / 3).alias("x"), (s["y"] + m["a"] * first["y"] + m["my"] / 3).alias("y")
        )

    s = F.aggregate(kept, zero, add)
    return F.try_divide(s["x"], s["a"]), F.try_divide(s["y"], s["a"])


def _orientation(p: Column, q: Column, r: Column) -> Column:
    return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))


def ring_valid(ring: Column) -> Column:
    """Closed, four vertices or more, with area, and no two of its segments that aren't neighbours cross or touch.

    The ring is bound to a lambda's variable, so that it is made once; segments whose boxes are apart aren't tested.
    """
    return F.transform(F.array(ring), _ring_valid)[0]


def _ring_valid(ring: Column) -> Column:
    n = F.size(ring) - 1
    at = lambda i: ring[i]

    def cross(i: Column, j: Column) -> Column:
        a, b, c, d = at(i), at(i + 1), at(j), at(j + 1)
        apart = F.lit(False)
        for v in "xy":
            apart = apart | (F.greatest(a[v], b[v]) < F.least(c[v], d[v])) | (F.greatest(c[v], d[v]) < F.least(a[v], b[v]))
        return ~apart & (_orientation(a, b, c) * _orientation(a, b, d) <= 0) & (_orientation(c, d, a) * _orientation(c, d, b) <= 0)

    pairs = F.exists(
        F.sequence(F.lit(0), n - 3), lambda i: F.exists(F.sequence(i + 2, n - 1), lambda j: ~((i == 0) & (j == n - 1)) & cross(i, j))
    )
    crossing = F.when(F.size(ring) >= 5, pairs).otherwise(F.lit(False))
    closed = (at(0)["x"] == at(n)["x"]) & (at(0)["y"] == at(n)["y"])
    return F.coalesce(F.when(F.size(ring) >= 4, closed & (_moments(ring)["a"] != 0) & ~crossing), F.lit(False))


def inside(lon: Column, lat: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Strictly inside the box west, south, east, north; false for a missing point."""
    west, south, east, north = bounds
    return F.coalesce((lon > west) & (lon < east) & (lat > south) & (lat < north), F.lit(False))


def pixel(x: Column, y: Column, affine: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """(row, col) of a north-up grid: affine is pixel width, left, pixel height (negative), top."""
    a, c, e, f = affine
    return F.floor((y - f) / e).cast("int"), F.floor((x - c) / a).cast("int")


def patch_box(lon: Column, lat: Column, buffer: float = 0.001) -> Column:
    return F.struct((lon - buffer).alias("west"), (lat - buffer).alias("south"), (lon + buffer).alias("east"), (lat + buffer).alias("north"))


def to_raster(lon: Column, lat: Column, crs: int) -> tuple[Column, Column]:
    """Degrees to the coordinates of a raster in EPSG 4326 or 5070; another system is an error."""
    if crs == 4326:
        return lon, lat
    if crs == 5070:
        return albers(lon, lat)
    raise ValueError(f"unknown reference system {crs}")


def pixel_size(affine: tuple[float, float, float, float]) -> float:
    """Width of a pixel."""
    return abs(affine[0])
