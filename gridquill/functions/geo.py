"""Geometry as Column expressions: distances, areas, cells of a grid, polygon tests, clipping, projections.

An area is a list of rings, each a list of (lon, lat) corners; several rings are read even-odd, so holes
and several parts need nothing more.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
MERCATOR_M = 6378137.0
#: Kilometres of a degree north-south and east-west in planar areas, the same at every latitude.
KM_NORTH, KM_EAST = 111.0, 108.0
#: Edges up to which a polygon test is one generated expression; longer rings are tested by a loop over an array.
UNROLLED_EDGES = 64

Ring = Sequence[tuple[float, float]]


def number(x: float) -> Column:
    return F.lit(float(x))


def edges_of(rings: Sequence[Ring]) -> list[tuple[float, float, float, float]]:
    """(x1, y1, x2, y2) of every side; a ring may or may not repeat its first corner at its end."""
    out = []
    for ring in rings:
        corners = [(float(x), float(y)) for x, y in ring]
        if corners[0] != corners[-1]:
            corners.append(corners[0])
        out += [(*a, *b) for a, b in zip(corners[:-1], corners[1:])]
    return out


def bounds_of(rings: Sequence[Ring]) -> tuple[float, float, float, float]:
    """(min lon, min lat, max lon, max lat)."""
    xs, ys = zip(*(c for ring in rings for c in ring))
    return float(min(xs)), float(min(ys)), float(max(xs)), float(max(ys))


def box_ring(min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> list[tuple[float, float]]:
    return [(min_lon, min_lat), (max_lon, min_lat), (max_lon, max_lat), (min_lon, max_lat)]


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float], margin: float = 0.0) -> Column:
    """Plain comparisons, which reach a Parquet scan where lon and lat are its columns."""
    x1, y1, x2, y2 = box
    return lon.between(number(x1 - margin), number(x2 + margin)) & lat.between(number(y1 - margin), number(y2 + margin))


def _crosses(lon: Column, lat: Column, x1, y1, x2, y2) -> Column:
    """Whether a ray to the east from the point crosses a side."""
    return ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)


def _touches(lon: Column, lat: Column, x1, y1, x2, y2) -> Column:
    """Whether the point lies on a side."""
    across = (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)
    return (across == 0) & lon.between(F.least(x1, x2), F.greatest(x1, x2)) & lat.between(F.least(y1, y2), F.greatest(y1, y2))


def in_polygon(lon: Column, lat: Column, rings: Sequence[Ring]) -> Column:
    """Strictly inside: a point on a side is out.  Null coordinates give null."""
    edges = edges_of(rings)
    inside_box = in_box(lon, lat, bounds_of(rings))
    if len(edges) <= UNROLLED_EDGES:
        sides = [tuple(map(number, e)) for e in edges]
        # A level side is never crossed, so its slope, a division by zero, is left out.
        odd = reduce(lambda a, b: a != b, (_crosses(lon, lat, *s) for s, e in zip(sides, edges) if e[1] != e[3]))
        edge = reduce(lambda a, b: a | b, (_touches(lon, lat, *s) for s in sides))
        return inside_box & odd & ~edge
    flat = F.array(*(F.struct(*(number(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e))) for e in edges))
    at = lambda e: (e["x1"], e["y1"], e["x2"], e["y2"])
    rising = F.filter(flat, lambda e: e["y1"] != e["y2"])
    odd = F.size(F.filter(rising, lambda e: _crosses(lon, lat, *at(e)))) % 2 == 1
    return inside_box & odd & ~F.exists(flat, lambda e: _touches(lon, lat, *at(e)))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    north, east = F.sin((phi2 - phi1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return number(2 * EARTH_KM) * F.asin(F.sqrt(north * north + F.cos(phi1) * F.cos(phi2) * east * east))


def area_km2(ring: Column) -> Column:
    """Planar area of an array of struct<x, y> corners by the shoelace formula; under three corners it is 0."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    total = F.aggregate(cross, number(0), lambda a, v: a + v)
    return F.when(F.size(ring) >= 3, F.abs(total) / 2 * number(KM_NORTH) * number(KM_EAST)).otherwise(number(0))


def polygon_km2(rings: Column) -> Column:
    """Planar area of an array of rings, the first a shell and the others its holes."""
    holes = F.aggregate(F.transform(F.slice(rings, 2, F.size(rings)), area_km2), number(0), lambda a, v: a + v)
    return F.when(F.size(rings) > 0, F.greatest(area_km2(F.get(rings, F.lit(0))) - holes, number(0))).otherwise(number(0))


def segment_distance2(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance of a point to a segment, which may be a point, in the units of the coordinates."""
    dx, dy = x2 - x1, y2 - y1
    along = F.least(F.greatest(F.coalesce(((px - x1) * dx + (py - y1) * dy) / F.nullif(dx * dx + dy * dy, number(0)), number(0)), number(0)), number(1))
    ox, oy = px - (x1 + along * dx), py - (y1 + along * dy)
    return ox * ox + oy * oy


def radius_box(lon: Column, lat: Column, km: float = 12.0) -> Column:
    """struct<min_lon, min_lat, max_lon, max_lat> around a point; its width follows the latitude."""
    dlat = number(km / KM_NORTH)
    dlon = number(km) / (number(KM_NORTH) * F.greatest(F.cos(F.radians(lat)), number(0.01)))
    return F.struct((lon - dlon).alias("min_lon"), (lat - dlat).alias("min_lat"), (lon + dlon).alias("max_lon"), (lat + dlat).alias("max_lat"))


def grid_row(lat: Column, y0: float, py: float) -> Column:
    """Row of a north-up grid, whatever its extent; the caller's join finds no cell outside."""
    return F.floor((number(y0) - lat) / number(py)).cast("int")


def grid_col(lon: Column, x0: float, px: float) -> Column:
    return F.floor((lon - number(x0)) / number(px)).cast("int")


def severity(value: Column) -> Column:
    """A sampled value as a class: null, NaN and negatives are 0, fractions are cut off."""
    value = value.cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(0)).otherwise(F.greatest(value.cast("int"), F.lit(0)))


def risk_class(value: Column, class_max: int = 5) -> Column:
    """Rounds halves to even and keeps the result between 1 and class_max."""
    return F.least(F.greatest(F.rint(value), number(1)), number(class_max)).cast("int")


def mercator(lon: Column, lat: Column) -> Column:
    """struct<x, y> in metres of spherical web Mercator."""
    y = F.log(F.tan(number(pi / 4) + F.radians(lat) / 2)) * number(MERCATOR_M)
    return F.struct((F.radians(lon) * number(MERCATOR_M)).alias("x"), y.alias("y"))


def from_mercator(x: Column, y: Column) -> Column:
    """struct<lon, lat> of web Mercator metres."""
    lat = F.degrees(2 * F.atan(F.exp(y / number(MERCATOR_M))) - number(pi / 2))
    return F.struct(F.degrees(x / number(MERCATOR_M)).alias("lon"), lat.alias("lat"))


def clip_to_convex(x1: Column, y1: Column, x2: Column, y2: Column, ring: Ring) -> Column:
    """struct<x1, y1, x2, y2> of the part of a segment inside a convex ring, null if there is none.

    Each side bounds the segment's parameter from below where the segment comes in and from above where it
    leaves; what lies between the largest lower and the smallest upper bound is inside."""
    corners = edges_of([ring])
    turn = sum((bx - ax) * (by + ay) for ax, ay, bx, by in corners)
    if turn > 0:  # clockwise
        corners = [(bx, by, ax, ay) for ax, ay, bx, by in corners]
    lows, highs, outside = [number(0)], [number(1)], F.lit(False)
    for ax, ay, bx, by in corners:
        ex, ey = number(bx - ax), number(by - ay)
        start = ex * (y1 - number(ay)) - ey * (x1 - number(ax))
        slope = ex * (y2 - y1) - ey * (x2 - x1)
        at = -start / F.nullif(slope, number(0))
        lows.append(F.when(slope > 0, at).otherwise(number(0)))
        highs.append(F.when(slope < 0, at).otherwise(number(1)))
        outside = outside | ((slope == 0) & (start < 0))
    low, high = F.greatest(*lows), F.least(*highs)
    point = lambda t, a, b: a + t * (b - a)
    part = F.struct(point(low, x1, x2).alias("x1"), point(low, y1, y2).alias("y1"), point(high, x1, x2).alias("x2"), point(high, y1, y2).alias("y2"))
    return F.when(~outside & (low < high) & ((x1 != x2) | (y1 != y2)), part)


def clip_to_polygon(x1: Column, y1: Column, x2: Column, y2: Column, rings: Sequence[Ring]) -> Column:
    """array<struct<x1, y1, x2, y2>> of the parts of a segment inside any polygon, even-odd over its rings.

    The segment is cut where it meets a side; a part is inside if its middle is."""
    sides = F.array(*(F.struct(*(number(v).alias(n) for n, v in zip(("ax", "ay", "bx", "by"), e))) for e in edges_of(rings)))
    dx, dy = x2 - x1, y2 - y1

    def cut(e: Column) -> Column:
        ex, ey = e["bx"] - e["ax"], e["by"] - e["ay"]
        across = F.nullif(dx * ey - dy * ex, number(0))
        t, u = ((e["ax"] - x1) * ey - (e["ay"] - y1) * ex) / across, ((e["ax"] - x1) * dy - (e["ay"] - y1) * dx) / across
        return F.when((t > 0) & (t < 1) & u.between(0, 1), t)

    cuts = F.array_sort(F.array_distinct(F.concat(F.array(number(0), number(1)), F.filter(F.transform(sides, cut), lambda t: t.isNotNull()))))
    pairs = F.arrays_zip(F.slice(cuts, 1, F.size(cuts) - 1).alias("a"), F.slice(cuts, 2, F.size(cuts)).alias("b"))
    at = lambda t: (x1 + t * dx, y1 + t * dy)

    def inside(p: Column) -> Column:
        mx, my = at((p["a"] + p["b"]) / 2)
        return F.size(F.filter(sides, lambda e: (e["ay"] != e["by"]) & _crosses(mx, my, e["ax"], e["ay"], e["bx"], e["by"]))) % 2 == 1

    def part(p: Column) -> Column:
        (a, b), (c, d) = at(p["a"]), at(p["b"])
        return F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))

    return F.when((dx != 0) | (dy != 0), F.transform(F.filter(pairs, inside), part))
