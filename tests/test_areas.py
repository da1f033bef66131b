"""Assets in a table of areas against a test of every place with every area."""

from __future__ import annotations

import math
import random

import pytest

from gridquill.operators import areas, overlay
from gridquill.plans import exposure
from gridquill.sources.tables import Grid
from tests.conftest import DATA, assert_same, plan


def plain_inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def table(spark, shapes):
    return spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in shapes.items()], areas.AREAS)


def star(r, x, y, size, corners):
    return [(x + size * r.uniform(0.3, 1) * math.cos(2 * math.pi * i / corners), y + size * r.uniform(0.3, 1) * math.sin(2 * math.pi * i / corners)) for i in range(corners)]


def shapes_of(seed):
    r = random.Random(seed)
    out = {f"star {i}": [star(r, r.uniform(-2, 2), r.uniform(-2, 2), r.choice([0.02, 0.3, 1.5]), r.randint(3, 40))] for i in range(12)}
    out["holes"] = [[(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)], [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)], [(-0.25, -0.25), (0.25, -0.25), (0, 0.25)]]
    out["two parts"] = [[(-2, -2), (-1.5, -2), (-1.5, -1.5)], [(1.5, 1.5), (2, 1.5), (2, 2)]]
    out["on the grid"] = [[(0, 0), (0.5, 0), (0.5, 0.25), (0, 0.25)]]
    out["thin"] = [[(-2, 0.333), (2, 0.3331), (2, 0.3332)]]
    out["a point"], out["a line"], out["nothing"] = [[(0, 0)]], [[(0, 0), (1, 1)]], []
    return out


@pytest.mark.parametrize(("seed", "size", "fan"), [(1, 0.1, 4), (2, 0.03, 16), (3, 0.5, 2), (4, 0.07, 1)])
def test_agrees_with_every_pair(spark, seed, size, fan):
    shapes = shapes_of(seed)
    r = random.Random(seed + 100)
    places = [(i, r.uniform(-2.2, 2.2), r.uniform(-2.2, 2.2)) for i in range(700)]
    places += [(1000 + i, x / 8, y / 8) for i, (x, y) in enumerate((x, y) for x in range(-9, 10) for y in range(-9, 10))] + [(5000, None, 0.0), (5001, 0.0, None)]
    found = areas.in_areas(spark.createDataFrame(places, "fid long, lon double, lat double"), table(spark, shapes), size=size, fan=fan)
    expected = sorted((i, k) for i, x, y in places if x is not None and y is not None for k, rings in shapes.items() if plain_inside(x, y, rings))
    assert sorted((r["fid"], r["area_id"]) for r in found.collect()) == expected


def test_large_cells_keep_covers_small(spark):
    square = {"big": [[(0.003, 0.003), (9.997, 0.003), (9.997, 9.997), (0.003, 9.997)]]}
    cells = areas.cover(table(spark, square), 0.01, 16).groupBy("size").count().collect()
    counts = {r["size"]: r["count"] for r in cells}
    assert counts[1] > 3500 and counts[0] < 70_000  # of a million small cells


def test_equal_keys_only_and_zero_counts(spark):
    shapes = {"a": [[(0, 0), (1, 0), (1, 1), (0, 1)]], "far": [[(50, 50), (51, 50), (51, 51)]]}
    assets = spark.createDataFrame([("schools", 0.5, 0.5), ("roads", 0.5, 0.5), ("schools", 0.0, 0.5), ("schools", 2.0, 2.0)], "layer string, lon double, lat double")
    found = areas.count_by_area(assets, table(spark, shapes), ["schools", "hospitals"])
    assert sorted(map(tuple, found.collect())) == [("a", "hospitals", 0), ("a", "schools", 1), ("far", "hospitals", 0), ("far", "schools", 0)]
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    none = areas.count_by_area(assets, table(spark, {}), ["schools"])
    assert none.count() == 0


def test_query(spark):
    assert_same(exposure.QUERIES["count_by_area"](spark, DATA), exposure.ORACLE_SQL["count_by_area"])


def test_hits_are_ordered_once_for_each_place(spark):
    """Many cursors at few places: what is sorted are the hits of places, not of cursors, and every cursor has all of its own."""
    features = spark.range(300).selectExpr("cast(id % 3 as int) as ord", "'x' as layer", "id as fid", "cast(id as string) as name", "cast(id % 4 as int) as severity", "cast(id % 5 as double) as lon", "0.25D as lat")
    cursors = spark.range(200).selectExpr("id as cursor_id", "cast(id % 6 as double) as lon", "0.25D as lat")
    cells = spark.createDataFrame([(0, 2, 3.0)], "row int, col int, value double")
    grid = Grid(x0=0.0, y0=1.0, px=1.0, py=1.0)
    found = overlay.identify_hits(cursors, features, cells, grid, 0.1)
    said = plan(found)
    assert said.index("SortMergeJoin") < said.index("Window")
    want = []
    for c in range(200):
        mine = sorted(((-(f % 3), f) for f in range(300) if f % 5 == c % 6))
        want += [(c, i + 1, "x", str(f), f % 4) for i, (_, f) in enumerate(mine)] + ([(c, len(mine) + 1, "raster", None, 3)] if c % 6 == 2 else [])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
