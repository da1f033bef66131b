"""Outlines of classes against a tracer that walks edge by edge."""

from __future__ import annotations

import json
from collections import defaultdict

import numpy as np
import pytest

from gridquill.operators import polygons, raster
from gridquill.plans import exposure
from gridquill.sources.tables import Grid
from tests.conftest import DATA, assert_same

#: Directions east, south, west, north as steps of (y, x).
STEPS = ((0, 1), (1, 0), (0, -1), (-1, 0))


def traced(cells):
    """{(class, first cell of the part): (rings, each from its least corner on; the shell is first)}."""
    part = {}
    for cell in sorted(cells):
        if cell not in part:
            stack = [cell]
            part[cell] = cell
            while stack:
                y, x = stack.pop()
                for dy, dx in STEPS:
                    n = (y + dy, x + dx)
                    if cells.get(n) == cells[cell] and n not in part:
                        part[n] = cell
                        stack.append(n)
    edges = {}
    for (y, x), v in cells.items():
        for d, (at, other) in enumerate((((y, x), (y - 1, x)), ((y, x + 1), (y, x + 1)), ((y + 1, x + 1), (y + 1, x)), ((y + 1, x), (y, x - 1)))):
            if cells.get(other) != v:
                edges[(y, x), d] = at
    left, out = set(edges), defaultdict(list)
    while left:
        (cell, d) = begin = min(left)
        corners, way = [], None
        while True:
            left.discard((cell, d))
            if way != d:
                corners.append((*edges[cell, d], way))
            way = d
            y, x = cell
            dy, dx = STEPS[d]
            ahead, aside = (y + dy, x + dx), (y + dy + STEPS[(d + 3) % 4][0], x + dx + STEPS[(d + 3) % 4][1])
            v = cells[cell]
            # Around the outside of the part: straight on, into what stands in the way, or around the corner.
            if cells.get(ahead) == v and cells.get(aside) == v:
                cell, d = aside, (d + 3) % 4
            elif cells.get(ahead) == v:
                cell = ahead
            else:
                d = (d + 1) % 4
            if (cell, d) == begin:
                break
        if corners[0][2] is None and way == begin[1]:
            corners = corners[1:]
        points = [c[:2] for c in corners]
        at = min(range(len(points)), key=lambda i: points[i])
        out[cells[begin[0]], part[begin[0]]].append(points[at:] + points[:at])
    return {k: sorted(v) for k, v in out.items()}


def found(outline):
    by_ring = defaultdict(dict)
    for r in outline.collect():
        by_ring[r["value"], r["polygon"], r["ring"], r["hole"]][r["off"]] = (r["y"], r["x"])
    out = defaultdict(list)
    for (value, polygon, ring, hole), at in by_ring.items():
        assert sorted(at) == list(range(len(at)))
        points = [at[0], *(at[i] for i in range(len(at) - 1, 0, -1))]
        turn = min(range(len(points)), key=lambda i: points[i])
        assert hole == (polygon != ring)
        out[value, polygon].append(points[turn:] + points[:turn])
    return out


def compare(spark, array, row0=0, col0=0):
    return compare_cells(spark, {(int(r) + row0, int(c) + col0): int(v) for (r, c), v in np.ndenumerate(array) if 1 <= v <= 5})


def compare_cells(spark, cells):
    table = spark.createDataFrame([(r, c, float(v)) for (r, c), v in cells.items()], "row int, col int, value double")
    outline = polygons.rings(table).cache()
    ours = {(v, min(min(r) for r in rings)): sorted(rings) for (v, _), rings in found(outline).items()}
    theirs = {(v, min(min(r) for r in rings)): rings for (v, _), rings in traced(cells).items()}
    assert ours == theirs
    sizes = {(r["value"], r["row"], r["col"]): r for r in polygons.parts(outline).collect()}
    assert len(sizes) == len(ours) and sum(r["n_cells"] for r in sizes.values()) == len(cells)
    for (v, first), rings in theirs.items():
        assert sizes[(v, *first)]["n_holes"] == len(rings) - 1 and sizes[(v, *first)]["n_vertices"] == sum(map(len, rings))
    return table, outline


NESTED = np.array([[1 if max(abs(r - 8), abs(c - 8)) % 4 < 2 else 2 * ((r + c) % 7 == 0) for c in range(17)] for r in range(17)])
RIBS = np.array([[1 if r in (0, 12) or c in (0, 12) or (c % 4 == 2 and 2 <= r <= 9) or (r == 5 and c == 8) else 0 for c in range(13)] for r in range(13)])


SHAPES = [np.ones((1, 1)), np.ones((3, 5)), np.eye(4), np.array([[1, 0, 1], [0, 1, 0], [1, 0, 1]]), np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]]), np.array([[1, 1, 1, 0], [1, 0, 1, 1], [1, 1, 0, 1], [0, 1, 1, 1]]), NESTED, RIBS]
#: A comb whose outline has many turns.
COMB = np.ones((41, 200), dtype=int)
COMB[:40, 1::2] = 0


def test_shapes(spark):
    """Side by side in one raster, which makes no difference to any of them."""
    cells = {}
    for i, array in enumerate([*SHAPES, COMB]):
        cells |= {(int(r), int(c) + 30 * i): int(v) for (r, c), v in np.ndenumerate(array) if 1 <= v <= 5}
    compare_cells(spark, cells)


@pytest.mark.parametrize("seed", [0, 2])
def test_random_classes(spark, seed):
    r = np.random.default_rng(seed)
    array = r.integers(0, 8, (24, 30)) if seed < 2 else (r.random((24, 30)) < 0.7).astype(int)
    table, outline = compare(spark, array, -7, 100_000)
    grid = Grid()
    areas = {r["value"]: round(r["km2"], 6) for r in raster.dissolved_area(table, grid).collect()}
    assert {r["value"]: round(r["km2"], 6) for r in polygons.outline_area(outline, grid).collect()} == areas


def test_geojson(spark):
    cells = spark.createDataFrame([(r, c, 1.0) for r in range(3) for c in range(3) if (r, c) != (1, 1)] + [(1, 1, 9.0), (1, 4, 2.0)], "row int, col int, value double")
    outline = polygons.rings(cells)
    texts = {r["value"]: json.loads(r["geometry"]) for r in polygons.multipolygons(outline, Grid(x0=100.0, y0=10.0, px=1.0, py=1.0)).collect()}
    assert set(texts) == {1, 2} and {x["type"] for x in texts.values()} == {"MultiPolygon"}
    ((shell, hole),) = texts[1]["coordinates"]
    assert shell[0] == shell[-1] and hole[0] == hole[-1]
    turned = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2
    assert turned(shell) == 9 and turned(hole) == -1
    assert sorted(map(tuple, texts[2]["coordinates"][0][0][:-1])) == [(104, 8), (104, 9), (105, 8), (105, 9)]


def test_no_cells(spark):
    none = spark.createDataFrame([(0, 0, 0.0), (1, 1, None)], "row int, col int, value double")
    assert polygons.rings(none).count() == 0
    assert polygons.outline_area(polygons.rings(none), Grid()).count() == 0


@pytest.mark.parametrize("name", ["class_polygons", "class_polygon_area"])
def test_queries(spark, name):
    assert_same(exposure.QUERIES[name](spark, DATA), exposure.ORACLE_SQL[name])
