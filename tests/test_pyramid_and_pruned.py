"""Windows over a pyramid of class counts, and nearest vectors by lists: exact, and most is left unread."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridquill.functions import vectors as vx
from gridquill.operators import nearest, pruned, retrieval
from gridquill.plans import exposure, library
from gridquill.sources import pyramid
from tests.conftest import DATA, assert_same, plan


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    r = np.random.default_rng(1)
    rows = [(i - 20, j - 7, float(r.integers(0, 6)) if r.random() < 0.95 else float("nan")) for i in range(90) for j in range(70) if r.random() < 0.9]
    path, shape = str(tmp_path_factory.mktemp("pyramid")), pyramid.Shape(4, 3, 3)
    pyramid.write_pyramid(spark.createDataFrame([*rows, (500, 500, None)], "row int, col int, value double"), path, shape)
    return rows, path, shape


def test_windows_are_exact(spark, held):
    rows, path, shape = held
    r = random.Random(2)
    windows = [(-100, 200, -100, 200), (0, 0, 0, 0), (3, 2, 0, 5), (-20, 69, -7, 62), (0, 35, 0, 35)]
    windows += [(a, a + r.randint(0, 60), b, b + r.randint(0, 60)) for a, b in ((r.randint(-25, 60), r.randint(-10, 50)) for _ in range(12))]
    for w in windows:
        mine = [v for i, j, v in rows if w[0] <= i <= w[1] and w[2] <= j <= w[3]]
        good = [v for v in mine if v == v and v != 0]
        got = pyramid.window_stats(spark, path, w, 0.0, shape).first()
        assert (got["n"], got["vmin"], got["vmax"], got["n_distinct"]) == (len(good), min(good, default=None), max(good, default=None), len(set(good))), w
        assert sum(x["n"] for x in pyramid.window_counts(spark, path, w, shape).collect()) == len(mine)


def test_inner_cells_are_not_read(spark, held, tmp_path):
    rows, path, shape = held
    window = (-9, 60, -2, 50)
    found = plan(pyramid.window_counts(spark, path, window, shape))
    assert any("tile_row" in x.split("PushedFilters")[0] for x in found.split("PartitionFilters: ")[1:])
    a, b, c, d = pyramid.inside(window, shape.tile)
    read = {int(f.split("tile_row=")[1].split("/")[0]) * 1000 + int(f.split("tile_col=")[1].split("/")[0]) for f in pyramid.read_cells(spark, path).where(pyramid.between((window[0] // 4, window[1] // 4, window[2] // 4, window[3] // 4), "tile_row", "tile_col") & ~pyramid.between((a, b, c, d), "tile_row", "tile_col")).inputFiles()}
    kept = pyramid.read_cells(spark, path).where(pyramid.between(window) & ~pyramid.between((a, b, c, d), "tile_row", "tile_col")).count()
    assert read and kept < 0.3 * sum(window[0] <= i <= window[1] and window[2] <= j <= window[3] for i, j, _ in rows)


def vectors(spark, n, clusters, spread, seed, d=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, d))
    rows = [(i, [float(x) for x in centres[i % clusters] + spread * r.normal(size=d)]) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize(("clusters", "spread"), [(8, 0.1), (1, 1.0)])
def test_nearest_are_those_of_comparing_everything(spark, tmp_path, clusters, spread):
    v = vectors(spark, 1200, clusters, spread, 3)
    queries = v.where("vec_id % 40 = 0").selectExpr("vec_id as query_id", "embedding as vector")
    centres = pruned.fit_centres(v, 12, 300)
    pruned.index(v, centres).write.parquet(str(tmp_path / "lists"))
    top, report = pruned.search_pruned(spark.read.parquet(str(tmp_path / "lists")), centres, queries, 5)
    want = retrieval.search_many(v, queries, 5, "vec_id")
    assert sorted(map(tuple, top.select("query_id", "id", "score", "rank").collect())) == sorted(map(tuple, want.select("query_id", "id", "score", "rank").collect()))
    said = report.first()
    assert said["vectors"] == 30 * 1200 and said["compared"] <= said["vectors"]
    if clusters > 1:
        assert said["skipped"] > 0.5 * said["lists"] and said["compared"] < 0.4 * said["vectors"]


def test_few_vectors_and_none(spark):
    v = vectors(spark, 3, 1, 1.0, 4)
    queries = v.selectExpr("vec_id as query_id", "embedding as vector")
    found = pruned.search_many_pruned(v, queries, 5, 2)
    assert found.count() == 9
    assert pruned.search_many_pruned(v.limit(0), queries, 5).count() == 0


@pytest.mark.parametrize("name", ["vector_topk_pruned"])
def test_vector_query(spark, name):
    assert_same(library.QUERIES[name](spark, DATA), library.ORACLE_SQL[name])


def test_window_query(spark):
    assert_same(exposure.QUERIES["window_counts"](spark, DATA), exposure.ORACLE_SQL["window_counts"])


def test_folders_stay_few_however_small_tiles_are(spark, tmp_path):
    cells = spark.range(90_000).selectExpr("cast(id div 30 as int) as row", "cast(id % 30 as int) as col", "cast(id % 5 as double) as value")
    path, shape = str(tmp_path / "pyramid"), pyramid.Shape(2, 2, 3)
    pyramid.write_pyramid(cells, path, shape)
    assert len(list((tmp_path / "pyramid" / "cells").glob("**/tile_col=*"))) <= 1.2 * pyramid.FOLDERS
    for r1, r2, c1, c2 in ((3, 2001, 1, 27), (17, 18, 0, 40), (-5, 4000, -5, 40)):
        found = pyramid.window_counts(spark, path, (r1, r2, c1, c2), shape)
        want = cells.where(f"row between {r1} and {r2} and col between {c1} and {c2}").groupBy("value").count()
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_blocks_hand_on_the_best_alone(spark):
    """Copies, nulls, other lengths and ties, in several parts, against every pair scored by itself; no task hands on more than k of a query."""
    r = np.random.default_rng(6)
    made = [[float(x) for x in r.normal(size=8)] for _ in range(150)] + [[0.5] * 8] * 60 + [None, [1.0, 2.0], [1.0] * 7 + [None]]
    v = spark.createDataFrame(list(enumerate(made)), "vec_id long, embedding array<double>")
    queries = v.where("vec_id % 10 = 0 or vec_id > 208").selectExpr("vec_id as query_id", "embedding as vector")
    pairs = queries.crossJoin(v).select("query_id", F.col("vec_id").alias("id"), F.round(vx.cosine(F.col("vector"), F.col("embedding")), 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    want = sorted(map(tuple, pairs.withColumn("rank", rank).where("rank <= 5").collect()), key=repr)
    for block in (512, 7):
        assert sorted(map(tuple, retrieval.search_many(v, queries, 5, "vec_id", block=block).select("query_id", "id", "score", "rank").collect()), key=repr) == want
    none, one = F.lit(None).cast("double"), F.lit(0)
    met = nearest.meet(v.select("vec_id", F.col("vec_id").alias("id"), vx.normalised(F.col("embedding")).alias("v"), none.alias("far"), one.alias("part")), queries.select("query_id", vx.normalised(F.col("vector")).alias("q"), none.alias("away"), none.alias("reach"), one.alias("part")), ["part"], 5)
    assert met.count() == 5 * queries.count() and met.agg(F.sum("compared")).first()[0] == queries.count() * len(made)


def test_rounding_is_sparks(spark):
    values = [0.00005, 0.12345, -0.12345, 0.99995, 1.00005, 0.33335000000000004, 0.3333499999999999, -1.0, 0.0, 0.70705]
    want = [x[0] for x in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i").select(F.round("x", 4)).collect()]
    assert list(nearest.rounded(np.array(values))) == want
