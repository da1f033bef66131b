"""Stored layers meet without an exchange, and give what loose ones give."""

from __future__ import annotations

import re

import numpy as np
import pytest

from gridquill.operators import raster
from gridquill.plans import exposure, session
from gridquill.sources import buckets
from tests.conftest import DATA, assert_same, plan


def layer(spark, seed, share=0.7):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(i, j, float(r.integers(0, 6))) for i in range(40) for j in range(30) if r.random() < share], "row int, col int, value double")


def exchanges(df):
    return re.findall(r"\b\w*Exchange\b", plan(df))


def test_no_exchange(spark, tmp_path):
    loose = {n: layer(spark, i) for i, n in enumerate(("hazard", "a", "b", "c"))}
    for n, cells in loose.items():
        buckets.store_layer(cells, f"no_exchange_{n}", str(tmp_path / n), 4)
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    found = buckets.combine_risk(spark, "no_exchange_hazard", {n: f"no_exchange_{n}" for n in weights}, weights)
    assert exchanges(found) == [] and "SortMergeJoin" in plan(found)
    want = raster.combine_risk(loose["hazard"], {n: loose[n] for n in weights}, weights)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    pairs = buckets.compare(spark, "no_exchange_a", "no_exchange_b")
    assert exchanges(pairs) == []
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, raster.compare(loose["a"], loose["b"]).collect()))
    assert len(list((tmp_path / "a").glob("*.parquet"))) <= 4


def test_stored_layers_are_replaced_and_checked(spark, tmp_path):
    for seed in (1, 2):
        buckets.store_layer(layer(spark, seed), "kept_layer", str(tmp_path / "kept"), 3)
        assert spark.table("kept_layer").count() == layer(spark, seed).count()
    twice = layer(spark, 3).limit(5)
    with pytest.raises(ValueError, match="repeats"):
        buckets.store_layer(twice.unionAll(twice), "double_layer", str(tmp_path / "double"), 3)
    with pytest.raises(ValueError, match="weight"):
        buckets.combine_risk(spark, "kept_layer", {"a": "kept_layer"}, {})
    empty = layer(spark, 1).limit(0)
    buckets.store_layer(empty, "empty_layer", str(tmp_path / "empty"), 3)
    assert buckets.combine_risk(spark, "empty_layer", {"a": "kept_layer"}, {"a": 1.0}).count() == 0


@pytest.mark.parametrize("name", ["stored_l2_risk", "stored_grid_agreement"])
def test_queries(spark, name):
    assert_same(exposure.QUERIES[name](spark, DATA), exposure.ORACLE_SQL[name])


@pytest.mark.parametrize("sf", [DATA, "/root/testdata/sf0.01"])
def test_stale_marks(spark, sf):
    assert_same(session.QUERIES["stream_stale_marks"](spark, sf), session.ORACLE_SQL["stream_stale_marks"], sf)
