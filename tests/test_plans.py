"""What Spark plans: no joins without an equality on cells, filters at the scan; and imports without the llm folders."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridquill.functions import geo
from gridquill.operators import raster
from gridquill.plans import exposure, library
from gridquill.sources import tables as t
from tests.conftest import DATA, plan

REPO = Path(__file__).parent.parent


@pytest.mark.parametrize("name", ["count_in_hazard", "asset_severity_tags", "road_max_severity", "combine_l2_risk", "regrid_nearest", "grid_agreement", "grid_confusion", "dissolve_rectangles"])
def test_cells_meet_by_equality(spark, name):
    assert "NestedLoop" not in plan(exposure.QUERIES[name](spark, DATA))


def test_pushdown(spark, tmp_path):
    cells = t.cells(spark, DATA, "hazard")
    cells.write.parquet(str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    window = plan(raster.clip_window(stored, t.FINE, exposure.CLIP_BOX))
    assert "GreaterThanOrEqual(row," in window and "LessThanOrEqual(col," in window
    t.assets(spark, DATA).write.parquet(str(tmp_path / "assets"))
    inside = plan(spark.read.parquet(str(tmp_path / "assets")).where(geo.in_polygon(F.col("lon"), F.col("lat"), t.AREA)).select("fid"))
    assert "GreaterThanOrEqual(lon," in inside and "name" not in inside.split("ReadSchema")[1]
    assert "part" in plan(cells) and "p_name" not in plan(cells)


def test_topk_keeps_k_rows(spark):
    assert "TakeOrderedAndProject" in plan(library.QUERIES["vector_topk"](spark, DATA))


def test_entry_without_the_llm_folders(tmp_path):
    """The rest imports and answers when the llm subpackage, the pipeline and its tests are gone."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'count_in_hazard' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/root"})
    for path in (REPO / "gridquill").rglob("*.py"):
        if "llm" not in path.parts:
            assert "gridquill.llm" not in path.read_text() and "from .llm" not in path.read_text()


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
