"""Algebra of rasters that are tables of cells (row, col, value): windows, statistics, regridding, weighted
risk, agreement of two grids, dissolving.

Cells meet on (row, col); more than two layers are stacked and aggregated once instead of joined one by one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridquill.functions import geo
from gridquill.sources.tables import Grid

BUFFER_DEG = 0.01


def window_range(grid: Grid, box: tuple[float, float, float, float], margin: float = BUFFER_DEG) -> tuple[int, int, int, int]:
    """(first row, last row, first col, last col) of the cells that a widened box touches."""
    x1, y1, x2, y2 = box
    row = lambda lat: int((grid.y0 - lat) // grid.py)
    col = lambda lon: int((lon - grid.x0) // grid.px)
    return row(y2 + margin), row(y1 - margin), col(x1 - margin), col(x2 + margin)


def clip_window(cells: DataFrame, grid: Grid, box: tuple[float, float, float, float], margin: float = BUFFER_DEG) -> DataFrame:
    """The cells around a box.  Rows and columns are compared with literals, so stored cells are pruned by tile and row group."""
    r1, r2, c1, c2 = window_range(grid, box, margin)
    return cells.where(F.col("row").between(r1, r2) & F.col("col").between(c1, c2))


def stats(cells: DataFrame, nodata: float | None = None, stride: int = 1) -> DataFrame:
    """One row: n, vmin, vmax, n_distinct of every stride-th row and column, without NaN and nodata; nulls and 0 if none is left."""
    picked = cells.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0)) if stride > 1 else cells
    value = F.col("value").cast("double")
    picked = picked.where(value.isNotNull() & ~F.isnan(value))
    if nodata is not None:
        picked = picked.where(value != F.lit(float(nodata)))
    return picked.agg(F.count("*").alias("n"), F.min(value).alias("vmin"), F.max(value).alias("vmax"), F.count_distinct(value).alias("n_distinct"))


def regrid_nearest(target: DataFrame, target_grid: Grid, source: DataFrame, source_grid: Grid, fill: float = 0.0) -> DataFrame:
    """(row, col, value): for each target cell the source value at its centre, fill where the source has none."""
    lon = geo.number(target_grid.x0) + (F.col("row_col") + geo.number(0.5)) * geo.number(target_grid.px)
    lat = geo.number(target_grid.y0) - (F.col("row_row") + geo.number(0.5)) * geo.number(target_grid.py)
    centres = target.select(F.col("row").alias("row_row"), F.col("col").alias("row_col"))
    keyed = centres.select("row_row", "row_col", geo.grid_row(lat, source_grid.y0, source_grid.py).alias("row"), geo.grid_col(lon, source_grid.x0, source_grid.px).alias("col"))
    found = keyed.join(source.select("row", "col", "value"), ["row", "col"], "left")
    return found.select(F.col("row_row").alias("row"), F.col("row_col").alias("col"), F.coalesce(F.nanvl("value", F.lit(None).cast("double")), geo.number(fill)).alias("value"))


def stacked(layers: Mapping[str, DataFrame], wanted: str = "value") -> DataFrame:
    """(row, col, and a column for each layer): one aggregate over the layers' union; null where a layer has no cell."""
    rows = [cells.select("row", "col", F.lit(i).alias("__layer"), F.col("value").cast("double").alias("__v")) for i, cells in enumerate(layers.values())]
    one = lambda i: F.max(F.when(F.col("__layer") == i, F.col("__v")))
    return reduce(DataFrame.unionAll, rows).groupBy("row", "col").agg(*(one(i).alias(name) for i, name in enumerate(layers)))


def weighted_class(hazard: Column, layers: Sequence[Column], weights: Sequence[float], class_max: int) -> Column:
    """hazard times the weighted mean of the layers that have a value, as a class; 0 where either is missing."""
    valid = [F.coalesce(v > 0, F.lit(False)) for v in layers]
    top = reduce(lambda a, b: a + b, (F.when(ok, geo.number(w) * v).otherwise(geo.number(0)) for ok, v, w in zip(valid, layers, weights)))
    den = reduce(lambda a, b: a + b, (F.when(ok, geo.number(w)).otherwise(geo.number(0)) for ok, w in zip(valid, weights)))
    return F.when((hazard > 0) & (den > 0), geo.risk_class(hazard * (top / den) / geo.number(class_max), class_max)).otherwise(F.lit(0))


def combine_risk(hazard: DataFrame, vulnerability: Mapping[str, DataFrame], weights: Mapping[str, float], class_max: int = 5) -> DataFrame:
    """(row, col, value): recomputed risk of every cell that the hazard raster has."""
    if not vulnerability or set(vulnerability) - set(weights):
        raise ValueError("every vulnerability layer needs a weight")
    names = list(vulnerability)
    table = stacked({"__hazard": hazard, **vulnerability}).where(F.col("__hazard").isNotNull())
    risk = weighted_class(F.col("__hazard"), [F.col(f"`{n}`") for n in names], [weights[n] for n in names], class_max)
    return table.select("row", "col", risk.cast("double").alias("value"))


def compare(ours: DataFrame, other: DataFrame) -> DataFrame:
    """(row, col, ours, other) of the cells where either has a class; the missing side is 0."""
    both = stacked({"ours": ours, "other": other}).select("row", "col", geo.severity(F.col("ours")).alias("ours"), geo.severity(F.col("other")).alias("other"))
    return both.where("ours > 0 or other > 0")


def agreement(pairs: DataFrame) -> DataFrame:
    """One row: n, exact_pct, within1_pct, mean_abs_diff of compare's cells; nulls if there are none."""
    diff = F.abs(F.col("ours") - F.col("other"))
    return pairs.agg(
        F.count("*").alias("n"), F.round(F.avg((diff == 0).cast("int")) * 100, 1).alias("exact_pct"), F.round(F.avg((diff <= 1).cast("int")) * 100, 1).alias("within1_pct"), F.round(F.avg(diff), 3).alias("mean_abs_diff")
    )


def confusion(pairs: DataFrame) -> DataFrame:
    """(ours, other, n) for the pairs of classes that occur."""
    return pairs.where("ours between 0 and 5 and other between 0 and 5").groupBy("ours", "other").agg(F.count("*").alias("n"))


def weight_candidates(layers: int) -> list[list[float]]:
    """Equal weights, then each layer in turn at 0.8 with the rest shared; one layer has one candidate."""
    if layers == 1:
        return [[1.0]]
    rest = round(0.2 / (layers - 1), 3)
    return [[round(1 / layers, 3)] * layers, *([0.8 if i == j else rest for j in range(layers)] for i in range(layers))]


def best_weights(hazard: DataFrame, vulnerability: Mapping[str, DataFrame], reference: DataFrame, candidates: Sequence[Sequence[float]] | None = None, class_max: int = 5) -> DataFrame:
    """(candidate, weights, n, exact_pct, within1_pct, best): each candidate's agreement with the reference.

    All candidates are scored in one pass over the cells; the first of the highest within1_pct is best."""
    names = list(vulnerability)
    tried = [list(map(float, c)) for c in (candidates or weight_candidates(len(names)))]
    table = stacked({"__hazard": hazard, "__other": reference, **vulnerability})
    other = geo.severity(F.col("__other"))
    layers = [F.col(f"`{n}`") for n in names]
    classes = [weighted_class(F.coalesce("__hazard", geo.number(0)), layers, c, class_max) for c in tried]
    wide = table.select(other.alias("other"), *(c.alias(f"c{i}") for i, c in enumerate(classes)))

    def scores(i: int) -> list[Column]:
        active, diff = (F.col(f"c{i}") > 0) | (F.col("other") > 0), F.abs(F.col(f"c{i}") - F.col("other"))
        share = lambda hit: F.round(F.avg(F.when(active, hit.cast("int"))) * 100, 1)
        return [F.count_if(active).alias(f"n{i}"), share(diff == 0).alias(f"e{i}"), share(diff <= 1).alias(f"w{i}")]

    row = wide.agg(*chain.from_iterable(scores(i) for i in range(len(tried))))
    long = row.select(F.explode(F.array(*(F.struct(F.lit(i).alias("candidate"), F.lit(",".join(f"{w:g}" for w in c)).alias("weights"), F.col(f"n{i}").alias("n"), F.col(f"e{i}").alias("exact_pct"), F.col(f"w{i}").alias("within1_pct")) for i, c in enumerate(tried)))).alias("s")).select("s.*")
    rank = F.row_number().over(Window.orderBy(F.col("within1_pct").desc_nulls_last(), "candidate"))  # a row for each candidate
    return long.select("*", (rank == 1).alias("best"))


def class_runs(cells: DataFrame) -> DataFrame:
    """(row, value, col_from, col_to): runs of neighbouring cells of one class 1 to 5 in a row."""
    valued = cells.select("row", "col", geo.severity(F.col("value")).alias("value")).where("value between 1 and 5")
    island = F.col("col") - F.row_number().over(Window.partitionBy("row", "value").orderBy("col"))
    return valued.withColumn("island", island).groupBy("row", "value", "island").agg(F.min("col").alias("col_from"), F.max("col").alias("col_to")).drop("island")


def dissolve(cells: DataFrame) -> DataFrame:
    """(value, row_from, row_to, col_from, col_to): rectangles that cover each class once, equal runs of
    neighbouring rows joined."""
    runs = class_runs(cells)
    island = F.col("row") - F.row_number().over(Window.partitionBy("value", "col_from", "col_to").orderBy("row"))
    return runs.withColumn("island", island).groupBy("value", "col_from", "col_to", "island").agg(F.min("row").alias("row_from"), F.max("row").alias("row_to")).select("value", "row_from", "row_to", "col_from", "col_to")


def dissolved_area(cells: DataFrame, grid: Grid) -> DataFrame:
    """(value, n_parts, km2): parts and planar area of each class' polygon."""
    area = (F.col("row_to") - F.col("row_from") + 1) * (F.col("col_to") - F.col("col_from") + 1)
    factor = geo.number(grid.px * grid.py * geo.KM_NORTH * geo.KM_EAST)
    return dissolve(cells).groupBy("value").agg(F.count("*").alias("n_parts"), (F.sum(area) * factor).alias("km2"))
