"""Class counts of tiles at several levels beside a raster's cells: a window adds up tiles inside it and reads cells at its border alone.

A level's tile has FAN x FAN tiles of the level below.  A window is cut into rectangles: the tiles of the coarsest level that
lie inside, then of each finer level what is still open, then cells.  All bounds are literals on partition columns and
sorted columns, so files and row groups of everything else are left out; the answer is exact.

Cells lie in folders, one for each tile of the finest level of which there are FOLDERS at most: however large a raster or small its
finest tiles, folders don't become many.  A folder of a coarser level holds several finest tiles, whose cells are told apart by row and column.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of a finest tile's side, tiles of one level on a tile's side of the next, levels of tiles.
TILE, FAN, LEVELS = 64, 4, 4
#: Folders of cells at about most, and levels that they may be tiles of.
FOLDERS, FOLDER_LEVELS = 1024, 12


class Shape(NamedTuple):
    tile: int = TILE
    fan: int = FAN
    levels: int = LEVELS

    def side(self, level: int) -> int:
        """Cells of a tile's side; level 1 is the finest."""
        return self.tile * self.fan ** (level - 1)


SHAPE = Shape()
Span = tuple[int, int, int, int]


def tile_of(cell: str, side: int) -> Column:
    return F.floor(F.col(cell) / side).cast("int")


def folder_level(rows: DataFrame, shape: Shape) -> int:
    """The finest level of which the cells have about FOLDERS tiles at most, counted in one pass."""
    levels = range(1, FOLDER_LEVELS + 1)
    tiles = rows.agg(*(F.approx_count_distinct(F.struct(tile_of("row", shape.side(n)).alias("row"), tile_of("col", shape.side(n)).alias("col"))) for n in levels)).first()
    return next((n for n, found in zip(levels, tiles) if found <= FOLDERS), FOLDER_LEVELS)


def write_pyramid(cells: DataFrame, path: str, shape: Shape = SHAPE) -> None:
    """cells (row, col, value) below path/cells by tile of one level, and (row, col, value, n) of each level below path/tiles; null values are left out."""
    spark = cells.sparkSession
    rows = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value")).where("value is not null")
    level = folder_level(rows, shape)
    tiled = rows.withColumns({"tile_level": F.lit(level), "tile_row": tile_of("row", shape.side(level)), "tile_col": tile_of("col", shape.side(level))})
    tiled.repartition("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "row", "col").write.mode("overwrite").partitionBy("tile_level", "tile_row", "tile_col").parquet(f"{path}/cells")
    below = read_cells(spark, path).groupBy(tile_of("row", shape.tile).alias("row"), tile_of("col", shape.tile).alias("col"), "value").agg(F.count("*").alias("n"))
    for level in range(1, shape.levels + 1):
        below.repartitionByRange("row", "col").sortWithinPartitions("row", "col").write.mode("overwrite").parquet(f"{path}/tiles/level={level}")
        held = read_level(spark, path, level)
        below = held.groupBy(tile_of("row", shape.fan).alias("row"), tile_of("col", shape.fan).alias("col"), "value").agg(F.sum("n").alias("n"))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) and the folder's (tile_level, tile_row, tile_col)."""
    return spark.read.schema("row int, col int, value double, tile_level int, tile_row int, tile_col int").parquet(f"{path}/cells")


def read_level(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema("row int, col int, value double, n long").parquet(f"{path}/tiles/level={level}")


def inside(window: Span, side: int) -> Span | None:
    """(first row, last row, first col, last col) of the tiles that lie wholly in a window of cells, if there are any."""
    r1, r2, c1, c2 = window
    found = -(-r1 // side), (r2 + 1) // side - 1, -(-c1 // side), (c2 + 1) // side - 1
    return found if found[0] <= found[1] and found[2] <= found[3] else None


def between(span: Span, row: str = "row", col: str = "col"):
    return F.col(row).between(span[0], span[1]) & F.col(col).between(span[2], span[3])


def met(window: Span, shape: Shape, whole: bool = False) -> Column:
    """Whether a folder has cells in a window, or whole: none outside it; by partition columns alone."""
    found = F.lit(False)
    for level in range(1, FOLDER_LEVELS + 1):
        side = shape.side(level)
        span = inside(window, side) if whole else (window[0] // side, window[1] // side, window[2] // side, window[3] // side)
        if span is not None:
            found = found | ((F.col("tile_level") == level) & between(span, "tile_row", "tile_col"))
    return found


def window_counts(spark: SparkSession, path: str, window: Span, shape: Shape = SHAPE) -> DataFrame:
    """(value, n): how many cells of the window (first row, last row, first col, last col) have each value."""
    parts, covered = [], None
    for level in range(shape.levels, 0, -1):
        span = inside(window, shape.side(level))
        if span is None:
            continue
        tiles = read_level(spark, path, level).where(between(span))
        if covered is not None:  # what the level above has
            a, b, c, d = covered
            tiles = tiles.where(~between((a * shape.fan, (b + 1) * shape.fan - 1, c * shape.fan, (d + 1) * shape.fan - 1)))
        parts.append(tiles.select("value", "n"))
        covered = span
    cells = read_cells(spark, path).where(met(window, shape) & between(window))
    if covered is not None:
        a, b, c, d = covered
        inner = a * shape.tile, (b + 1) * shape.tile - 1, c * shape.tile, (d + 1) * shape.tile - 1
        cells = cells.where(~met(inner, shape, whole=True) & ~between(inner))
    parts.append(cells.select("value", F.lit(1).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, parts).groupBy("value").agg(F.sum("n").alias("n"))


def window_stats(spark: SparkSession, path: str, window: Span, nodata: float | None = None, shape: Shape = SHAPE) -> DataFrame:
    """One row: n, vmin, vmax, n_distinct of a window's cells, as raster.stats; NaN and nodata left out."""
    good = window_counts(spark, path, window, shape).where(~F.isnan("value"))
    if nodata is not None:
        good = good.where(F.col("value") != F.lit(float(nodata)))
    return good.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("value").alias("vmin"), F.max("value").alias("vmax"), F.count("value").alias("n_distinct"))
