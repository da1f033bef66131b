"""Assets in every area of a table: each area is covered by cells of two sizes, and assets meet the cells in an equi-join.

A cell that no side passes is inside or outside as a whole.  Large inner cells settle an asset at once; only where a side
passes a large cell is it divided, and only in a small cell with a side is an asset tested against sides, those of
its row of cells.  So an area's cover grows with its outline, not with its extent, and no asset meets an area that is elsewhere.
An area is a list of rings, read even-odd (holes and several parts need nothing more); a point on a side is out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquill.functions import geo

AREAS = "area_id string, rings array<array<struct<x: double, y: double>>>"
#: Degrees of a small cell's side, and small cells on a large one's.
SIZE, FAN = 0.01, 16
#: By how many parts of a cell the places of sides are widened, which covers what rounding does to them.
SLACK = 1e-6


def sides(areas: DataFrame) -> DataFrame:
    """(area_id, x1, y1, x2, y2) of every side; rings may repeat their first corner, rings of nulls have none."""
    ring = areas.select("area_id", F.explode("rings").alias("r")).where(F.size("r") > 1)
    turned = F.concat(F.slice("r", 2, F.size("r")), F.slice("r", 1, 1))
    pair = F.zip_with("r", turned, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return ring.select("area_id", F.explode(pair).alias("s")).select("area_id", "s.*").where("x1 <> x2 or y1 <> y2")


def cell(v: Column, size: float) -> Column:
    return F.floor(v / geo.number(size)).cast("int")


def rows_of(edges: DataFrame, size: float) -> DataFrame:
    """(area_id, row, sides, spans, crossings): by row of cells the sides that pass it, the columns each does, and where they
    cross the row's middle."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    slack = geo.number(SLACK * size)
    spread = edges.withColumn("row", F.explode(F.sequence(cell(low, size), cell(high, size))))
    at = lambda y: F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1"))
    level = F.col("y1") == F.col("y2")
    bottom, top = F.greatest(low, F.col("row") * geo.number(size)), F.least(high, (F.col("row") + 1) * geo.number(size))
    ends = (F.when(level, F.col("x1")).otherwise(at(bottom)), F.when(level, F.col("x2")).otherwise(at(top)))
    middle = (F.col("row") + geo.number(0.5)) * geo.number(size)
    crossing = F.when((F.col("y1") > middle) != (F.col("y2") > middle), at(middle))
    return spread.groupBy("area_id", "row").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("sides"),
        F.collect_list(F.struct(cell(F.least(*ends) - slack, size).alias("a"), cell(F.greatest(*ends) + slack, size).alias("b"))).alias("spans"),
        F.collect_list(crossing).alias("crossings"),
    )


def passed(col: Column) -> Column:
    return F.exists("spans", lambda s: (s["a"] <= col) & (s["b"] >= col))


def inner(col: Column, size: float) -> Column:
    """Whether a cell that no side passes is inside: an odd number of sides lies to its right."""
    return F.size(F.filter("crossings", lambda x: x > (col + geo.number(0.5)) * geo.number(size))) % 2 == 1


def cover(areas: DataFrame, size: float = SIZE, fan: int = FAN) -> DataFrame:
    """(size, row, col, area_id, sides): size is 1 for large cells, all of them inner, and 0 for small ones; sides is null where a cell is inner."""
    edges = sides(areas)
    large, small = size * fan, rows_of(edges, size)
    wide = rows_of(edges, large)
    cols = F.explode(F.sequence(F.array_min(F.col("spans.a")), F.array_max(F.col("spans.b"))))
    coarse = wide.withColumn("col", cols).select("area_id", "row", "col", passed(F.col("col")).alias("border"), inner(F.col("col"), large).alias("inside"))
    settled = coarse.where("inside and not border").select(F.lit(1).alias("size"), "row", "col", "area_id", F.lit(None).cast("array<struct<x1: double, y1: double, x2: double, y2: double>>").alias("sides"))
    divided = coarse.where("border").select("area_id", F.col("row").alias("large_row"), F.col("col").alias("large_col"))
    # A row of small cells that no side passes has no entry of its own: there a middle line of the large row's small rows decides.
    rows = divided.withColumn("row", F.explode(F.sequence(F.col("large_row") * fan, F.col("large_row") * fan + fan - 1)))
    level = (F.col("row") + geo.number(0.5)) * geo.number(size)
    long_edges = wide.select("area_id", F.col("row").alias("large_row"), F.col("sides").alias("large_sides"))
    met = rows.join(long_edges, ["area_id", "large_row"]).join(small, ["area_id", "row"], "left")
    across = F.filter("large_sides", lambda s: (s["y1"] > level) != (s["y2"] > level))
    crossings = F.transform(across, lambda s: s["x1"] + (s["x2"] - s["x1"]) * (level - s["y1"]) / (s["y2"] - s["y1"]))
    none = F.array().cast("array<struct<a: int, b: int>>")
    each = met.select("area_id", "row", "sides", F.coalesce("spans", none).alias("spans"), crossings.alias("crossings"), F.explode(F.sequence(F.col("large_col") * fan, F.col("large_col") * fan + fan - 1)).alias("col"))
    fine = each.select(F.lit(0).alias("size"), "row", "col", "area_id", F.when(passed(F.col("col")), F.col("sides")).alias("sides"), passed(F.col("col")).alias("border"), inner(F.col("col"), size).alias("inside"))
    return settled.unionByName(fine.where("border or inside").drop("border", "inside"))


def strictly_inside(lon: Column, lat: Column, edges: Column) -> Column:
    """Even-odd over the sides of the point's row of cells; on a side is out."""
    at = lambda e: (e["x1"], e["y1"], e["x2"], e["y2"])
    odd = F.size(F.filter(edges, lambda e: (e["y1"] != e["y2"]) & geo._crosses(lon, lat, *at(e)))) % 2 == 1
    return odd & ~F.exists(edges, lambda e: geo._touches(lon, lat, *at(e)))


def in_areas(places: DataFrame, areas: DataFrame, lon: str = "lon", lat: str = "lat", size: float = SIZE, fan: int = FAN) -> DataFrame:
    """places with area_id: a row for each place and each area (AREAS) that it is strictly inside; places without coordinates are in none."""
    x, y = F.col(lon), F.col(lat)
    key = lambda level, s: F.struct(F.lit(level).alias("size"), cell(y, s).alias("row"), cell(x, s).alias("col"))
    keyed = places.where(x.isNotNull() & y.isNotNull()).withColumn("__key", F.explode(F.array(key(1, size * fan), key(0, size))))
    cells = cover(areas, size, fan).select(F.struct("size", "row", "col").alias("__key"), "area_id", F.col("sides").alias("__sides"))
    found = keyed.join(cells, "__key")
    return found.where(F.col("__sides").isNull() | strictly_inside(x, y, F.col("__sides"))).drop("__key", "__sides")


def count_by_area(assets: DataFrame, areas: DataFrame, layers: Sequence[str], size: float = SIZE, fan: int = FAN) -> DataFrame:
    """(area_id, layer, n): assets (layer, lon, lat) of each layer inside each area, zeros too."""
    found = in_areas(assets.where(F.col("layer").isin(*layers)), areas, size=size, fan=fan).groupBy("area_id", "layer").agg(F.count("*").alias("n"))
    wanted = areas.select("area_id", F.explode(F.array(*map(F.lit, layers))).alias("layer")).distinct()
    return wanted.join(found, ["area_id", "layer"], "left").select("area_id", "layer", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
