"""One polygon, holes and all, for each connected part of a class: the outlines of cells by equi-joins and windows alone.

A lattice point sees four cells.  Which of them have a class says whether the class' outline turns there, so edges between
neighbours of one class cancel without ever being made.  Turns of a lattice line pair up, which gives each turn the next
one of its outline.  Outlines are cycles; pointer jumping tells every turn the least turn of its cycle and how far it is, in as many
rounds as the longest outline's length has binary digits, and only with turns whose outline has not closed.  The sign of its
area tells a hole; the run of cells left of a hole's leftmost edge ends at another outline of the same part, and following
these leads to the part's shell.

Outlines walk along the right hand side's cells clockwise as rasters are drawn, holes the other way round.  Cells that
touch at a corner only are different parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridquill.functions import geo
from gridquill.sources.shared import cut, work_dir
from gridquill.sources.tables import Grid

EAST, SOUTH, WEST, NORTH = range(4)
#: Cells around a lattice point.
UPPER_LEFT, UPPER_RIGHT, LOWER_LEFT, LOWER_RIGHT = 1, 2, 4, 8
#: (in, out) directions of the turns at a point, by the cells around it that have the class: one cell turns the outline
#: around itself, three around the one that lacks, two that touch at the point only each around itself.
_AROUND = {LOWER_RIGHT: (NORTH, EAST), LOWER_LEFT: (EAST, SOUTH), UPPER_LEFT: (SOUTH, WEST), UPPER_RIGHT: (WEST, NORTH)}
_LACKING = {UPPER_LEFT: (EAST, NORTH), UPPER_RIGHT: (SOUTH, EAST), LOWER_RIGHT: (WEST, SOUTH), LOWER_LEFT: (NORTH, WEST)}
TURNS = {k: [v] for k, v in _AROUND.items()} | {15 - k: [v] for k, v in _LACKING.items()} | {a + b: [_AROUND[a], _AROUND[b]] for a, b in ((UPPER_LEFT, LOWER_RIGHT), (UPPER_RIGHT, LOWER_LEFT))}
#: Bits of a coordinate in a turn's id, and what is added so that none is negative.
BITS, SHIFT = 28, 1 << 27


def turn_id(value: Column, y: Column, x: Column, came: Column) -> Column:
    """A long that orders turns by class, row, column and direction."""
    high = F.shiftleft(value.cast("long"), BITS).bitwiseOR(y + SHIFT)
    return F.shiftleft(F.shiftleft(high, BITS).bitwiseOR(x + SHIFT), 2).bitwiseOR(came.cast("long"))


def class_of(turn: Column) -> Column:
    return F.shiftright(turn, 2 * BITS + 2).cast("int")


def y_of(turn: Column) -> Column:
    return (F.shiftright(turn, BITS + 2).bitwiseAND(F.lit(2**BITS - 1)) - SHIFT).cast("int")


def x_of(turn: Column) -> Column:
    return (F.shiftright(turn, 2).bitwiseAND(F.lit(2**BITS - 1)) - SHIFT).cast("int")


def turns(cells: DataFrame) -> DataFrame:
    """(id, out): where outlines of the classes 1 to 5 turn, a row for each outline that does."""
    valued = cells.select("row", "col", geo.severity(F.col("value")).alias("value")).where("value between 1 and 5")
    corner = lambda dy, dx, bit: F.struct((F.col("row") + dy).alias("y"), (F.col("col") + dx).alias("x"), F.lit(bit).alias("bit"))
    seen = valued.select("value", F.explode(F.array(corner(0, 0, LOWER_RIGHT), corner(0, 1, LOWER_LEFT), corner(1, 0, UPPER_RIGHT), corner(1, 1, UPPER_LEFT))).alias("c")).select("value", "c.*")
    masks = seen.groupBy("value", "y", "x").agg(F.sum("bit").cast("int").alias("mask"))
    known = F.create_map(*(x for k, v in TURNS.items() for x in (F.lit(k), F.array(*(F.struct(F.lit(a).alias("came"), F.lit(b).alias("out")) for a, b in v)))))
    found = masks.where(F.col("mask").isin(*TURNS)).select("value", "y", "x", F.explode(F.element_at(known, F.col("mask"))).alias("t"))
    return found.select(turn_id(F.col("value"), F.col("y"), F.col("x"), F.col("t.came")).alias("id"), F.col("t.out").alias("out"))


def successors(found: DataFrame) -> DataFrame:
    """(id, out, next): on a line and in a direction the next turn to come in after one that goes out is where it leads.
    A window has the turns of one class on one lattice line, some raster's side at most."""
    came = F.col("id").bitwiseAND(F.lit(3)).cast("int")
    ends = found.select("id", F.lit(None).cast("int").alias("out"), came.alias("way"), F.lit(0).alias("leaves"))
    both = ends.unionByName(found.select("id", "out", F.col("out").alias("way"), F.lit(1).alias("leaves")))
    level = F.col("way").isin(EAST, WEST)
    place = F.when(level, x_of(F.col("id"))).otherwise(y_of(F.col("id")))
    line = both.select("*", class_of(F.col("id")).alias("value"), F.when(level, y_of(F.col("id"))).otherwise(x_of(F.col("id"))).alias("line"), F.when(F.col("way").isin(EAST, SOUTH), place).otherwise(-place).alias("along"))
    order = Window.partitionBy("value", "way", "line").orderBy("along", "leaves")
    return line.withColumn("next", F.lead("id").over(order)).where("leaves = 1").select("id", "out", "next")


def outlines(found: DataFrame, path: str) -> DataFrame:
    """(id, out, next, ring, off): ring is the least turn of the outline, off how many turns on it is.

    A turn knows the least of the turns up to a pointer; with the pointer's own it knows that of twice as many.  Where both have found
    the same one, the outline has been gone round."""
    names = ("id", "out", "next", "ring", "off", "ahead")
    now = cut(found.select("id", "out", "next", F.col("id").alias("ring"), F.lit(0).cast("long").alias("off"), F.col("next").alias("ahead"), F.lit(False).alias("closed")), f"{path}/0")
    done, step = [], 0
    while True:
        known = reduce(DataFrame.unionByName, [*done, now])
        there = known.select(F.col("id").alias("ahead"), F.col("ring").alias("its_ring"), F.col("off").alias("its_off"), F.col("ahead").alias("its_ahead"), F.col("closed").alias("its_closed"))
        nearer = F.col("its_ring") < F.col("ring")
        moved = now.join(there, "ahead").select(
            "id", "out", "next", F.when(nearer, F.col("its_ring")).otherwise(F.col("ring")).alias("ring"), F.when(nearer, F.col("its_off") + (1 << step)).otherwise(F.col("off")).alias("off"),
            F.col("its_ahead").alias("ahead"), (F.col("its_closed") | (F.col("its_ring") == F.col("ring"))).alias("closed"),
        )
        step += 1
        state = cut(moved, f"{path}/{step}")
        done.append(state.where("closed"))
        now = state.where("not closed")
        if now.isEmpty():
            return reduce(DataFrame.unionByName, done).select(*names[:5])


def rings(cells: DataFrame) -> DataFrame:
    """(value, polygon, ring, hole, off, y, x, next_y, next_x): a row for each turn of every outline and the one that comes next, in lattice
    coordinates: y, x is the upper left corner of cell (row, col).  An outline begins where off is 0 and goes on by falling off; polygon is the ring of the shell.

    Ids are those of turns, so a polygon's class and the upper left corner of its first cell can be read off (class_of, y_of, x_of).
    Rows and columns lie between -2^27 and 2^27; other classes than 1 to 5 have no outline; no cells give no rows."""
    path = work_dir(cells.sparkSession, "outlines")
    walked = cut(outlines(successors(cut(turns(cells), f"{path}/turns")), f"{path}/rounds"), f"{path}/walked")
    area = F.sum(x_of(F.col("id")).cast("long") * y_of(F.col("next")) - x_of(F.col("next")).cast("long") * y_of(F.col("id")))
    sized = walked.groupBy("ring").agg((area < 0).alias("hole"))
    # The edges of a class in a row of cells, from the left: runs begin at edges to the north and end at those to the south.
    y1, y2 = y_of(F.col("id")), y_of(F.col("next"))
    upright = walked.where(F.col("out").isin(NORTH, SOUTH)).select("ring", "out", class_of(F.col("id")).alias("value"), x_of(F.col("id")).alias("x"), F.explode(F.sequence(F.least(y1, y2), F.greatest(y1, y2) - 1)).alias("y"))
    before = F.lag("ring").over(Window.partitionBy("value", "y").orderBy("x"))
    ends = upright.withColumn("left", before).where(F.col("out") == SOUTH).groupBy("ring").agg(F.min_by("left", F.struct("x", "y")).alias("left"))
    found = cut(sized.join(ends, "ring").select("ring", "hole", F.when(F.col("hole"), F.col("left")).otherwise(F.col("ring")).alias("polygon")), f"{path}/parents")
    step, holes = 0, found.where("hole")
    shells = found.where("not hole").select("ring", "hole", "polygon")
    settled = [shells]
    inner = found.where("hole").select(F.col("ring").alias("polygon"), F.col("polygon").alias("onward"))
    while not holes.isEmpty():
        # What a hole has to its left is a shell, or a hole that begins further left.
        state = cut(holes.join(inner, "polygon", "left").select("ring", "hole", F.coalesce("onward", "polygon").alias("polygon"), F.col("onward").isNotNull().alias("moved")), f"{path}/holes-{step}")
        settled.append(state.where("not moved").drop("moved"))
        holes, step = state.where("moved").drop("moved"), step + 1
    parts = reduce(DataFrame.unionByName, settled)
    return walked.join(parts, "ring").select(class_of(F.col("ring")).alias("value"), "polygon", "ring", "hole", "off", y_of(F.col("id")).alias("y"), x_of(F.col("id")).alias("x"), y_of(F.col("next")).alias("next_y"), x_of(F.col("next")).alias("next_x"))


def parts(outline: DataFrame) -> DataFrame:
    """(value, row, col, n_cells, n_holes, n_vertices) of each polygon of rings(); row, col is its first cell."""
    found = outline.groupBy("value", "polygon").agg(F.expr("sum(cast(x as bigint) * next_y - cast(next_x as bigint) * y) div 2").alias("n_cells"), F.count_if(F.col("hole") & (F.col("off") == 0)).alias("n_holes"), F.count("*").alias("n_vertices"))
    return found.select("value", y_of(F.col("polygon")).alias("row"), x_of(F.col("polygon")).alias("col"), "n_cells", "n_holes", "n_vertices")


def polygons(outline: DataFrame, grid: Grid) -> DataFrame:
    """(value, polygon, coordinates): the rings of rings() as GeoJSON's coordinates of a polygon, the shell first and anticlockwise on
    the map, each ring closed.  A polygon is one row, so this is for windows that are shown, not for whole rasters."""
    lon, lat = geo.number(grid.x0) + F.col("x") * geo.number(grid.px), geo.number(grid.y0) - F.col("y") * geo.number(grid.py)
    # Rings walk clockwise on the map; by rising off they walk the other way, from the turn that is nearest before the first.
    points = outline.groupBy("value", "polygon", "ring", "hole").agg(F.array_sort(F.collect_list(F.struct("off", F.array(lon, lat).alias("at")))).alias("p"))
    closed = F.concat(F.col("p.at"), F.slice("p.at", 1, 1))
    each = points.select("value", "polygon", F.struct("hole", "ring", closed.alias("line")).alias("r"))
    return each.groupBy("value", "polygon").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]).alias("coordinates"))


def multipolygons(outline: DataFrame, grid: Grid) -> DataFrame:
    """(value, geometry): GeoJSON text of one MultiPolygon for each class."""
    one = polygons(outline, grid).groupBy("value").agg(F.array_sort(F.collect_list(F.struct("polygon", "coordinates"))).alias("p"))
    return one.select("value", F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("p.coordinates").alias("coordinates"))).alias("geometry"))


def outline_area(outline: DataFrame, grid: Grid) -> DataFrame:
    """(value, n_polygons, n_holes, n_vertices, km2) of each class' polygons together."""
    whole = parts(outline).groupBy("value").agg(F.count("*").alias("n_polygons"), F.sum("n_holes").alias("n_holes"), F.sum("n_vertices").alias("n_vertices"), F.sum("n_cells").alias("cells"))
    return whole.select("value", "n_polygons", "n_holes", "n_vertices", (F.col("cells") * geo.number(grid.px * grid.py * geo.KM_NORTH * geo.KM_EAST)).alias("km2"))
