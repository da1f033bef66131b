"""Queries of assets, roads and rasters, each with the same computation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquill.functions import geo
from gridquill.operators import areas, overlay, polygons, raster
from gridquill.sources import buckets, catalog, geotiff, pyramid
from gridquill.sources import tables as t
from gridquill.sources.shared import cut, work_dir

MIN_SEVERITY = 1
CLIP_BOX = (103.1001, 13.7501, 103.4001, 13.9501)
#: An area with a notch and a hole.
NOTCHED = [[(103.0501, 13.7501), (103.4501, 13.7501), (103.4501, 13.9701), (103.2501, 13.8203), (103.0501, 13.9701)], [(103.1501, 13.7701), (103.2001, 13.7701), (103.1701, 13.8101)]]
#: A star with a notch and a triangular hole, as offsets from an area's corner.
SHAPE = [[(0.0011, 0.0017), (0.1513, 0.0213), (0.1313, 0.0913), (0.0713, 0.0513), (0.0113, 0.0813)], [(0.0613, 0.0213), (0.1013, 0.0313), (0.0713, 0.0413)]]
#: Degrees around a cursor: a cell's own assets and those of the cells at two sides.
REACH = 0.0085
VULNERABILITY = {"vuln_a": 0.4, "vuln_b": 0.35, "vuln_coarse": 0.25}

# Parts of the SQL twins.
CELLS = {
    "hazard": "(SELECT CAST(p_partkey // 50 AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c, CAST(p_size % 6 AS DOUBLE) AS v FROM part)",
    "vuln_a": "(SELECT CAST(p_partkey // 50 AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c, CAST(CAST(floor(p_retailprice) AS INT) % 6 AS DOUBLE) AS v FROM part)",
    "vuln_b": "(SELECT CAST(p_partkey // 50 AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c, CAST((p_partkey * 7 + p_size) % 6 AS DOUBLE) AS v FROM part)",
    "risk_l1": "(SELECT CAST(p_partkey // 50 AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c, CAST((p_size + p_partkey) % 6 AS DOUBLE) AS v FROM part)",
    "vuln_coarse": "(SELECT CAST(s_suppkey // 10 AS INT) AS r, CAST(s_suppkey % 10 AS INT) AS c, CAST(s_nationkey % 6 AS DOUBLE) AS v FROM supplier)",
}
#: The coarse layer on the fine grid.
REGRID = f"(SELECT f.r, f.c, coalesce(s.v, 0) AS v FROM {CELLS['hazard']} f LEFT JOIN {CELLS['vuln_coarse']} s ON s.r = CAST(floor((14.0::double - (14.0::double - (f.r + 0.5::double) * 0.01::double)) / 0.05::double) AS INT) AND s.c = CAST(floor(((103.0::double + (f.c + 0.5::double) * 0.01::double) - 103.0::double) / 0.05::double) AS INT))"
EDGES = "(VALUES " + ", ".join("(" + ", ".join(f"{v!r}::double" for v in e) + ")" for e in geo.edges_of(t.AREA)) + ") AS e(x1, y1, x2, y2)"
ASSETS = """assets AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'buildings' WHEN 'HOUSEHOLD' THEN 'schools' ELSE 'hospitals' END AS layer, c_custkey AS fid, c_name AS name,
 103.0::double + ((c_custkey % 60) + 0.3::double) * 0.01::double AS lon, 14.0::double - (((c_custkey // 60) % 60) + 0.3::double) * 0.01::double AS lat FROM customer)"""
VERTICES = """vertices AS (SELECT l_orderkey AS fid, 103.0::double + ((l_partkey % 50) + 0.3::double) * 0.01::double AS lon, 14.0::double - ((l_partkey // 50) + 0.3::double) * 0.01::double AS lat,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS idx FROM lineitem),
segments AS (SELECT fid, idx, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM vertices WINDOW w AS (PARTITION BY fid ORDER BY idx))"""
KM = "2 * 6371.0088 * asin(sqrt(pow(sin((radians(y2) - radians(y1)) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2)))"


def inside_sql(rows: str, lon: str = "lon", lat: str = "lat") -> str:
    cross = f"(e.y1 > q.{lat}) <> (e.y2 > q.{lat}) AND q.{lon} < (e.x2 - e.x1) * (q.{lat} - e.y1) / (e.y2 - e.y1) + e.x1"
    return f"(SELECT q.* FROM {rows} q WHERE (SELECT count(*) FROM {EDGES} WHERE {cross}) % 2 = 1)"


def cell_join_sql(rows: str, lon: str = "lon", lat: str = "lat", cells: str = CELLS["hazard"]) -> str:
    """rows with severity, by the cell of each."""
    return f"(SELECT p.*, coalesce(CAST(trunc(k.v) AS INT), 0) AS severity FROM {rows} p LEFT JOIN {cells} k ON k.r = CAST(floor((14.0::double - p.{lat}) / 0.01::double) AS INT) AND k.c = CAST(floor((p.{lon} - 103.0::double) / 0.01::double) AS INT))"


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.cells(spark, sf_dir, "hazard")


def fine_layers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    coarse = raster.regrid_nearest(hazard(spark, sf_dir), t.FINE, t.cells(spark, sf_dir, "vuln_coarse"), t.COARSE)
    return {"vuln_a": t.cells(spark, sf_dir, "vuln_a"), "vuln_b": t.cells(spark, sf_dir, "vuln_b"), "vuln_coarse": coarse}


def recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.combine_risk(hazard(spark, sf_dir), fine_layers(spark, sf_dir), VULNERABILITY)


def count_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.count_features(t.assets(spark, sf_dir), t.AREA, catalog.COUNTABLE)


def count_in_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.count_in_hazard(t.assets(spark, sf_dir), hazard(spark, sf_dir), t.FINE, t.AREA, catalog.COUNTABLE, MIN_SEVERITY)


def roads_in_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlay.roads_in_hazard(t.vertices(spark, sf_dir), hazard(spark, sf_dir), t.FINE, t.AREA, MIN_SEVERITY)
    return rounded(found, 4, "km")


def asset_severity_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.sample(t.assets(spark, sf_dir), hazard(spark, sf_dir), t.FINE).select("layer", "fid", "name", "severity")


def road_max_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.road_max_severity(t.vertices(spark, sf_dir), hazard(spark, sf_dir), t.FINE)


def severity_metric_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.metric_payload(t.assets(spark, sf_dir), hazard(spark, sf_dir), t.FINE, t.AREA, catalog.COUNTABLE, catalog.legend(spark, "hazard_flood"), 3)


def road_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = overlay.clip_roads(t.vertices(spark, sf_dir), geo.box_ring(*CLIP_BOX))
    km = geo.haversine_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return rounded(parts.groupBy("fid").agg(F.count("*").alias("n_parts"), F.sum(km).alias("km")), 4, "km")


def road_clip_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads clipped to a ring that is not convex, with a hole."""
    parts = overlay.clip_roads_to_area(t.vertices(spark, sf_dir), NOTCHED)
    km = geo.haversine_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return rounded(parts.groupBy("fid").agg(F.count("*").alias("n_parts"), F.sum(km).alias("km")), 4, "km")


def identify_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies under a cursor at each supplier's place: assets within reach of it, schools drawn last, and the pixel."""
    k = F.col("s_suppkey")
    cursors = t.read(spark, sf_dir, "supplier").select(k.alias("cursor_id"), (F.lit(103.0) + (k % 60 + 0.5) * 0.01).alias("lon"), (F.lit(14.0) - (F.floor(k / 60) % 60 + 0.5) * 0.01).alias("lat"))
    ord_ = F.when(F.col("layer") == "hospitals", 0).when(F.col("layer") == "buildings", 1).otherwise(2)
    features = t.assets(spark, sf_dir).select(ord_.alias("ord"), "layer", "fid", "name", F.when(F.col("fid") % 4 != 0, (F.col("fid") % 6).cast("int")).alias("severity"), "lon", "lat")
    return overlay.identify_hits(cursors, features, hazard(spark, sf_dir), t.FINE, REACH)


def road_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overlay.extent(t.vertices(spark, sf_dir)), 6, "min_lon", "min_lat", "max_lon", "max_lat")


def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.assets(spark, sf_dir).groupBy("layer").agg(F.count("*").alias("n"))


def identify_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = t.cells(spark, sf_dir, "hazard").withColumn("value", F.col("value") - 0.4)
    return overlay.identify(t.assets(spark, sf_dir), halves, t.FINE).select("fid", "pixel")


def mercator_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    xy = geo.mercator(F.col("lon"), F.col("lat"))
    back = geo.from_mercator(F.col("m.x"), F.col("m.y"))
    both = t.assets(spark, sf_dir).select("fid", xy.alias("m")).select("fid", "m", back.alias("b"))
    return both.select("fid", F.round("m.x", 2).alias("x"), F.round("m.y", 2).alias("y"), F.round("b.lon", 6).alias("lon"), F.round("b.lat", 6).alias("lat"))


def hazard_window_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.clip_window(hazard(spark, sf_dir), t.FINE, CLIP_BOX)


def geotiff_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window out of a GeoTIFF raster that holds the hazard cells, staged as a table of cells."""
    path = work_dir(spark, "hazard-tiff")
    geotiff.write_geotiff(hazard(spark, sf_dir), path, t.FINE, tile=16, block=64, dtype="int8", compression="lzw")
    return cut(geotiff.read_geotiff(spark, path, t.FINE, CLIP_BOX), work_dir(spark, "hazard-window"))


def raster_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.stats(raster.clip_window(hazard(spark, sf_dir), t.FINE, CLIP_BOX), nodata=0, stride=2)


def regrid_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fine_layers(spark, sf_dir)["vuln_coarse"]


def combine_l2_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recomputed(spark, sf_dir)


def grid_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.agreement(raster.compare(recomputed(spark, sf_dir), t.cells(spark, sf_dir, "risk_l1")))


def grid_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.confusion(raster.compare(recomputed(spark, sf_dir), t.cells(spark, sf_dir, "risk_l1")))


def best_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.best_weights(hazard(spark, sf_dir), fine_layers(spark, sf_dir), t.cells(spark, sf_dir, "risk_l1"))


def dissolve_class_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.class_runs(hazard(spark, sf_dir))


def dissolve_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.dissolve(hazard(spark, sf_dir))


def dissolved_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.dissolved_area(hazard(spark, sf_dir), t.FINE), 4, "km2")


def class_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.parts(polygons.rings(hazard(spark, sf_dir)))


def class_polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(polygons.outline_area(polygons.rings(hazard(spark, sf_dir)), t.FINE), 4, "km2")


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each class in a window, from the tiles inside it and the cells at its border."""
    path, shape = work_dir(spark, "pyramid"), pyramid.Shape(2, 2, 3)
    pyramid.write_pyramid(hazard(spark, sf_dir), path, shape)
    return pyramid.window_counts(spark, path, raster.window_range(t.FINE, CLIP_BOX), shape)


def stored(spark: SparkSession, **layers: DataFrame) -> dict[str, str]:
    """Layers as bucketed tables, under names of their own."""
    path = work_dir(spark, "layers")
    names = {name: f"{name}_{path[-32:]}" for name in layers}
    for name, cells in layers.items():
        buckets.store_layer(cells, names[name], f"{path}/{name}", 8)
    return names


def stored_l2_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recomputed risk over stored layers."""
    names = stored(spark, hazard=hazard(spark, sf_dir), **fine_layers(spark, sf_dir))
    return buckets.combine_risk(spark, names.pop("hazard"), names, VULNERABILITY)


def stored_grid_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = stored(spark, ours=recomputed(spark, sf_dir), other=t.cells(spark, sf_dir, "risk_l1"))
    return raster.agreement(buckets.compare(spark, names["ours"], names["other"]))


def nation_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An area for each nation: SHAPE moved by its key, so that areas overlap."""
    k = F.col("n_nationkey")
    x, y = geo.number(103.0) + (k % 5) * geo.number(0.1), geo.number(13.9) - F.expr("n_nationkey div 5") * geo.number(0.08)
    ring = lambda corners: F.array(*(F.struct((x + geo.number(dx)).alias("x"), (y + geo.number(dy)).alias("y")) for dx, dy in corners))
    return t.read(spark, sf_dir, "nation").select(F.col("n_name").alias("area_id"), F.array(*map(ring, SHAPE)).alias("rings"))


def count_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hospitals, schools and buildings inside the area of every nation."""
    return areas.count_by_area(t.assets(spark, sf_dir), nation_areas(spark, sf_dir), ("hospitals", "schools", "buildings"), size=0.02, fan=4)


QUERIES = {
    f.__name__: f
    for f in (
        count_features, count_in_hazard, roads_in_hazard, asset_severity_tags, road_max_severity, severity_metric_payload, road_clip, road_clip_area, road_extent, feature_counts, identify_pixels, identify_features, mercator_assets,
        hazard_window_clip, geotiff_window, raster_window_stats, regrid_nearest, combine_l2_risk, grid_agreement, grid_confusion, best_weights, dissolve_class_runs, dissolve_rectangles, dissolved_area, class_polygons, class_polygon_area, count_by_area, window_counts, stored_l2_risk, stored_grid_agreement,
    )
}

LAYERS = "(VALUES ('hospitals'), ('schools'), ('buildings')) AS l(layer)"
_COUNTS = f"counts AS (SELECT layer, severity, count(*) AS n FROM {cell_join_sql(inside_sql('assets'))} GROUP BY ALL)"
_ZERO = f"filled AS (SELECT l.layer, CAST(k.s AS INT) AS severity, coalesce(n, 0) AS n FROM {LAYERS} CROSS JOIN range(1, 6) AS k(s) LEFT JOIN counts ON counts.layer = l.layer AND counts.severity = k.s)"
_ROADS = f"roads AS (SELECT severity, sum(km) AS km FROM {cell_join_sql(inside_sql('(SELECT (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my, ' + KM + ' AS km FROM segments WHERE x2 IS NOT NULL)', 'mx', 'my'), 'mx', 'my')} GROUP BY severity)"


def weighted_sql(weights: dict[str, float], class_max: int = 5) -> str:
    """SELECT of (r, c, v): recomputed risk over the fine layers."""
    cells = {**CELLS, "vuln_coarse": REGRID}
    top = " + ".join(f"CASE WHEN {n}.v > 0 THEN {w!r}::double * {n}.v ELSE 0 END" for n, w in weights.items())
    den = " + ".join(f"CASE WHEN {n}.v > 0 THEN {w!r}::double ELSE 0 END" for n, w in weights.items())
    joins = " ".join(f"LEFT JOIN {cells[n]} {n} ON {n}.r = h.r AND {n}.c = h.c" for n in weights)
    risk = f"least(greatest(round_even(h.v * (({top}) / ({den})) / {class_max}.0::double, 0), 1), {class_max})"
    return f"(SELECT h.r, h.c, CASE WHEN h.v > 0 AND ({den}) > 0 THEN {risk} ELSE 0 END AS v FROM {CELLS['hazard']} h {joins})"


_PAIRS = f"pairs AS (SELECT coalesce(CAST(a.v AS INT), 0) AS ours, coalesce(CAST(b.v AS INT), 0) AS other FROM {weighted_sql(VULNERABILITY)} a FULL JOIN {CELLS['risk_l1']} b ON a.r = b.r AND a.c = b.c WHERE coalesce(a.v, 0) > 0 OR coalesce(b.v, 0) > 0)"
_R1, _R2, _C1, _C2 = raster.window_range(t.FINE, CLIP_BOX)
_WINDOW = f"r BETWEEN {_R1} AND {_R2} AND c BETWEEN {_C1} AND {_C2}"
_CANDIDATES = raster.weight_candidates(3)


def _candidate_sql(i: int, weights: list[float]) -> str:
    table = weighted_sql(dict(zip(VULNERABILITY, weights)))
    return (
        f"SELECT {i} AS candidate, '{','.join(f'{w:g}' for w in weights)}' AS weights, count(*) AS n, round(avg(CAST(d = 0 AS INT)) * 100, 1) AS exact_pct, round(avg(CAST(d <= 1 AS INT)) * 100, 1) AS within1_pct "
        f"FROM (SELECT abs(CAST(a.v AS INT) - CAST(b.v AS INT)) AS d FROM {table} a JOIN {CELLS['risk_l1']} b ON a.r = b.r AND a.c = b.c WHERE a.v > 0 OR b.v > 0)"
    )


_RUNS = f"runs AS (SELECT r, v, min(c) AS c1, max(c) AS c2 FROM (SELECT r, c, v, c - row_number() OVER (PARTITION BY r, v ORDER BY c) AS g FROM {CELLS['hazard']} WHERE v BETWEEN 1 AND 5) GROUP BY r, v, g)"
_RECTANGLES = "rects AS (SELECT v, min(r) AS r1, max(r) AS r2, c1, c2 FROM (SELECT *, r - row_number() OVER (PARTITION BY v, c1, c2 ORDER BY r) AS g FROM runs) GROUP BY v, c1, c2, g)"
_X1, _Y1, _X2, _Y2 = (f"{v!r}::double" for v in CLIP_BOX)

#: Parts of a class by a walk between neighbours, and their corners from the four cells around each lattice point: one cell is a convex
#: corner, three are one that turns inwards; a part has a hole less than a quarter of the difference of their numbers.
_PARTS = f"""cell AS (SELECT r, c, CAST(v AS INT) AS v FROM {CELLS["hazard"]} WHERE v BETWEEN 1 AND 5),
 step AS (SELECT a.v, a.r, a.c, b.r AS r2, b.c AS c2 FROM cell a JOIN cell b ON a.v = b.v AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
 walk AS (SELECT v, r, c, r * 1000000 + c AS least FROM cell UNION SELECT s.v, s.r2, s.c2, w.least FROM walk w JOIN step s ON s.v = w.v AND s.r = w.r AND s.c = w.c WHERE w.least < s.r2 * 1000000 + s.c2),
 part AS (SELECT v, r, c, min(least) AS p FROM walk GROUP BY v, r, c),
 around AS (SELECT v, p, r + dy AS y, c + dx AS x, dy = dx AS main FROM part, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS d(dy, dx)),
 corner AS (SELECT v, y, x, count(*) AS n, bool_and(main) OR bool_and(NOT main) AS across FROM around GROUP BY v, y, x),
 counted AS (SELECT a.v, a.p, count(*) FILTER (WHERE n = 1 OR (n = 2 AND across)) AS convex, count(*) FILTER (WHERE n = 3) AS reflex FROM
 (SELECT DISTINCT a.v, a.p, a.y, a.x, n, across, CASE WHEN n = 2 AND across THEN a.r END AS which FROM (SELECT v, p, r, c, r + dy AS y, c + dx AS x FROM part, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS d(dy, dx)) a JOIN corner k ON k.v = a.v AND k.y = a.y AND k.x = a.x) a GROUP BY a.v, a.p),
 sized AS (SELECT v, p, count(*) AS n_cells FROM part GROUP BY v, p)"""

ORACLE_SQL = {
    "count_features": f"WITH {ASSETS} SELECT l.layer, count(a.fid) AS n FROM {LAYERS} LEFT JOIN {inside_sql('assets')} a ON a.layer = l.layer GROUP BY l.layer",
    "count_in_hazard": f"WITH {ASSETS}, {_COUNTS}, {_ZERO} SELECT layer, severity, n, CAST(sum(CASE WHEN severity >= {MIN_SEVERITY} THEN n ELSE 0 END) OVER (PARTITION BY layer) AS BIGINT) AS n_exposed FROM filled",
    "roads_in_hazard": f"""WITH {VERTICES}, {_ROADS}, f AS (SELECT CAST(k.s AS INT) AS severity, coalesce(km, 0) AS km FROM range(0, 6) AS k(s) LEFT JOIN roads ON roads.severity = k.s)
        SELECT severity, round(km, 4) AS km, (SELECT round(sum(CASE WHEN severity >= {MIN_SEVERITY} THEN round(km, 1) ELSE 0 END), 1) FROM f) AS length_km, (SELECT round(sum(km), 1) FROM f) AS total_km FROM f WHERE severity >= 1""",
    "asset_severity_tags": f"WITH {ASSETS} SELECT layer, fid, name, severity FROM {cell_join_sql('assets')}",
    "road_max_severity": f"WITH {VERTICES} SELECT fid, max(severity) AS severity FROM {cell_join_sql('(SELECT fid, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my FROM segments WHERE x2 IS NOT NULL)', 'mx', 'my')} GROUP BY fid",
    "severity_metric_payload": f"""WITH {ASSETS}, {_COUNTS}, {_ZERO}, legend(severity, label, colour) AS (VALUES {", ".join(f"({i + 1}, '{a}', '{c}')" for i, (a, c) in enumerate(zip(catalog.LEGENDS["hazard_flood"], catalog.DEFAULT_COLOURS)))})
        SELECT f.layer, f.severity, label, colour, n, CAST(sum(CASE WHEN f.severity >= 3 THEN n ELSE 0 END) OVER (PARTITION BY f.layer) AS BIGINT) AS value, f.layer AS unit, (SELECT count(*) FROM assets a WHERE a.layer = f.layer) AS total, 3 AS min_severity
        FROM filled f LEFT JOIN legend ON legend.severity = f.severity""",
    "road_clip": f"""WITH {VERTICES}, d AS (SELECT fid, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM segments WHERE x2 IS NOT NULL),
        p AS (SELECT *, greatest(0, CASE WHEN dx > 0 THEN ({_X1} - x1) / dx WHEN dx < 0 THEN ({_X2} - x1) / dx ELSE 0 END, CASE WHEN dy > 0 THEN ({_Y1} - y1) / dy WHEN dy < 0 THEN ({_Y2} - y1) / dy ELSE 0 END) AS lo,
        least(1, CASE WHEN dx > 0 THEN ({_X2} - x1) / dx WHEN dx < 0 THEN ({_X1} - x1) / dx ELSE 1 END, CASE WHEN dy > 0 THEN ({_Y2} - y1) / dy WHEN dy < 0 THEN ({_Y1} - y1) / dy ELSE 1 END) AS hi FROM d
        WHERE (dx <> 0 OR x1 BETWEEN {_X1} AND {_X2}) AND (dy <> 0 OR y1 BETWEEN {_Y1} AND {_Y2}) AND (dx <> 0 OR dy <> 0)),
        q AS (SELECT fid, x1 + lo * dx AS x1, y1 + lo * dy AS y1, x1 + hi * dx AS x2, y1 + hi * dy AS y2 FROM p WHERE lo < hi)
        SELECT fid, count(*) AS n_parts, round(sum({KM}), 4) AS km FROM q GROUP BY fid""",
    "road_clip_area": f"""WITH {VERTICES}, e(s1, t1, s2, t2) AS (VALUES {", ".join("(" + ", ".join(f"{v!r}::double" for v in x) + ")" for x in geo.edges_of(NOTCHED))}),
        d AS (SELECT fid, idx, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM segments WHERE x2 IS NOT NULL AND (x1 <> x2 OR y1 <> y2)),
        c AS (SELECT d.*, ((s1 - x1) * (t2 - t1) - (t1 - y1) * (s2 - s1)) / (dx * (t2 - t1) - dy * (s2 - s1)) AS t, ((s1 - x1) * dy - (t1 - y1) * dx) / (dx * (t2 - t1) - dy * (s2 - s1)) AS u FROM d CROSS JOIN e WHERE dx * (t2 - t1) - dy * (s2 - s1) <> 0),
        ts AS (SELECT fid, idx, x1, y1, dx, dy, t FROM c WHERE t > 0 AND t < 1 AND u BETWEEN 0 AND 1 UNION SELECT fid, idx, x1, y1, dx, dy, unnest([0.0::double, 1.0::double]) FROM d),
        p AS (SELECT *, lead(t) OVER (PARTITION BY fid, idx ORDER BY t) AS t2 FROM ts), m AS (SELECT *, x1 + (t + t2) / 2 * dx AS mx, y1 + (t + t2) / 2 * dy AS my FROM p WHERE t2 IS NOT NULL),
        q AS (SELECT fid, x1 + t * dx AS x1, y1 + t * dy AS y1, x1 + t2 * dx AS x2, y1 + t2 * dy AS y2 FROM m WHERE (SELECT count(*) FROM e WHERE (t1 > m.my) <> (t2 > m.my) AND m.mx < (s2 - s1) * (m.my - t1) / (t2 - t1) + s1) % 2 = 1)
        SELECT fid, count(*) AS n_parts, round(sum({KM}), 4) AS km FROM q GROUP BY fid""",
    "identify_features": f"""WITH {ASSETS}, cur AS (SELECT s_suppkey AS cursor_id, 103.0::double + (s_suppkey % 60 + 0.5::double) * 0.01::double AS x, 14.0::double - ((s_suppkey // 60) % 60 + 0.5::double) * 0.01::double AS y FROM supplier),
        f AS (SELECT CASE layer WHEN 'hospitals' THEN 0 WHEN 'buildings' THEN 1 ELSE 2 END AS ord, layer, fid, name, CAST(fid % 6 AS INT) AS severity, lon, lat FROM assets WHERE fid % 4 <> 0),
        p AS (SELECT cursor_id, CAST(floor((14.0::double - y) / 0.01::double) AS INT) AS r, CAST(floor((x - 103.0::double) / 0.01::double) AS INT) AS c FROM cur),
        h AS (SELECT cursor_id, 0 AS kind, ord, fid, layer, name, severity FROM cur JOIN f ON (x - lon) * (x - lon) + (y - lat) * (y - lat) <= {REACH} * {REACH}
        UNION ALL SELECT cursor_id, 1, 0, 0, 'raster', NULL, CAST(floor(v + 0.5) AS INT) FROM p JOIN {CELLS["hazard"]} k USING (r, c) WHERE v > 0)
        SELECT cursor_id, CAST(row_number() OVER (PARTITION BY cursor_id ORDER BY kind, ord DESC, fid) AS INT) AS at, layer, name, severity FROM h""",
    "road_extent": f"WITH {VERTICES} SELECT round(min(lon), 6) AS min_lon, round(min(lat), 6) AS min_lat, round(max(lon), 6) AS max_lon, round(max(lat), 6) AS max_lat FROM vertices",
    "feature_counts": f"WITH {ASSETS} SELECT layer, count(*) AS n FROM assets GROUP BY layer",
    "identify_pixels": f"WITH {ASSETS} SELECT fid, CAST(floor(k.v - 0.4 + 0.5) AS INT) AS pixel FROM assets a LEFT JOIN (SELECT * FROM {CELLS['hazard']} WHERE v - 0.4 > 0) k ON k.r = CAST(floor((14.0::double - lat) / 0.01::double) AS INT) AND k.c = CAST(floor((lon - 103.0::double) / 0.01::double) AS INT)",
    "mercator_assets": f"WITH {ASSETS} SELECT fid, round(radians(lon) * 6378137, 2) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 2) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM assets",
    "hazard_window_clip": f'SELECT r AS "row", c AS col, v AS value FROM {CELLS["hazard"]} WHERE {_WINDOW}',
    "geotiff_window": f'SELECT r AS "row", c AS col, v AS value FROM {CELLS["hazard"]} WHERE {_WINDOW} AND v <> 0',
    "raster_window_stats": f"SELECT count(*) AS n, min(v) AS vmin, max(v) AS vmax, count(DISTINCT v) AS n_distinct FROM {CELLS['hazard']} WHERE {_WINDOW} AND r % 2 = 0 AND c % 2 = 0 AND v <> 0",
    "regrid_nearest": f'SELECT r AS "row", c AS col, v AS value FROM {REGRID}',
    "combine_l2_risk": f'SELECT r AS "row", c AS col, CAST(v AS DOUBLE) AS value FROM {weighted_sql(VULNERABILITY)}',
    "grid_agreement": f"WITH {_PAIRS} SELECT count(*) AS n, round(avg(CAST(ours = other AS INT)) * 100, 1) AS exact_pct, round(avg(CAST(abs(ours - other) <= 1 AS INT)) * 100, 1) AS within1_pct, round(avg(abs(ours - other)), 3) AS mean_abs_diff FROM pairs",
    "grid_confusion": f"WITH {_PAIRS} SELECT ours, other, count(*) AS n FROM pairs GROUP BY ours, other",
    "best_weights": f"SELECT *, row_number() OVER (ORDER BY within1_pct DESC, candidate) = 1 AS best FROM ({' UNION ALL '.join(_candidate_sql(i, w) for i, w in enumerate(_CANDIDATES))})",
    "dissolve_class_runs": f'WITH {_RUNS} SELECT r AS "row", CAST(v AS INT) AS value, c1 AS col_from, c2 AS col_to FROM runs',
    "dissolve_rectangles": f"WITH {_RUNS}, {_RECTANGLES} SELECT CAST(v AS INT) AS value, r1 AS row_from, r2 AS row_to, c1 AS col_from, c2 AS col_to FROM rects",
    "dissolved_area": f"WITH {_RUNS}, {_RECTANGLES} SELECT CAST(v AS INT) AS value, count(*) AS n_parts, round(sum((r2 - r1 + 1) * (c2 - c1 + 1)) * (0.01 * 0.01 * 111.0 * 108.0)::double, 4) AS km2 FROM rects GROUP BY v",
    "class_polygons": f"""WITH RECURSIVE {_PARTS} SELECT s.v AS value, CAST(s.p // 1000000 AS INT) AS "row", CAST(s.p % 1000000 AS INT) AS col, n_cells, CAST(1 - (convex - reflex) / 4 AS BIGINT) AS n_holes, convex + reflex AS n_vertices
        FROM sized s JOIN counted k ON k.v = s.v AND k.p = s.p""",
    "class_polygon_area": f"""WITH RECURSIVE {_PARTS} SELECT s.v AS value, count(*) AS n_polygons, CAST(sum(1 - (convex - reflex) / 4) AS BIGINT) AS n_holes, CAST(sum(convex + reflex) AS BIGINT) AS n_vertices,
        round(sum(n_cells) * (0.01 * 0.01 * 111.0 * 108.0)::double, 4) AS km2 FROM sized s JOIN counted k ON k.v = s.v AND k.p = s.p GROUP BY s.v""",
    "count_by_area": f"""WITH {ASSETS}, sides(dx1, dy1, dx2, dy2) AS (VALUES {", ".join("(" + ", ".join(f"{v!r}::double" for v in e) + ")" for e in geo.edges_of(SHAPE))}),
        spot AS (SELECT n_name AS area_id, 103.0::double + (n_nationkey % 5) * 0.1::double AS x, 13.9::double - (n_nationkey // 5) * 0.08::double AS y FROM nation),
        e AS (SELECT area_id, x + dx1 AS x1, y + dy1 AS y1, x + dx2 AS x2, y + dy2 AS y2 FROM spot CROSS JOIN sides),
        hits AS (SELECT area_id, layer, fid FROM assets a JOIN e ON (e.y1 > a.lat) <> (e.y2 > a.lat) AND a.lon < (e.x2 - e.x1) * (a.lat - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY area_id, layer, fid HAVING count(*) % 2 = 1),
        n AS (SELECT area_id, layer, count(*) AS n FROM hits GROUP BY area_id, layer)
        SELECT spot.area_id, l.layer, coalesce(n.n, 0) AS n FROM spot CROSS JOIN {LAYERS} LEFT JOIN n ON n.area_id = spot.area_id AND n.layer = l.layer""",
}
ORACLE_SQL["window_counts"] = f"SELECT v AS value, count(*) AS n FROM {CELLS['hazard']} WHERE {_WINDOW} GROUP BY v"
ORACLE_SQL |= {"stored_l2_risk": ORACLE_SQL["combine_l2_risk"], "stored_grid_agreement": ORACLE_SQL["grid_agreement"]}
