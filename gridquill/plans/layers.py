"""Queries of contracts, layer plans and places, each with the same computation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquill.functions import text as tx
from gridquill.operators import contracts, planning
from gridquill.plans.exposure import CELLS, rounded
from gridquill.sources import catalog
from gridquill.sources import tables as t

#: What isn't available, so that every branch of a plan occurs.
LACKING = ("hazard_tsunami", "risk_flood", "risk_tsunami", "risk_landslide")
ASKED = ("flood", "hazard_flood", "risk_landslide_l2", "landslides", "tsunami", "Risk_Fire", "volcano", "earthquake")
REPLIES = ("1", "2 please", "the official one", "recompute it", "exposure", "whatever", "9", "L2")
LOOSE = ("flood", "hazard_storm", "slide", "quake", "snow", "Risk_Fire")
OBSERVED = [
    ("hazard_flood", "int8", 0.0, 5.0, None, 4326, 0.00089831528412),
    ("vulnerability_pop_all_total", "int16", 0.0, 7.0, 0.0, 4326, 0.01),
    ("vulnerability_reclass_road", "int8", -1.0, 5.0, None, 3857, 0.01),
    ("global_pc_h100glob", "uint32", 0.0, 20000.0, None, 4326, 0.01),
    ("risk_flood", "uint8", None, None, 255.0, None, 0.01),
    ("hazard_storm", "float32", 0.0, 5.00005, 9.0, 4326, 0.5),
    ("hazard_unknown", "int8", 0.0, 5.0, None, 4326, 0.01),
]


def available(spark: SparkSession) -> DataFrame:
    layers = [x for h in catalog.HAZARDS for x in h[1:3]] + list(catalog.WEIGHT_LAYERS)
    return spark.createDataFrame([(x,) for x in layers if x not in LACKING], "layer string")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated statistics of some rasters, and the real ones of the hazard cells under one name."""
    real = t.cells(spark, sf_dir, "hazard").agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    row = real.select(F.lit("hazard_fire").alias("layer"), F.lit("int8").alias("dtype"), "vmin", "vmax", F.lit(None).cast("double").alias("nodata"), F.lit(4326).alias("epsg"), F.lit(0.01).alias("pixel"))
    return spark.createDataFrame(OBSERVED, contracts.OBSERVED).unionByName(row)


def raster_contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contracts.check_contracts(observed(spark, sf_dir), catalog.contracts(spark))
    first = F.array_join(F.transform("mismatches", lambda m: F.substring_index(m, " ", 1)), ",")
    return found.select("layer", "ok", F.size("mismatches").alias("n_mismatches"), first.alias("fields"))


def contract_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.roll_up(contracts.check_contracts(observed(spark, sf_dir), catalog.contracts(spark)))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads made of suppliers: bounds, sizes and values by their keys."""
    k = F.col("s_suppkey")
    return t.read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("up-"), k.cast("string")).alias("layer"), F.when(k % 11 == 0, "0-9").when(k % 2 == 0, "1-5").otherwise("0-5").alias("scale"), F.when(k % 29 == 0, 0).otherwise(k * 3_000_000).alias("n_bytes"),
        F.when(k % 13 == 0, 3).otherwise(1).alias("bands"), F.when(k % 17 == 0, F.lit(None)).when(k % 7 == 0, 3857).otherwise(4326).alias("epsg"),
        (k % 180).cast("double").alias("min_lon"), (k % 40).cast("double").alias("min_lat"), F.when(k % 19 == 0, (k % 180).cast("double")).when(k % 23 == 0, F.lit("Infinity").cast("double")).otherwise((k % 180 + 2).cast("double")).alias("max_lon"), (k % 40 + 2).cast("double").alias("max_lat"),
        (k * 1000).alias("width"), F.lit(70_000).cast("long").alias("height"), (k % 3).cast("double").alias("vmin"), (k % 7).cast("double").alias("vmax"), (k % 50).alias("n_distinct"),
    )


def upload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contracts.gate_uploads(uploads(spark, sf_dir))
    return found.select("layer", "ok", F.array_join("fails", "; ").alias("fails"), F.array_join("warns", "; ").alias("warns"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("n_nationkey") % len(ASKED) + 1).cast("int"))
    want = F.nullif((F.col("n_nationkey") % 3).cast("int"), F.lit(0))
    return t.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("request_id"), asked.alias("asked"), want.alias("wanted_level"))


def layer_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = planning.layer_plans(requests(spark, sf_dir), catalog.hazards(spark), catalog.recipes(spark), available(spark))
    return found.withColumn("missing", F.array_join("missing", ","))


def l2_missing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.missing_inputs(catalog.hazards(spark), catalog.recipes(spark), available(spark))


def answer_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.answer_options(catalog.hazards(spark), catalog.recipes(spark), available(spark))


def option_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    reply = F.element_at(F.array(*map(F.lit, REPLIES)), (n % len(REPLIES) + 1).cast("int"))
    logical = F.element_at(F.array(*(F.lit(h[0]) for h in catalog.HAZARDS)), (n % len(catalog.HAZARDS) + 1).cast("int"))
    replies = t.read(spark, sf_dir, "nation").select(n.alias("reply_id"), logical.alias("logical"), reply.alias("reply"))
    return planning.choose(replies, planning.answer_options(catalog.hazards(spark), catalog.recipes(spark), available(spark)))


def resolve_layer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(x,) for x in LOOSE], "asked string")
    layers = spark.createDataFrame([(i, h[1]) for i, h in enumerate(catalog.HAZARDS)], "ord int, layer string")
    return planning.resolve_layers(names, layers)


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places made of customers: a query is a nation, a place one of its customers."""
    k = F.col("c_custkey")
    rows = t.read(spark, sf_dir, "customer").join(t.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.element_at(F.array(*map(F.lit, ("administrative", "village", "town", "suburb", "hamlet"))), (k % 5 + 1).cast("int"))
    return rows.select(
        F.col("n_name").alias("query"), k.alias("ord"), F.concat("c_name", F.lit(", "), "n_name").alias("name"), F.when(k % 5 == 0, "boundary").otherwise("place").alias("class"), kind.alias("type"),
        F.when(k % 2 == 0, "Polygon").otherwise("Point").alias("gtype"), ((k * 37) % 4000).cast("double").alias("km2"), (100 + k % 30).cast("double").alias("lon"), (k % 60 - 20).cast("double").alias("lat"),
    )


def boundary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.boundaries(gazetteer(spark, sf_dir))


def best_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.centres(gazetteer(spark, sf_dir))


def area_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(planning.areas(gazetteer(spark, sf_dir), cap=20.0), 6, "min_lon", "min_lat", "max_lon", "max_lat")


def area_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of nations, those without a small boundary by a second search under the name of their best settlement."""

    def search(names: DataFrame) -> DataFrame:
        k = F.col("c_custkey")
        known = t.read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(
            F.col("c_name").alias("query"), k.alias("ord"), F.concat("c_name", F.lit(" again, there")).alias("name"), F.lit("boundary").alias("class"), F.lit("administrative").alias("type"), F.lit("MultiPolygon").alias("gtype"),
            ((k * 53) % 40).cast("double").alias("km2"), (k % 30).cast("double").alias("lon"), (k % 20).cast("double").alias("lat"),
        )
        return known.join(names, "query", "left_semi")

    found = planning.areas_with_retry(gazetteer(spark, sf_dir), search, cap=10.0)
    return rounded(found, 6, "min_lon", "min_lat", "max_lon", "max_lat")


def place_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read(spark, sf_dir, "part")
    name = F.concat(F.lit(" The "), "p_name", F.lit(" & Co. / "), "p_brand", F.lit("!"))
    return rows.select("p_partkey", tx.slug(name).alias("place"), tx.slug(name, "_", "layer").alias("layer"), tx.slug(F.lit("--")).alias("nothing"))


def share_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    url = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("https://files.example.com/d/a"), k, F.lit("/view"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("https://files.example.com/uc?export=1&id=b"), k, F.lit("&x=2"))).otherwise(F.lit("https://files.example.com/"))
    return t.read(spark, sf_dir, "part").select("p_partkey", tx.share_file_id(url).alias("file_id"))


QUERIES = {f.__name__: f for f in (raster_contract_check, contract_roll_up, upload_gate, layer_plan, l2_missing_inputs, answer_options, option_choices, resolve_layer_names, boundary_candidates, best_center, area_resolution, area_retries, place_slugs, share_links)}

_sql = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}::double"
_VALUES = lambda rows: ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
_OBSERVED = f"""obs(layer, dtype, vmin, vmax, nodata, epsg, pixel) AS (SELECT * FROM (VALUES {_VALUES(OBSERVED)}) UNION ALL SELECT 'hazard_fire', 'int8', min(v), max(v), NULL, 4326, 0.01 FROM {CELLS["hazard"]})"""
_DECLARED = ", ".join(
    "("
    + ", ".join([_sql(k), *(_sql(c.get(f)) for f in ("dtype", "valid_min", "valid_max", "nodata", "pixel")), *("true" if f in c else "false" for f in ("nodata", "pixel"))])
    + ")"
    for k, c in catalog.CONTRACTS.items()
)
_CHECKED = f"""{_OBSERVED}, want(layer, dtype, lo, hi, nodata, pixel, has_nodata, has_pixel) AS (VALUES {_DECLARED}),
 checked AS (SELECT o.layer, list_filter([CASE WHEN w.layer IS NULL THEN 'no' END, CASE WHEN w.dtype IS NOT NULL AND o.dtype IS DISTINCT FROM w.dtype THEN 'dtype' END,
 CASE WHEN o.vmax > w.hi + 1e-4 THEN 'max' END, CASE WHEN o.vmin < w.lo - 1e-4 THEN 'min' END,
 CASE WHEN w.has_nodata AND (CASE WHEN w.nodata IS NULL OR o.nodata IS NULL THEN w.nodata IS DISTINCT FROM o.nodata ELSE abs(w.nodata - o.nodata) > 1e-4 END) THEN 'nodata' END,
 CASE WHEN w.layer IS NOT NULL AND o.epsg IS DISTINCT FROM 4326 THEN 'crs' END, CASE WHEN w.has_pixel AND abs(o.pixel - w.pixel) > 1e-6 THEN 'pixel_size' END], lambda x: x IS NOT NULL) AS f
 FROM obs o LEFT JOIN want w ON w.layer = o.layer)"""
_HAZARDS = f"hazards(ord, logical, hazard, risk) AS (VALUES {', '.join(f'({i}, {_sql(h[0])}, {_sql(h[1])}, {_sql(h[2])})' for i, h in enumerate(catalog.HAZARDS))})"
_LACK = "(" + ", ".join(map(_sql, LACKING)) + ")"
_OPTIONS = f"""{_HAZARDS}, opts AS (SELECT logical, 1 AS ord, 'exposure' AS option, hazard AS layer FROM hazards WHERE hazard NOT IN {_LACK}
 UNION ALL SELECT logical, 2, 'risk-L1', risk FROM hazards WHERE risk NOT IN {_LACK} UNION ALL SELECT logical, 3, 'risk-L2', risk || '_l2' FROM hazards WHERE hazard NOT IN {_LACK}),
 options AS (SELECT logical, CAST(row_number() OVER (PARTITION BY logical ORDER BY ord) AS INT) AS n, option, layer FROM opts)"""
_LIST = lambda xs: "[" + ", ".join(map(_sql, xs)) + "]"
_GAZETTEER = """gazetteer AS (SELECT n_name AS query, c_custkey AS ord, c_name AS name, c_custkey % 5 = 0 AS admin, ['administrative', 'village', 'town', 'suburb', 'hamlet'][c_custkey % 5 + 1] AS type, c_custkey % 2 = 0 AS poly,
 CAST((c_custkey * 37) % 4000 AS DOUBLE) AS km2, CAST(100 + c_custkey % 30 AS DOUBLE) AS lon, CAST(c_custkey % 60 - 20 AS DOUBLE) AS lat FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_BEST = lambda cap: f"bounds AS (SELECT query, name, km2 FROM gazetteer WHERE admin AND poly AND km2 <= {cap} QUALIFY row_number() OVER (PARTITION BY query ORDER BY km2 DESC, ord) = 1)"
_CENTRES = "centres AS (SELECT query, name, lon, lat FROM gazetteer QUALIFY row_number() OVER (PARTITION BY query ORDER BY CASE type WHEN 'town' THEN 2 WHEN 'village' THEN 4 WHEN 'suburb' THEN 5 ELSE 6 END, ord) = 1)"

ORACLE_SQL = {
    "raster_contract_check": f"WITH {_CHECKED} SELECT layer, len(f) = 0 AS ok, CAST(len(f) AS INT) AS n_mismatches, array_to_string(f, ',') AS fields FROM checked",
    "contract_roll_up": f"WITH {_CHECKED} SELECT count(*) AS n, count(*) FILTER (len(f) = 0) AS n_ok, bool_and(len(f) = 0) AS ok FROM checked",
    "upload_gate": """WITH u AS (SELECT s_suppkey AS k, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 2 = 0 THEN 1 ELSE 0 END AS lo, CASE WHEN k % 29 = 0 THEN 0 ELSE k * 3000000 END AS n_bytes, k % 3 AS vmin, k % 7 AS vmax FROM supplier),
        m AS (SELECT k, list_filter([CASE WHEN n_bytes = 0 THEN 'the file is empty' END, CASE WHEN n_bytes > 209715200 THEN 'the file is too large' END, CASE WHEN lo IS NULL THEN 'unknown scale 0-9' END,
        CASE WHEN k % 13 = 0 THEN '3 bands; a single-band raster is needed' END, CASE WHEN k % 17 = 0 THEN 'no CRS' END, CASE WHEN k % 23 = 0 AND k % 19 <> 0 THEN 'non-finite bounds' END, CASE WHEN k % 19 = 0 THEN 'degenerate bounds' END,
        CASE WHEN k * 70000000 > 3000000000 THEN CAST(k * 70000000 AS VARCHAR) || ' pixels; too many' END, CASE WHEN vmax > 5 THEN 'max ' || vmax || ' > 5' END, CASE WHEN vmin < lo THEN 'min ' || vmin || ' < ' || lo END], lambda x: x IS NOT NULL) AS f,
        list_filter([CASE WHEN k % 17 <> 0 AND k % 7 = 0 THEN 'EPSG:3857 will need reprojection' END,
        CASE WHEN NOT (k % 23 = 0 AND k % 19 <> 0) AND ((CASE WHEN k % 19 = 0 THEN k % 180 ELSE k % 180 + 2 END) < 92 OR k % 180 > 141 OR k % 40 + 2 < -11 OR k % 40 > 29) THEN 'outside the region window' END,
        CASE WHEN k % 50 > 32 THEN (k % 50) || ' distinct values; looks continuous' END], lambda x: x IS NOT NULL) AS w FROM u)
        SELECT 'up-' || k AS layer, len(f) = 0 AS ok, array_to_string(f, '; ') AS fails, array_to_string(w, '; ') AS warns FROM m""",
    "layer_plan": f"""WITH {_HAZARDS}, req AS (SELECT n_nationkey AS request_id, {_LIST(ASKED)}[n_nationkey % {len(ASKED)} + 1] AS asked, nullif(n_nationkey % 3, 0) AS want FROM nation),
        m AS (SELECT r.*, h.*, h.risk NOT IN {_LACK} AS l1, h.hazard NOT IN {_LACK} AS l2 FROM req r LEFT JOIN hazards h ON regexp_replace(regexp_replace(lower(asked), '^(hazard_|risk_)+', ''), '_l2$', '') IN (h.logical, replace(h.hazard, 'hazard_', ''))),
        p AS (SELECT *, CASE WHEN hazard IS NULL THEN NULL WHEN coalesce(want, 1) <> 2 AND l1 THEN 1 WHEN coalesce(want, 2) <> 1 AND l2 THEN 2 END AS level FROM m)
        SELECT request_id, asked, CAST(want AS INT) AS wanted_level, logical, CAST(level AS INT) AS level, CASE level WHEN 1 THEN risk WHEN 2 THEN risk || '_l2' END AS layer, CASE WHEN level = 2 AND l1 THEN risk END AS oracle,
        CASE WHEN hazard IS NULL THEN 'unknown hazard ''' || asked || '''' WHEN level IS NOT NULL THEN '' WHEN l2 THEN 'no ' || risk ELSE hazard END AS missing FROM p""",
    "l2_missing_inputs": f"WITH {_HAZARDS} SELECT logical, hazard AS layer FROM hazards WHERE hazard IN {_LACK}",
    "answer_options": f"WITH {_OPTIONS} SELECT logical, n, option, layer FROM options",
    "option_choices": f"""WITH {_OPTIONS}, replies AS (SELECT n_nationkey AS reply_id, {_LIST([h[0] for h in catalog.HAZARDS])}[n_nationkey % {len(catalog.HAZARDS)} + 1] AS logical, lower({_LIST(REPLIES)}[n_nationkey % {len(REPLIES)} + 1]) AS said FROM nation)
        SELECT reply_id, option, layer FROM replies JOIN options USING (logical) QUALIFY row_number() OVER (PARTITION BY reply_id ORDER BY CASE WHEN regexp_matches(said, '^[0-9]') AND CAST(substr(said, 1, 1) AS VARCHAR) = CAST(n AS VARCHAR) THEN 0
        WHEN option = 'exposure' AND regexp_matches(said, 'exposure|raw|hazard|flooded|expos') OR option = 'risk-L1' AND regexp_matches(said, 'l1|precomp|official') OR option = 'risk-L2' AND regexp_matches(said, 'l2|recomp|comput|custom|weight') THEN 1 ELSE 2 END, n) = 1""",
    "resolve_layer_names": f"""WITH {_HAZARDS}, names AS (SELECT unnest({_LIST(LOOSE)}) AS asked)
        SELECT asked, layer FROM (SELECT asked, CASE WHEN hazard = lower(asked) THEN 0 WHEN hazard = 'hazard_' || lower(asked) THEN 1 WHEN contains(hazard, lower(asked)) THEN 2 END AS fit, ord, CASE WHEN fit IS NOT NULL THEN hazard END AS layer FROM names CROSS JOIN hazards)
        QUALIFY row_number() OVER (PARTITION BY asked ORDER BY fit NULLS LAST, ord) = 1""",
    "boundary_candidates": f"WITH {_GAZETTEER}, {_BEST(1500)} SELECT query, name, km2 FROM bounds",
    "best_center": f"WITH {_GAZETTEER}, {_CENTRES} SELECT query, name, lon, lat FROM centres",
    "area_resolution": f"""WITH {_GAZETTEER}, {_BEST(20)}, {_CENTRES} SELECT c.query, coalesce(b.name, c.name) AS name, CASE WHEN b.name IS NULL THEN 'radius_box' ELSE 'nominatim' END AS how, b.km2,
        CASE WHEN b.name IS NULL THEN round(lon - 12 / (111 * greatest(cos(radians(lat)), 0.01)), 6) END AS min_lon, CASE WHEN b.name IS NULL THEN round(lat - 12.0::double / 111, 6) END AS min_lat,
        CASE WHEN b.name IS NULL THEN round(lon + 12 / (111 * greatest(cos(radians(lat)), 0.01)), 6) END AS max_lon, CASE WHEN b.name IS NULL THEN round(lat + 12.0::double / 111, 6) END AS max_lat FROM centres c LEFT JOIN bounds b USING (query)""",
    "area_retries": f"""WITH {_GAZETTEER}, {_BEST(10)}, {_CENTRES}, again AS (SELECT c_name AS canonical, c_name || ' again' AS name, CAST((c_custkey * 53) % 40 AS DOUBLE) AS km2, CAST(c_custkey % 30 AS DOUBLE) AS lon, CAST(c_custkey % 20 AS DOUBLE) AS lat FROM customer WHERE c_custkey % 3 <> 0),
        x AS (SELECT c.query, c.name AS canonical, b.name AS b_name, b.km2 AS b_km2, c.lon, c.lat, a.name AS a_name, a.km2 AS a_km2, a.lon AS a_lon, a.lat AS a_lat, b.name IS NULL AND a.name IS NOT NULL AS retried FROM centres c LEFT JOIN bounds b USING (query) LEFT JOIN again a ON a.canonical = c.name),
        y AS (SELECT query, CASE WHEN retried THEN a_name ELSE coalesce(b_name, canonical) END AS name, CASE WHEN retried THEN CASE WHEN a_km2 <= 10 THEN a_km2 END ELSE b_km2 END AS km2, CASE WHEN retried THEN a_lon ELSE lon END AS lon, CASE WHEN retried THEN a_lat ELSE lat END AS lat, CASE WHEN retried THEN canonical END AS corrected FROM x)
        SELECT query, name, CASE WHEN km2 IS NULL THEN 'radius_box' ELSE 'nominatim' END AS how, km2, CASE WHEN km2 IS NULL THEN round(lon - 12 / (111 * greatest(cos(radians(lat)), 0.01)), 6) END AS min_lon, CASE WHEN km2 IS NULL THEN round(lat - 12.0::double / 111, 6) END AS min_lat,
        CASE WHEN km2 IS NULL THEN round(lon + 12 / (111 * greatest(cos(radians(lat)), 0.01)), 6) END AS max_lon, CASE WHEN km2 IS NULL THEN round(lat + 12.0::double / 111, 6) END AS max_lat, corrected FROM y""",
    "place_slugs": """SELECT p_partkey, regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS place, regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS layer, '_' AS nothing
        FROM (SELECT p_partkey, ' The ' || p_name || ' & Co. / ' || p_brand || '!' AS n FROM part)""",
    "share_links": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a' || p_partkey WHEN 1 THEN 'b' || p_partkey END AS file_id FROM part",
}
