"""Queries of menus and parsed requests, each with the same computation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquill.operators import menus
from gridquill.sources import catalog
from gridquill.sources import tables as t

#: Layers that a reader doesn't see.
INTERNAL = ("hazard_drought", "hazard_fire")


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(i, h[1], f" {h[0]} classes ", h[1] in INTERNAL or None) for i, h in enumerate(catalog.HAZARDS)]
    return spark.createDataFrame(rows, "ord int, layer string, description string, internal boolean")


def layer_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The menu of each region's readers, whose own layers are named after its nations; one takes a catalogue layer's name."""
    k = F.col("n_nationkey")
    own = t.read(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("thread_id"), (k + 100).alias("ord"), F.when(k % 5 == 0, "hazard_flood").otherwise(F.lower("n_name")).alias("layer"), F.concat(F.lit("own "), k.cast("string")).alias("description")
    )
    own = own.dropDuplicates(["thread_id", "layer"]).withColumn("description", F.when(F.col("layer") == "hazard_flood", "own flood").otherwise(F.col("description"))).withColumn("ord", F.when(F.col("layer") == "hazard_flood", 99).otherwise(F.col("ord")))
    return menus.menu(menus.overlay_catalogue(catalogue(spark), own), "thread_id")


def geometry_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("Point", "MultiPoint", "LineString", "MultiPolygon", "GeometryCollection")))
    rows = t.read(spark, sf_dir, "supplier").select("s_nationkey", F.element_at(names, F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey") % 5).otherwise(F.col("s_suppkey") % 2).cast("int") + 1).alias("geom_type"))
    return menus.layer_kinds(rows, "s_nationkey")


def request_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments as a model would send them, some broken, and what a search asks by them."""
    k = F.col("c_custkey")
    good = F.concat(F.lit('{"crop": " '), F.lower("c_mktsegment"), F.lit(' ", "country": "n'), F.col("c_nationkey").cast("string"), F.lit('"}'))
    raw = F.when(k % 4 == 0, good).when(k % 4 == 1, F.lit('{"focus": "yield"}')).when(k % 4 == 2, F.lit('["a"]')).otherwise(F.lit('{"crop": "ma'))
    rows = t.read(spark, sf_dir, "customer").select("c_custkey", menus.parsed_arguments(raw, F.lit("what now")).alias("a"))
    both = rows.select("c_custkey", "a", menus.query_texts(F.col("a.crop"), F.col("a.country"), F.col("a.focus")).alias("q"))
    return both.select("c_custkey", "a.crop", "a.country", "a.focus", F.when(F.col("a").isNotNull(), F.col("q.forecast")).alias("forecast"), F.when(F.col("a").isNotNull(), F.col("q.retrospective")).alias("retrospective"))


def override_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    country, crop = F.when(k % 3 == 0, F.lit(" ")).otherwise(F.lower("n_name")), F.when(k % 4 == 0, "maize").when(k % 4 == 1, F.lit(None)).otherwise("Rice")
    rows = t.read(spark, sf_dir, "nation")
    return rows.select("n_nationkey", menus.override_applies(country, crop, F.col("n_name"), F.lit("Maize")).alias("applies"), menus.refusal(F.when(k % 5 == 0, F.lit(" EWS")).otherwise(F.col("n_name"))).alias("refusal"))


QUERIES = {f.__name__: f for f in (layer_menu, geometry_kinds, request_arguments, override_targets)}

_SHARED = ", ".join(f"({i}, '{h[1]}', '{h[0]} classes')" for i, h in enumerate(catalog.HAZARDS) if h[1] not in INTERNAL)
ORACLE_SQL = {
    "layer_menu": f"""WITH shared(ord, layer, d) AS (VALUES {_SHARED}), own AS (SELECT DISTINCT n_regionkey AS t, CASE WHEN n_nationkey % 5 = 0 THEN 99 ELSE n_nationkey + 100 END AS ord, CASE WHEN n_nationkey % 5 = 0 THEN 'hazard_flood' ELSE lower(n_name) END AS layer,
        CASE WHEN n_nationkey % 5 = 0 THEN 'own flood' ELSE 'own ' || n_nationkey END AS d FROM nation),
        listed AS (SELECT t, ord, layer, d FROM own UNION ALL SELECT t, s.ord, s.layer, s.d FROM (SELECT DISTINCT t FROM own) CROSS JOIN shared s),
        kept AS (SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY t, layer ORDER BY ord DESC) = 1)
        SELECT t AS thread_id, string_agg('- ' || layer || ': ' || d, chr(10) ORDER BY ord, layer) AS menu FROM kept GROUP BY t""",
    "geometry_kinds": """WITH k AS (SELECT s_nationkey, ['Point', 'Point', 'LineString', 'Polygon', 'Vector'][CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey % 5 ELSE s_suppkey % 2 END + 1] AS kind FROM supplier)
        SELECT s_nationkey, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'Vector' END AS kind FROM k GROUP BY s_nationkey""",
    "request_arguments": """WITH a AS (SELECT c_custkey, c_custkey % 4 AS k, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN '' END AS crop, CASE c_custkey % 4 WHEN 0 THEN 'n' || c_nationkey WHEN 1 THEN '' END AS country, CASE c_custkey % 4 WHEN 0 THEN 'what now' WHEN 1 THEN 'yield' END AS focus FROM customer)
        SELECT c_custkey, crop, country, focus, CASE WHEN k < 2 THEN 'El Nino seasonal rainfall forecast outlook ' || country || ' ' || crop || ' ' || focus END AS forecast,
        CASE k WHEN 0 THEN 'impact of past El Nino events on ' || crop || ' production and food security in ' || country WHEN 1 THEN 'impact of past El Nino events on crop production and food security in' END AS retrospective FROM a""",
    "override_targets": "SELECT n_nationkey, n_nationkey % 4 < 2 AS applies, CASE WHEN n_nationkey % 5 = 0 THEN 'no early-warning layer' END AS refusal FROM nation",
}
