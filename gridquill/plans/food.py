"""Queries of crop conditions and the crop calendar, each with the same computation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquill.functions import text as tx
from gridquill.operators import conditions as cn
from gridquill.sources import catalog
from gridquill.sources import tables as t

MONTH, PLACE, CROPS = "1997-05", " asia ", ["BUILDING", "MACHINERY"]
ASKED_MONTHS = ("1997-5", "199705", "1996-12", "1990-01", "2030-07", "1997-13", "97-05", "  ")
ASKED_CROPS = ("building", "machine", "ER", "rice")
SPELLED = ("{y}-{m}", "{y}{m:02}", "{y}-{m:02}", "{y}/{m}")


def asked(spark: SparkSession, values: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in values], "asked string")


def conditions_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.records(t.conditions(spark, sf_dir), MONTH, CROPS, PLACE)


def conditions_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.summary(cn.records(t.conditions(spark, sf_dir)))


def distinct_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.distinct_crops(t.conditions(spark, sf_dir))


def resolve_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.resolve_crops(asked(spark, ASKED_CROPS), cn.distinct_crops(t.conditions(spark, sf_dir)).where(F.col("month") == MONTH))


def nearest_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.resolve_months(asked(spark, ASKED_MONTHS), cn.months(t.conditions(spark, sf_dir)))


def month_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of orders in several spellings, read back; the month number of each key; and names of monthly layers."""
    y, m, k = F.year("o_orderdate"), F.month("o_orderdate"), F.col("o_orderkey") % 4
    spelled = F.when(k == 0, F.format_string("%d-%d", y, m)).when(k == 1, F.format_string("%d%02d", y, m)).when(k == 2, F.format_string("%d-%02d", y, m)).otherwise(F.format_string("%d/%d", y, m))
    layer = F.when(k == 3, F.lit("Global_Outline")).otherwise(F.format_string("Global_Synthesis_%d%02d", y, m))
    rows = t.read(spark, sf_dir, "orders").select("o_orderkey", tx.month_key(spelled).alias("key"), tx.layer_month(layer).alias("layer_month"))
    return rows.withColumn("number", tx.month_number(F.col("key")))


def season_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.phases(catalog.calendar(spark), spark.range(1, 13).select(F.col("id").cast("int").alias("month"))).drop("ord")


def calendar_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month of two countries, one with seasons that a requester has changed."""
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    targets = spark.createDataFrame([("kenya", "Maize"), ("Zambia", "maize"), ("Chad", "maize")], "country string, crop string")
    overrides = spark.createDataFrame([(0, "Zambia", "Maize", "Own season", [12, 1], [5, 6])], "ord int, country string, crop string, season string, planting array<int>, harvest array<int>")
    return cn.calendar_citations(catalog.calendar(spark), targets.join(F.broadcast(months), how="cross"), overrides)


def driver_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.driver_rollup(cn.records(t.conditions(spark, sf_dir)), "month", "country")


def region_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.region_listing(cn.records(t.conditions(spark, sf_dir)), "month")


def conditions_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.conditions_citation(cn.records(t.conditions(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (conditions_records, conditions_summary, distinct_crops, resolve_crop, nearest_month, month_keys, season_phase, calendar_citation, driver_rollup, region_listing, conditions_citation)}

CONDITIONS = """cond AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, n_name AS country, r_name AS region, c_mktsegment AS crop, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS conditions, o_orderstatus AS drivers
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE month(o_orderdate) <> 12)"""
_LABEL = "CASE WHEN conditions = '' THEN 'Out of season' ELSE conditions END"
_VALUES = lambda xs: ", ".join(f"('{x}')" for x in xs)
_LIST = lambda xs: "[" + ", ".join(map(str, xs)) + "]"
_CALENDAR = "cal(ord, country, crop, season, p, h) AS (VALUES " + ", ".join(f"({i}, '{c}', '{k}', '{s}', {_LIST(p)}, {_LIST(h)})" for i, (c, k, s, p, h) in enumerate(catalog.CALENDAR)) + ")"
_IN = lambda m, a, b: f"(CASE WHEN {a} <= {b} THEN {m} BETWEEN {a} AND {b} ELSE {m} >= {a} OR {m} <= {b} END)"
_PHASE = f"CASE WHEN {_IN('month', 'p[1]', 'p[2]')} THEN 'planting' WHEN {_IN('month', 'h[1]', 'h[2]')} THEN 'harvest' WHEN {_IN('month', '(p[2] % 12 + 1)', '((h[1] + 10) % 12 + 1)')} THEN 'growing' ELSE 'off-season' END"
_NAME = lambda m, f: f"strftime(make_date(2000, {m}, 1), '{f}')"
_WINDOW = lambda w: f"{_NAME(w + '[1]', '%b')} || '–' || {_NAME(w + '[2]', '%b')}"
_KEY = r"CASE WHEN regexp_matches(asked, '^\d{4}(-\d{1,2}|\d{2})$') AND CAST(regexp_extract(asked, '^\d{4}-?(\d{1,2})$', 1) AS INT) BETWEEN 1 AND 12 THEN asked[1:4] || '-' || lpad(CAST(CAST(regexp_extract(asked, '^\d{4}-?(\d{1,2})$', 1) AS INT) AS VARCHAR), 2, '0') END"
_REGION_ORDER = "region, country, conditions, crop, drivers"


def _listing_sql(name: str, keys: str, using: str) -> str:
    return f"""{name} AS (SELECT {keys}, count(*) AS n, string_agg(region || ': ' || CASE WHEN conditions = '' THEN 'out of season' ELSE conditions END, '; ' ORDER BY pos) FILTER (WHERE pos <= 12) || CASE WHEN count(*) > 12 THEN ' (first 12 of ' || count(*) || ' rows)' ELSE '' END AS regions
 FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {_REGION_ORDER}) AS pos FROM cond) GROUP BY {keys})"""


ORACLE_SQL = {
    "conditions_records": f"WITH {CONDITIONS} SELECT * FROM cond WHERE month = '{MONTH}' AND crop IN ('BUILDING', 'MACHINERY') AND (upper(country) = 'ASIA' OR upper(region) = 'ASIA')",
    "conditions_summary": f"WITH {CONDITIONS} SELECT month, {_LABEL} AS conditions, count(*) AS n FROM cond GROUP BY ALL",
    "distinct_crops": f"WITH {CONDITIONS} SELECT DISTINCT month, crop FROM cond",
    "resolve_crop": f"""WITH {CONDITIONS}, menu AS (SELECT DISTINCT crop FROM cond WHERE month = '{MONTH}'), words(asked) AS (VALUES {_VALUES(ASKED_CROPS)}),
        same AS (SELECT asked, crop FROM words JOIN menu ON lower(crop) = lower(asked)), part AS (SELECT asked, crop FROM words JOIN menu ON contains(lower(crop), lower(asked)) WHERE asked NOT IN (SELECT asked FROM same)),
        hits AS (SELECT * FROM same UNION ALL SELECT * FROM part) SELECT asked, crop FROM words LEFT JOIN hits USING (asked)""",
    "nearest_month": f"""WITH {CONDITIONS}, ms AS (SELECT DISTINCT month, CAST(month[1:4] AS INT) * 12 + CAST(month[6:7] AS INT) AS k FROM cond), words(asked) AS (VALUES {_VALUES(ASKED_MONTHS)}), w AS (SELECT asked, {_KEY} AS key FROM words),
        x AS (SELECT *, key IN (SELECT month FROM ms) AS there, (SELECT month FROM ms ORDER BY abs(k - (CAST(w.key[1:4] AS INT) * 12 + CAST(w.key[6:7] AS INT))), month LIMIT 1) AS near FROM w)
        SELECT asked, CASE WHEN trim(asked) = '' THEN (SELECT max(month) FROM ms) WHEN there THEN key END AS month, CASE WHEN trim(asked) <> '' AND key IS NOT NULL AND NOT there THEN near END AS nearest,
        CASE WHEN trim(asked) = '' THEN 'latest' WHEN key IS NULL THEN 'invalid' WHEN there THEN 'published' ELSE 'missing' END AS status FROM x""",
    "month_keys": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m') END AS key, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m') END AS layer_month, CASE WHEN o_orderkey % 4 < 3 THEN CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) END AS number FROM orders",
    "season_phase": f"WITH {_CALENDAR} SELECT country, crop, season, CAST(month AS INT) AS month, {_PHASE} AS phase FROM cal CROSS JOIN range(1, 13) AS m(month)",
    "calendar_citation": f"""WITH {_CALENDAR}, own AS (SELECT *, false AS adjusted FROM cal WHERE country <> 'Zambia' UNION ALL SELECT 0, 'Zambia', 'Maize', 'Own season', [12, 1], [5, 6], true),
        asked(country, crop) AS (VALUES ('kenya', 'Maize'), ('Zambia', 'maize'), ('Chad', 'maize')),
        lines AS (SELECT a.country, a.crop, CAST(month AS INT) AS month, adjusted, ord, season || ': planting ' || {_WINDOW("p")} || ', harvest ' || {_WINDOW("h")} || ' — ' || {_NAME("CAST(month AS INT)", "%B")} || ' falls in the ' || {_PHASE} AS line
        FROM asked a JOIN own o ON lower(a.country) = lower(o.country) AND lower(a.crop) = lower(o.crop) CROSS JOIN range(1, 13) AS m(month))
        SELECT country, crop, month, bool_or(adjusted) AS adjusted, country || ' ' || crop || ' season windows' AS title,
        CASE WHEN bool_or(adjusted) THEN 'CROP CALENDAR for ' || country || ' ' || crop || ', ADJUSTED by the requester for this run (not the default)' ELSE 'Crop calendar for ' || country || ' ' || crop || ' (default configuration)' END || ': ' || string_agg(line, '; ' ORDER BY ord) || '.' AS text
        FROM lines GROUP BY country, crop, month""",
    "driver_rollup": f"WITH {CONDITIONS} SELECT month, country, string_agg(DISTINCT drivers, ', ' ORDER BY drivers) AS drivers FROM cond GROUP BY ALL",
    "region_listing": f"WITH {CONDITIONS}, {_listing_sql('l', 'month', 'month')} SELECT * FROM l",
    "conditions_citation": f"""WITH {CONDITIONS}, {_listing_sql("l", "month, country, crop", "")}, s AS (SELECT month, country, crop, string_agg(label || ' ' || n, ', ' ORDER BY label) AS summary FROM (SELECT month, country, crop, {_LABEL} AS label, count(*) AS n FROM cond GROUP BY ALL) GROUP BY ALL),
        d AS (SELECT month, country, crop, string_agg(DISTINCT drivers, ', ' ORDER BY drivers) AS drivers FROM cond GROUP BY ALL)
        SELECT month, country, crop, 'conditions as of ' || month || ' for ' || country || ' ' || crop || ': summary ' || summary || '; regions: ' || regions || '; drivers: ' || drivers || '.' AS text FROM l JOIN s USING (month, country, crop) JOIN d USING (month, country, crop)""",
}
