"""The engine's tables out of a folder of Parquet tables: cells, assets, roads, conditions, chunks, messages.

Each is a projection, so filters on cells and columns reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquill.functions import text as tx
from gridquill.functions.geo import number


@dataclass(frozen=True)
class Grid:
    """A north-up grid: x0, y0 is its upper left corner; a cell that has no row in the cell table has no class."""

    x0: float = 103.0
    y0: float = 14.0
    px: float = 0.01
    py: float = 0.01
    width: int = 50
    epsg: int = 4326


FINE, COARSE = Grid(), Grid(px=0.05, py=0.05, width=10)
#: The area of interest: concave, its corners off the grid.
AREA = [[(103.0011, 13.9987), (103.5567, 13.9987), (103.5567, 13.7013), (103.2011, 13.7513), (103.0011, 13.6011)]]
#: Values of the layers that the table of parts holds, a part for each cell.
PART_LAYERS = {
    "hazard": "p_size % 6",
    "vuln_a": "cast(floor(p_retailprice) as int) % 6",
    "vuln_b": "cast((p_partkey * 7 + p_size) % 6 as int)",
    "risk_l1": "cast((p_size + p_partkey) % 6 as int)",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str, layer: str) -> DataFrame:
    """(row, col, value) of a layer."""
    if layer == "vuln_coarse":
        return read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey div 10 as int) as row", "cast(s_suppkey % 10 as int) as col", "cast(s_nationkey % 6 as double) as value")
    return read(spark, sf_dir, "part").selectExpr("cast(p_partkey div 50 as int) as row", "cast(p_partkey % 50 as int) as col", f"cast({PART_LAYERS[layer]} as double) as value")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, fid, name, lon, lat) of points."""
    layer = "case c_mktsegment when 'BUILDING' then 'buildings' when 'HOUSEHOLD' then 'schools' else 'hospitals' end as layer"
    return read(spark, sf_dir, "customer").selectExpr(layer, "c_custkey as fid", "c_name as name", "103.0D + ((c_custkey % 60) + 0.3D) * 0.01D as lon", "14.0D - (((c_custkey div 60) % 60) + 0.3D) * 0.01D as lat")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fid, idx, lon, lat): corners of roads; idx, a struct, orders them within a road."""
    rows = read(spark, sf_dir, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    lon = number(103.0) + (F.col("l_partkey") % 50 + number(0.3)) * number(0.01)
    lat = number(14.0) - (F.expr("l_partkey div 50") + number(0.3)) * number(0.01)
    return rows.select(F.col("l_orderkey").alias("fid"), order.alias("idx"), lon.alias("lon"), lat.alias("lat"))


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, country, region, crop, conditions, drivers): monthly crop conditions; December has none."""
    orders = read(spark, sf_dir, "orders").where("month(o_orderdate) <> 12")
    placed = orders.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    placed = placed.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    blank = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(" ")).otherwise(F.col("o_orderpriority"))
    return placed.select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("crop"), blank.alias("conditions"), F.col("o_orderstatus").alias("drivers")
    )


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, doc_id, text, source, countries, temporal): documents with the id of their content; ids repeat as texts do."""
    temporal = F.when(F.col("doc_id") % 2 == 1, F.lit("forecast")).otherwise(F.lit("retrospective"))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), tx.content_id(F.col("text")).alias("doc_id"), "text", "source", F.array("lang").alias("countries"), temporal.alias("temporal")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, embedding, label)."""
    return read(spark, sf_dir, "embeddings")


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(draft_id, draft): whole documents with citations and headings put in by their id."""
    k = F.col("doc_id") % 7
    cite = (
        F.when(k == 0, F.lit(""))
        .when(k == 1, F.format_string(" [%d]", F.col("doc_id") % 12))
        .when(k == 2, F.format_string(" [%d, %d]", F.col("doc_id") % 9, F.col("doc_id") % 9 + 1))
        .when(k == 3, F.format_string(" [%d-%d]", F.col("doc_id") % 5, F.col("doc_id") % 5 + 2))
        .when(k == 4, F.format_string(" [%d–%d, 7]", F.col("doc_id") % 5, F.col("doc_id") % 5 + 1))
        .when(k == 5, F.lit(" [9-4] [1200]"))
        .otherwise(F.format_string(" about %d,%03d.5 tonnes [2]", F.col("doc_id") % 40, F.col("doc_id") % 1000))
    )
    heads = F.when(F.col("doc_id") % 3 == 0, F.lit("## What history says\n")).otherwise(F.lit("## The current signal\n"))
    more = F.when(F.col("doc_id") % 5 == 0, F.lit("\n\n## Sources\nnone\n\n## Season timing caveat\nplain words only")).otherwise(F.lit("\n\n## What's missing and how to weigh it\nnothing much [1]"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("draft_id"), F.concat(heads, F.coalesce("text", F.lit("")), cite, more).alias("draft"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(thread_id, turn, role, content)."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("thread_id"), "turn", "role", F.col("text").alias("content"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, entry, fetched_at): what a cache has fetched."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("entry"), F.col("ts").alias("fetched_at"))
