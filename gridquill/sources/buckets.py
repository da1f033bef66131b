"""Rasters stored so that they meet without an exchange: cell tables bucketed and sorted by their cell.

Layers of one bucket count have a cell in buckets of one number, each a file in the order of its cells.  So a task
reads a bucket of every layer side by side and merges them; no row crosses the network, however many layers there are.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquill.functions import geo
from gridquill.operators import raster

BUCKETS = 64


def store_layer(cells: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """A layer's cells (row, col, value), those without a value left out, as a table of the catalog whose files lie at path; what it
    held is replaced.  Rows are dealt out as buckets are, so each bucket is one file.  ValueError if a cell repeats."""
    rows = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value")).where("value is not null")
    dealt = rows.repartition(buckets, "row", "col").sortWithinPartitions("row", "col")
    dealt.write.mode("overwrite").bucketBy(buckets, "row", "col").sortBy("row", "col").option("path", path).saveAsTable(table)
    stored = cells.sparkSession.table(table)
    if not stored.groupBy("row", "col").count().where("count > 1").isEmpty():  # by bucket, without an exchange
        cells.sparkSession.sql(f"DROP TABLE {table}")
        raise ValueError("a cell repeats; a layer has one value for each")


def side(spark: SparkSession, table: str, name: str) -> DataFrame:
    return spark.table(table).select("row", "col", F.col("value").alias(name)).hint("merge")


def combine_risk(spark: SparkSession, hazard: str, vulnerability: Mapping[str, str], weights: Mapping[str, float], class_max: int = 5) -> DataFrame:
    """As raster.combine_risk, over stored layers, tables by name: a merge for each layer and no exchange."""
    if not vulnerability or set(vulnerability) - set(weights):
        raise ValueError("every vulnerability layer needs a weight")
    names = list(vulnerability)
    joined = reduce(lambda a, n: a.join(side(spark, vulnerability[n], f"v_{n}"), ["row", "col"], "left"), names, side(spark, hazard, "hazard"))
    risk = raster.weighted_class(F.col("hazard"), [F.col(f"`v_{n}`") for n in names], [weights[n] for n in names], class_max)
    return joined.select("row", "col", risk.cast("double").alias("value"))


def compare(spark: SparkSession, ours: str, other: str) -> DataFrame:
    """As raster.compare, over two stored layers."""
    both = side(spark, ours, "a").join(side(spark, other, "b"), ["row", "col"], "full_outer")
    return both.select("row", "col", geo.severity(F.col("a")).alias("ours"), geo.severity(F.col("b")).alias("other")).where("ours > 0 or other > 0")
