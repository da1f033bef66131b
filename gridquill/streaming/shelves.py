"""A stored library that micro-batches of documents are added to without reading it again.

Contents lie by batch and bucket, a bucket being a part of the range of content ids.  A Bloom filter for each bucket tells
which ids of a batch the library may have; only the buckets of these are read, and only their ids, to see which it has.  What a batch
leaves, its contents and the filters with its ids in, is written under the batch's number: a repeated batch overwrites
both and starts from the filters of the one before, so a restart adds nothing twice.

Batches come in any order of their rows.  One that has a stored content under a smaller row id leaves that id beside the contents,
and a content's row id is the smallest of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquill.functions import text as tx
from gridquill.sources.staging import exists


class Shelves(NamedTuple):
    """Buckets, bits of a bucket's filter and bits that an id sets.  With 10 bits to an id, which these give 100,000 ids a bucket, one new
    id in a hundred is looked up in vain; more ids make more look-ups, never a wrong answer.  A library keeps the numbers it began with."""

    buckets: int = 64
    bits: int = 1 << 20
    marks: int = 7


SHELVES = Shelves()
CONTENTS = "content_id string, row_id long, text string"


def places(h: np.ndarray, shelves: Shelves) -> np.ndarray:
    """(ids, marks): the bits of each 64-bit hash, by double hashing of its halves."""
    u = h.astype(np.int64).view(np.uint64)
    low, high = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(shelves.marks, dtype=np.uint64) * high[:, None]) % np.uint64(shelves.bits)).astype(np.int64)


def bits_of(table: pa.Table, shelves: Shelves) -> np.ndarray:
    """A bucket's filter as one bool a bit; a bucket without one has an empty one."""
    if not table.num_rows:
        return np.zeros(shelves.bits, dtype=bool)
    return np.unpackbits(np.frombuffer(table["bits"][0].as_buffer(), dtype=np.uint8)).astype(bool)


def bucket_of(content_id: Column, buckets: int) -> Column:
    """Where an id stands; the content of null texts, which have no id, is in bucket 0."""
    return F.coalesce(F.pmod(F.xxhash64("content_id"), F.lit(buckets)), F.lit(0)).cast("int")


def state_path(path: str) -> str:
    return f"{path.rstrip('/')}.filters"


def smaller_path(path: str) -> str:
    return f"{path.rstrip('/')}.smaller"


def filters_before(spark: SparkSession, path: str, number: int) -> DataFrame:
    """(bucket, bits) as the last batch before this one left them."""
    for earlier in range(number - 1, -1, -1):
        if exists(spark, f"{state_path(path)}/batch={earlier}"):
            return spark.read.schema("bucket int, bits binary").parquet(f"{state_path(path)}/batch={earlier}")
    return spark.createDataFrame([], "bucket int, bits binary")


def maybe_stored(ids: DataFrame, filters: DataFrame, shelves: Shelves) -> DataFrame:
    """(content_id, bucket): the ids (content_id, bucket, h) that a filter does not rule out."""

    def task(mine: pa.Table, known: pa.Table) -> pa.Table:
        hit = bits_of(known, shelves)[places(mine["h"].to_numpy(), shelves)].all(axis=1) if mine.num_rows else np.zeros(0, dtype=bool)
        return mine.select(["content_id", "bucket"]).filter(pa.array(hit))

    return ids.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(task, "content_id string, bucket int")


def with_marks(ids: DataFrame, filters: DataFrame, shelves: Shelves) -> DataFrame:
    """(bucket, bits): the filters with the ids marked."""

    def task(mine: pa.Table, known: pa.Table) -> pa.Table:
        bits = bits_of(known, shelves)
        bits[places(mine["h"].to_numpy(), shelves).ravel()] = True
        bucket = (mine if mine.num_rows else known)["bucket"][0].as_py()
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return ids.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(task, "bucket int, bits binary")


def stored_ids(spark: SparkSession, path: str, buckets: list[int], before: int) -> DataFrame:
    """(content_id, row_id) of the batches before this one in some buckets; other folders are not listed as input, texts not read."""
    folders = [f"{path}/batch={n}/bucket={b}" for n, b in held(spark, path) if n < before and b in set(buckets)]
    if not folders:
        return spark.createDataFrame([], "content_id string, row_id long")
    return spark.read.schema(CONTENTS).parquet(*folders).select("content_id", "row_id")


def held(spark: SparkSession, path: str) -> Iterator[tuple[int, int]]:
    """(batch, bucket) folders of committed batches."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/bucket=*")) or []:
        folder = status.getPath()
        number = folder.getParent().getName().removeprefix("batch=")
        if exists(spark, f"{path}/batch={number}"):
            yield int(number), int(folder.getName().removeprefix("bucket="))


def add_batch(batch: DataFrame, number: int, path: str, order: str = "doc_id", shelves: Shelves = SHELVES) -> None:
    """Adds each text of a batch (doc_id, text, ...) that the library at path doesn't have, once; null texts are one text."""
    spark = batch.sparkSession
    keyed = batch.withColumn("content_id", tx.content_id(F.col("text")))
    first = keyed.groupBy("content_id").agg(F.min(order).alias("row_id"), F.min_by("text", order).alias("text")).withColumn("bucket", bucket_of(F.col("content_id"), shelves.buckets)).persist()
    try:
        ids = first.select("content_id", "bucket", F.xxhash64("content_id", F.lit(1)).alias("h"))
        filters = filters_before(spark, path, number)
        asked = maybe_stored(ids, filters, shelves).persist()
        try:
            buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # the number of buckets at most
            stored = stored_ids(spark, path, buckets, number).select(F.col("content_id").alias("seen"), F.col("row_id").alias("stored_row"))
            seen = asked.join(stored, F.col("content_id").eqNullSafe(F.col("seen"))).select("seen", "stored_row").persist()
            try:
                known = F.col("content_id").eqNullSafe(F.col("seen"))
                smaller = first.join(seen, known).where("row_id < stored_row or (row_id is not null and stored_row is null)").select("content_id", "row_id")
                smaller.write.mode("overwrite").parquet(f"{smaller_path(path)}/batch={number}")
                new = first.join(seen, known, "left_anti") if buckets else first
                new.repartition("bucket").select("content_id", "row_id", "text", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")
            finally:
                seen.unpersist()
            with_marks(ids, filters, shelves).write.mode("overwrite").parquet(f"{state_path(path)}/batch={number}")
        finally:
            asked.unpersist()
    finally:
        first.unpersist()


def library(spark: SparkSession, path: str) -> DataFrame:
    """(content_id, row_id, text, batch) of everything that has been added; row_id is the smallest that a content came with."""
    numbers = sorted({n for n, _ in held(spark, path)})
    if not numbers:
        return spark.createDataFrame([], f"{CONTENTS}, batch int")
    rows = spark.read.schema(f"{CONTENTS}, batch int, bucket int").option("basePath", path).parquet(*(f"{path}/batch={n}" for n in numbers)).drop("bucket")
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(smaller_path(path))
    left = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(jvm.org.apache.hadoop.fs.Path(root, "batch=*/_SUCCESS"))
    if not left:
        return rows
    smaller = spark.read.schema("content_id string, row_id long").parquet(*(s.getPath().getParent().toString() for s in left))
    least = smaller.groupBy(F.col("content_id").alias("__id")).agg(F.min("row_id").alias("__row"))
    found = rows.join(least, F.col("content_id").eqNullSafe(F.col("__id")), "left")
    return found.select("content_id", F.least("row_id", "__row").alias("row_id"), "text", "batch")


def drop_old_filters(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes the filters of all batches but the last ones; a restart needs those of the last batch but one."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(state_path(path))
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    numbers = sorted(int(s.getPath().getName().removeprefix("batch=")) for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{state_path(path)}/batch=*")) or [])
    for n in numbers[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{state_path(path)}/batch={n}"), True)
