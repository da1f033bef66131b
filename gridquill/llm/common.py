"""What the operators of this package share: input columns, shared storage, cuts of the lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder URI below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent a local session, as in tests, gets a temporary folder of this machine, and the
    setting is then made; a cluster has no folder that all its machines see, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridquill-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root:
        root = "file://" + (root.removeprefix("file:") if root.startswith("file:") else root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def let_go(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs at once instead of at some later collection of garbage.
    The session holds on to the plan that it ran last, so a job of one row takes that place first."""
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, purpose: str, release: bool = True, **options: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: a lineage that ends in
    committed files, which no lost executor takes along.  release: the shuffle files of the finished job go at once."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.options(**options).parquet(path)
    schema = df.schema
    del df
    if release:
        let_go(spark)
    return spark.read.schema(schema).parquet(path)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id long, text string), whatever other columns df has."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of (id, key) that are broadcast at most: some 16 MB.
BROADCAST_KEYS = 500_000


def without(df: DataFrame, gone: DataFrame, keys: list[tuple[Column, str]]) -> DataFrame:
    """df less the rows whose keys, null-safe, are in gone, a written table; gone is broadcast if it is counted to be small."""
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    named = gone.select(*(F.col(name).alias(f"__gone_{i}") for i, (_, name) in enumerate(keys)))
    same = None
    for i, (mine, _) in enumerate(keys):
        one = mine.eqNullSafe(F.col(f"__gone_{i}"))
        same = one if same is None else same & one
    return df.join(named, same, "left_anti")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: what the cluster's owner has sized to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def put_file(folder: str, name: str, content: bytes) -> None:
    """Writes a whole file under a temporary name and then moves it, so no reader sees a part."""
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as out:
        out.write(content)
    store.move(part, f"{path}/{name}")


#: Rows and bytes of a batch that goes to a Python worker, at most: what bounds a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def map_arrow(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with batches of bounded size, which this sets for the session."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Lets a Python worker, which lives on for the next task, hand the memory that a task has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def merged(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Of batches ordered by key: a table for each stretch of whole keys, so a key never spans two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[-1]
        if held and held[-1].column(key)[-1] != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut_at = batch.num_rows
        values = keys.to_numpy(zero_copy_only=False)
        differs = (values != last.as_py()).nonzero()[0]
        cut_at = int(differs[-1]) + 1 if len(differs) else 0
        if cut_at:
            yield pa.Table.from_batches([*held, batch.slice(0, cut_at)])
            held = [batch.slice(cut_at)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
