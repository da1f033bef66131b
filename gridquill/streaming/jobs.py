"""Streams: documents that are ingested once, conversations whose state goes on, windows over events.

Every job takes a streaming DataFrame and has a batch twin in operators; with availableNow it works off what
is there and stops.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from gridquill.operators.session import CHOICE_WORDS, picked
from gridquill.streaming.shelves import SHELVES, Shelves, add_batch, drop_old_filters

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_of(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, or one file: as a pattern, a path may be either."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def dedupe_ingest(docs: DataFrame, path: str, checkpoint: str, order: str = "doc_id", shelves: Shelves = SHELVES) -> StreamingQuery:
    """Adds each text of docs (doc_id, text, ...) that the library at path doesn't have to it, once (see `shelves`); read
    it with shelves.library.  A batch reads the stored ids of those buckets alone that its filters cannot rule out."""

    def add(batch: DataFrame, number: int) -> None:
        add_batch(batch, number, path, order, shelves)
        drop_old_filters(batch.sparkSession, path)

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def thread_states(messages: DataFrame) -> DataFrame:
    """A stream of (thread_id, n, last_turn, last_user, roles): the state of each thread (thread_id, turn, role, content) after every batch
    that has messages of it: how many turns, the latest, the latest user message, the roles in order.

    Kept is a turn's number and role, and one message, so turns may come in any order; no thread costs a call of Python."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    says = F.col("role") == "user"
    turns = F.collect_list(F.struct("turn", F.substring("role", 1, 1).alias("initial")))
    last = F.max_by(F.when(says, F.col("content")), F.when(says, F.struct("turn", "content")))
    held = messages.groupBy("thread_id").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"), last.alias("last_user"), turns.alias("turns"))
    return held.select("thread_id", "n", "last_turn", "last_user", F.array_join(F.transform(F.array_sort("turns"), lambda x: x["initial"]), "").alias("roles"))


def gist(reply: Column) -> Column:
    """As much of a reply as session.picked reads: a leading digit and the words it has, not its text."""
    said = F.lower(F.trim(F.coalesce(reply, F.lit(""))))
    words = sorted({w for words in CHOICE_WORDS.values() for w in words})
    return F.concat_ws(" ", F.nullif(F.regexp_extract(said, r"^([0-9])", 1), F.lit("")), *(F.when(F.contains(said, F.lit(w)), F.lit(w)) for w in words))


def choices(messages: DataFrame) -> DataFrame:
    """A stream of (thread_id, resumed), an array of (asked, answered, option): the pauses of each thread (thread_id, turn, role, content, options)
    that have been resumed, after every batch that has messages of it; twin of session.pauses.

    Kept are a thread's questions and the gist of its replies, so turns may come in any order; read it with resumed_choices."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    asks, says = F.coalesce(F.size("options") > 0, F.lit(False)), F.coalesce(F.col("role") == "user", F.lit(False))
    kept = messages.where(asks | says).select("thread_id", F.struct("turn", "role", F.when(asks, F.col("options")).alias("options"), F.when(~asks, gist(F.col("content"))).alias("reply")).alias("m"))
    held = kept.groupBy("thread_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    pairs = F.zip_with(F.slice("m", 1, F.size("m") - 1), F.slice("m", 2, F.size("m")), lambda a, b: F.struct(a["turn"].alias("asked"), b["turn"].alias("answered"), a["options"].alias("options"), b["reply"].alias("reply")))
    resumed = F.filter(pairs, lambda p: p["options"].isNotNull() & p["reply"].isNotNull())
    return held.select("thread_id", F.transform(resumed, lambda p: F.struct(p["asked"].alias("asked"), p["answered"].alias("answered"), picked(p["reply"], p["options"]).alias("option"))).alias("resumed"))


def resumed_choices(spark: SparkSession, path: str) -> DataFrame:
    """(thread_id, asked, answered, option): what the batches at path know of each thread in the end."""
    return latest_states(spark, path).select("thread_id", F.explode("resumed").alias("p")).select("thread_id", "p.asked", "p.answered", "p.option")


FETCHED = StructType([StructField("entry", LongType()), StructField("fetched", LongType())])
STALE = "key long, entry long, fetched_at timestamp, due timestamp"


class Freshness(StatefulProcessor):
    """The last entry of a key, and a timer for when it is too old.  A later fetch moves the timer; when it goes off, the key is stale."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", FETCHED)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = tuple(self.last.get()) if self.last.exists() else None
        best = known
        for part in rows:
            for entry, fetched in zip(part["entry"], part["fetched_us"]):
                if best is None or (int(fetched), int(entry)) > (best[1], best[0]):
                    best = (int(entry), int(fetched))
        if best is not None and best != known:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update(best)
            # A millisecond more than the age at which it is too old: timers know no finer time.
            self.handle.registerTimer(best[1] // 1000 + self.ttl_ms + 1)
        yield pd.DataFrame({"key": [], "entry": [], "fetched_us": [], "due_ms": []})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        entry, fetched = self.last.get()
        yield pd.DataFrame({"key": [key[0]], "entry": [entry], "fetched_us": [fetched], "due_ms": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


def stale_marks(blobs: DataFrame, ttl_hours: float, late: str = "10 minutes") -> DataFrame:
    """A stream of STALE rows: an entry of blobs (key, entry, fetched_at), the last of its key, when the stream's time, `late` behind the latest
    fetch, has passed its time to live; twin of session.freshness.  A key that is fetched anew and grows old again is marked again."""
    blobs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    timed = blobs.select("key", "entry", F.col("fetched_at").cast("timestamp").alias("fetched_at")).withColumn("fetched_us", F.unix_micros("fetched_at")).withWatermark("fetched_at", late)
    found = timed.groupBy("key").transformWithStateInPandas(statefulProcessor=Freshness(int(ttl_hours * 3_600_000)), outputStructType="key long, entry long, fetched_us long, due_ms long", outputMode="Append", timeMode="EventTime")
    return found.select("key", "entry", F.timestamp_micros("fetched_us").alias("fetched_at"), F.timestamp_millis("due_ms").alias("due"))


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by event-time windows; events later than the watermark are dropped.  An extension."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_now(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Works a stream off into Parquet files at path."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_now_by_batch(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Works a stream of updates off into a partition for each batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each thread among the batches at path."""
    rows = spark.read.parquet(path)
    fields = F.struct(*(c for c in rows.columns if c not in ("thread_id", "batch")))
    return rows.groupBy("thread_id").agg(F.max_by(fields, "batch").alias("s")).select("thread_id", "s.*")
