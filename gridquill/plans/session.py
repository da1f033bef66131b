"""Queries of conversations, usage and freshness, batch and streaming, each with the same computation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquill.operators import session as ss
from gridquill.sources import tables as t
from gridquill.sources.shared import work_dir
from gridquill.streaming import jobs, shelves

PRICE_IN, PRICE_OUT = 3e-6, 1.5e-5
NOW, TTL_HOURS = "2024-01-31 00:00:00", 36.0
STREAM_TTL_HOURS, LATE_MINUTES = 2.0, 10


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters stand for tokens: a user's go in, an assistant's come out."""
    n = F.length("content")
    calls = t.messages(spark, sf_dir).select("thread_id", F.when(F.col("role") == "user", n).alias("tokens_in"), F.when(F.col("role") != "user", n).alias("tokens_out"))
    return ss.usage(calls, PRICE_IN, PRICE_OUT, "thread_id")


def last_user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.last_user_message(t.messages(spark, sf_dir))


def thread_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.history(t.messages(spark, sf_dir))


def latest_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ss.latest_answer(t.messages(spark, sf_dir))
    return found.select("thread_id", "turn", F.md5(F.encode("answer", "UTF-8")).alias("answer"), F.md5(F.encode("question", "UTF-8")).alias("question"))


def persisted_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An area is sent at every third turn of a thread, counted with the thread's number."""
    sent = F.when((F.col("turn") + F.col("thread_id").cast("long")) % 3 == 0, F.concat(F.lit("area-"), "thread_id", F.lit("-"), F.col("turn").cast("string")))
    rows = t.messages(spark, sf_dir).select("thread_id", "turn", sent.alias("sent"))
    return ss.persisted(rows, "sent")


def visible_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.messages(spark, sf_dir).where("role = 'assistant'").select("thread_id", "turn", F.concat(F.lit("layer-"), F.col("turn").cast("string")).alias("layer"))
    return ss.visible_layers(rows)


def layer_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.concat(F.lit("layer-"), F.col("n_nationkey").cast("string")).alias("layer")
    nations = t.read(spark, sf_dir, "nation")
    return ss.reconcile(nations.where("n_nationkey % 3 <> 0").select(layer), nations.where("n_nationkey % 4 <> 0").select(layer))


def grounded_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a message's number of the order of its length stands in a sentence about it."""
    k = F.col("o_orderkey")
    answer = F.concat(F.lit("there are "), F.format_number(k, 0), F.lit(" of them"))
    return t.read(spark, sf_dir, "orders").select("o_orderkey", ss.grounded(answer, F.when(k % 2 == 0, k).otherwise(k + 1)).alias("grounded"))


def stale_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.freshness(t.blobs(spark, sf_dir), NOW, TTL_HOURS).select("key", "entry", "stale")


def stale_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.stale_at(ss.freshness(t.blobs(spark, sf_dir), NOW, TTL_HOURS))


def stream_dedupe_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream; the table that it leaves."""
    docs = t.read(spark, sf_dir, "documents").select("doc_id", "text")
    path, marks = work_dir(spark, "ingest"), work_dir(spark, "marks")
    jobs.dedupe_ingest(jobs.stream_of(spark, f"{sf_dir}/documents.parquet", t.read(spark, sf_dir, "documents").schema).select(*docs.columns), path, marks).awaitTermination()
    return shelves.library(spark, path).select("content_id", "row_id")


def stream_stale_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches as a stream; the entries that had grown too old when it ended."""
    raw = jobs.stream_of(spark, f"{sf_dir}/events.parquet", t.read(spark, sf_dir, "events").schema)
    blobs = raw.select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("entry"), F.col("ts").alias("fetched_at"))
    path, marks = work_dir(spark, "stale"), work_dir(spark, "marks")
    jobs.run_now(jobs.stale_marks(blobs, STREAM_TTL_HOURS), path, marks).awaitTermination()
    return spark.read.schema(jobs.STALE).parquet(path).select("key", "entry", F.unix_micros("fetched_at").alias("fetched_us"))


def stream_thread_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream; the state of each thread at its end."""
    raw = jobs.stream_of(spark, f"{sf_dir}/conversations.parquet", t.read(spark, sf_dir, "conversations").schema)
    messages = raw.select(F.col("conv_id").cast("string").alias("thread_id"), "turn", "role", F.col("text").alias("content"))
    path, marks = work_dir(spark, "threads"), work_dir(spark, "marks")
    jobs.run_now_by_batch(jobs.thread_states(messages), path, marks).awaitTermination()
    return jobs.latest_states(spark, path).select("thread_id", "n", "last_turn", F.md5(F.encode("last_user", "UTF-8")).alias("last_user"), "roles")


def asking(messages: DataFrame) -> DataFrame:
    """Messages of which some assistants' ask for a choice, of two options or of three, and some users' replies pick one in words or by number."""
    k = F.col("turn") + F.col("thread_id").cast("long")
    three = F.array(*map(F.lit, ("exposure", "risk-L1", "risk-L2")))
    options = F.when((F.col("role") == "assistant") & (k % 4 < 2), F.slice(three, 1, F.when(k % 4 == 0, 2).otherwise(3)))
    reply = F.when(k % 5 == 0, F.lit(" 2)")).when(k % 5 == 1, F.lit("the official one")).when(k % 5 == 2, F.lit("Recompute it")).when(k % 5 == 3, F.lit("3")).otherwise(F.col("content"))
    return messages.select("thread_id", "turn", "role", F.when(F.col("role") == "user", reply).otherwise(F.col("content")).alias("content"), options.alias("options"))


def choice_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pause for a choice, and how it ended."""
    return ss.pauses(asking(t.messages(spark, sf_dir)))


def stream_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream; the pauses that were resumed."""
    raw = jobs.stream_of(spark, f"{sf_dir}/conversations.parquet", t.read(spark, sf_dir, "conversations").schema)
    messages = raw.select(F.col("conv_id").cast("string").alias("thread_id"), "turn", "role", F.col("text").alias("content"))
    path, marks = work_dir(spark, "choices"), work_dir(spark, "marks")
    jobs.run_now_by_batch(jobs.choices(asking(messages)), path, marks).awaitTermination()
    return jobs.resumed_choices(spark, path)


def stream_windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type, worked off as a stream in complete mode.  An extension."""
    events = jobs.stream_of(spark, f"{sf_dir}/events.parquet", t.read(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    path, marks = work_dir(spark, "windows"), work_dir(spark, "marks")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    jobs.windowed_events(events).writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


QUERIES = {
    f.__name__: f
    for f in (
        usage_cost, last_user_message, thread_history, latest_answer, persisted_geometry, visible_layers, layer_reconcile, grounded_flag, stale_marking, stale_rollup, stream_dedupe_ingest, stream_stale_marks, stream_thread_state, stream_windowed_events, choice_pauses, stream_choices,
    )
}

_MESSAGES = "msgs AS (SELECT CAST(conv_id AS VARCHAR) AS thread_id, conv_id, turn, role, text AS content FROM conversations)"
_HISTORY = "count(*) AS n, string_agg(role[1], '' ORDER BY turn, role[1]) AS roles"
_LAST = "last AS (SELECT thread_id, turn, content FROM msgs WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY turn DESC, content DESC) = 1)"
_FRESH = f"fresh AS (SELECT user_id AS key, event_id AS entry, ts, epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) > {int(TTL_HOURS * 3_600_000_000)} AS stale FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"

_PAUSES = f"""{_MESSAGES}, m AS (SELECT thread_id, turn, role, turn + conv_id AS k, CASE WHEN role <> 'user' THEN NULL WHEN (turn + conv_id) % 5 = 0 THEN ' 2)' WHEN (turn + conv_id) % 5 = 1 THEN 'the official one' WHEN (turn + conv_id) % 5 = 2 THEN 'Recompute it' WHEN (turn + conv_id) % 5 = 3 THEN '3' ELSE content END AS said FROM msgs),
 a AS (SELECT *, role = 'assistant' AND k % 4 < 2 AS asks, CASE k % 4 WHEN 0 THEN 2 ELSE 3 END AS n_options FROM m), b AS (SELECT * FROM a WHERE asks OR role = 'user'),
 c AS (SELECT *, lead(turn) OVER w AS next_turn, lower(trim(lead(said) OVER w)) AS reply, lead(role = 'user') OVER w AS next_says FROM b WINDOW w AS (PARTITION BY thread_id ORDER BY turn, role)),
 d AS (SELECT *, TRY_CAST(reply[1] AS INT) AS digit, regexp_matches(reply, 'exposure|raw|hazard|flooded|expos') AS w1, regexp_matches(reply, 'l1|precomp|official') AS w2, n_options = 3 AND regexp_matches(reply, 'l2|recomp|comput|custom|weight') AS w3 FROM c WHERE asks AND coalesce(next_says, true)),
 pauses AS (SELECT thread_id, turn AS asked, next_turn AS answered, CASE WHEN next_turn IS NULL THEN NULL WHEN digit BETWEEN 1 AND n_options THEN ['exposure', 'risk-L1', 'risk-L2'][digit] WHEN w1 THEN 'exposure' WHEN w2 THEN 'risk-L1' WHEN w3 THEN 'risk-L2' ELSE 'exposure' END AS option FROM d)"""

ORACLE_SQL = {
    "choice_pauses": f"WITH {_PAUSES} SELECT * FROM pauses",
    "stream_choices": f"WITH {_PAUSES} SELECT * FROM pauses WHERE answered IS NOT NULL",
    "usage_cost": f"""WITH {_MESSAGES}, s AS (SELECT thread_id, count(*) AS n, CAST(sum(CASE WHEN role = 'user' THEN length(content) ELSE 0 END) AS BIGINT) AS tokens_in, CAST(sum(CASE WHEN role <> 'user' THEN length(content) ELSE 0 END) AS BIGINT) AS tokens_out FROM msgs GROUP BY thread_id)
        SELECT *, round(tokens_in * {PRICE_IN!r}::double + tokens_out * {PRICE_OUT!r}::double, 6) AS cost FROM s""",
    "last_user_message": f"WITH {_MESSAGES}, {_LAST} SELECT * FROM last",
    "thread_history": f"WITH {_MESSAGES} SELECT thread_id, {_HISTORY} FROM msgs GROUP BY thread_id",
    "latest_answer": f"""WITH {_MESSAGES}, a AS (SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY thread_id ORDER BY turn, role) AS q FROM msgs)
        SELECT thread_id, turn, md5(content) AS answer, md5(q) AS question FROM a WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY turn DESC, content DESC) = 1""",
    "persisted_geometry": f"""WITH {_MESSAGES}, s AS (SELECT thread_id, turn, CASE WHEN (turn + conv_id) % 3 = 0 THEN 'area-' || thread_id || '-' || turn END AS sent FROM msgs)
        SELECT thread_id, turn, sent, last_value(sent IGNORE NULLS) OVER (PARTITION BY thread_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS effective FROM s""",
    "visible_layers": f"WITH {_MESSAGES} SELECT thread_id, turn, 'layer-' || turn AS layer, turn = max(turn) OVER (PARTITION BY thread_id) AS shown FROM msgs WHERE role = 'assistant'",
    "layer_reconcile": "SELECT 'layer-' || n_nationkey AS layer, CASE WHEN n_nationkey % 3 = 0 THEN 'add' ELSE 'remove' END AS change FROM nation WHERE (n_nationkey % 3 = 0) <> (n_nationkey % 4 = 0)",
    "grounded_flag": "SELECT o_orderkey, contains(CAST(o_orderkey AS VARCHAR), CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + 1 END AS VARCHAR)) AS grounded FROM orders",
    "stale_marking": f"WITH {_FRESH} SELECT key, entry, stale FROM fresh",
    "stale_rollup": f"WITH {_FRESH} SELECT count(*) AS n, count(*) FILTER (WHERE stale) AS n_stale, strftime(min(ts) FILTER (WHERE stale), '%Y-%m-%dT%H:%M:%SZ') AS last_good_fetch FROM fresh",
    "stream_stale_marks": f"""WITH latest AS (SELECT user_id AS key, event_id AS entry, epoch_us(ts) AS fetched_us FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT CAST(key AS BIGINT) AS key, CAST(entry AS BIGINT) AS entry, fetched_us FROM latest WHERE fetched_us // 1000 + {int(STREAM_TTL_HOURS * 3_600_000)} + 1 <= (SELECT max(epoch_us(ts)) // 1000 - {LATE_MINUTES * 60_000} FROM events)""",
    "stream_dedupe_ingest": "SELECT substr(sha1(text), 1, 16) AS content_id, min(doc_id) AS row_id FROM documents GROUP BY 1",
    "stream_thread_state": f"WITH {_MESSAGES}, {_LAST} SELECT m.thread_id, {_HISTORY.replace('role[1]', 'm.role[1]').replace('ORDER BY turn', 'ORDER BY m.turn')}, max(m.turn) AS last_turn, md5(any_value(l.content)) AS last_user FROM msgs m LEFT JOIN last l ON l.thread_id = m.thread_id GROUP BY m.thread_id",
    "stream_windowed_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
