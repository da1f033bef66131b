"""What a conversation holds: messages, the area that persists, layers shown, usage, freshness of what was fetched."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_user_message(messages: DataFrame) -> DataFrame:
    """(thread_id, turn, content): the latest user message of each thread."""
    mine = messages.where("role = 'user'")
    return mine.groupBy("thread_id").agg(F.max_by(F.struct("turn", "content"), F.struct("turn", "content")).alias("m")).select("thread_id", "m.turn", "m.content")


def history(messages: DataFrame) -> DataFrame:
    """(thread_id, n, roles): turns of each thread in order, one letter a role.  Roles alone are gathered, never texts."""
    letters = F.array_sort(F.collect_list(F.struct("turn", F.substring("role", 1, 1).alias("r"))))
    return messages.groupBy("thread_id").agg(F.count("*").alias("n"), F.array_join(F.transform(letters, lambda x: x["r"]), "").alias("roles"))


def latest_answer(messages: DataFrame) -> DataFrame:
    """(thread_id, turn, answer, question): the last assistant message of each thread and the user message before it."""
    order = Window.partitionBy("thread_id").orderBy("turn", "role")
    asked = F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(order)
    rows = messages.withColumn("question", asked).where("role = 'assistant'")
    return rows.groupBy("thread_id").agg(F.max_by(F.struct("turn", F.col("content").alias("answer"), "question"), F.struct("turn", "content")).alias("m")).select("thread_id", "m.*")


def persisted(rows: DataFrame, value: str, name: str = "effective") -> DataFrame:
    """rows (thread_id, turn, ...) with the last value that was sent in the thread up to each turn."""
    order = Window.partitionBy("thread_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.col(value), ignorenulls=True).over(order))


def visible_layers(layers: DataFrame) -> DataFrame:
    """layers (thread_id, turn, layer) with shown: only the latest answer's layers are."""
    latest = layers.groupBy("thread_id").agg(F.max("turn").alias("__latest"))
    return layers.join(latest, "thread_id").withColumn("shown", F.col("turn") == F.col("__latest")).drop("__latest")


def reconcile(managed: DataFrame, desired: DataFrame) -> DataFrame:
    """(layer, change): add what is desired and not managed, remove what is managed and not desired."""
    add = desired.select("layer").distinct().join(managed.select("layer"), "layer", "left_anti").withColumn("change", F.lit("add"))
    drop = managed.select("layer").distinct().join(desired.select("layer"), "layer", "left_anti").withColumn("change", F.lit("remove"))
    return add.unionByName(drop)


def usage(calls: DataFrame, price_in: float, price_out: float, *by: str) -> DataFrame:
    """(by, n, tokens_in, tokens_out, cost) of calls (tokens_in, tokens_out, ...); missing counts are 0, cost has 6 places."""
    t_in, t_out = (F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")) for c in ("tokens_in", "tokens_out"))
    sums = calls.groupBy(*by).agg(F.count("*").alias("n"), t_in.alias("tokens_in"), t_out.alias("tokens_out"))
    return sums.withColumn("cost", F.round(F.col("tokens_in") * F.lit(float(price_in)) + F.col("tokens_out") * F.lit(float(price_out)), 6))


def grounded(answer: Column, value: Column) -> Column:
    """Whether the number, as it is written, appears in the answer without thousands commas."""
    return F.coalesce(F.instr(F.regexp_replace(answer, ",", ""), value.cast("string")) > 0, F.lit(False))


def freshness(blobs: DataFrame, now: str, ttl_hours: float) -> DataFrame:
    """(key, entry, fetched_at, stale): the last entry of each key, stale if it is older than the time to live."""
    latest = blobs.groupBy("key").agg(F.max_by(F.struct("entry", "fetched_at"), F.struct("fetched_at", "entry")).alias("m")).select("key", "m.*")
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))
    return latest.withColumn("stale", age > F.lit(int(ttl_hours * 3_600_000_000)))


def stale_at(fresh: DataFrame) -> DataFrame:
    """One row: n, n_stale, and the earliest fetch among stale entries, in ISO form."""
    first = F.min(F.when(F.col("stale"), F.col("fetched_at")))
    return fresh.agg(F.count("*").alias("n"), F.count_if("stale").alias("n_stale"), F.date_format(first, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_good_fetch"))


#: Words by which a reply tells an option.
CHOICE_WORDS = {"exposure": ("exposure", "raw", "hazard", "flooded", "expos"), "risk-L1": ("l1", "precomp", "official"), "risk-L2": ("l2", "recomp", "comput", "custom", "weight")}


def picked(reply: Column, options: Column) -> Column:
    """The option that a reply picks: by a leading digit within the options, else the first one whose words it has, else the first."""
    said = F.lower(F.trim(F.coalesce(reply, F.lit(""))))
    digit = F.nullif(F.regexp_extract(said, r"^([0-9])", 1), F.lit("")).cast("int")
    told = F.lit(False)
    names = lambda o: [((o == name) & said.rlike("|".join(words))) for name, words in CHOICE_WORDS.items()]
    by_word = F.filter(options, lambda o: functools.reduce(lambda a, b: a | b, names(o), told))
    return F.when(digit.between(1, F.size(options)), F.get(options, digit - 1)).otherwise(F.coalesce(F.get(by_word, F.lit(0)), F.get(options, F.lit(0))))


def pauses(messages: DataFrame) -> DataFrame:
    """(thread_id, asked, answered, option): every pause of a thread (thread_id, turn, role, content, options) for a choice.

    A message with options asks and pauses the thread; the next user message resumes it with what it picks.  A
    question that another one follows first is void; one without a reply has a null answered and is awaited still."""
    order = Window.partitionBy("thread_id").orderBy("turn", "role")
    asks, says = F.coalesce(F.size("options") > 0, F.lit(False)), F.col("role") == "user"
    marked = messages.select("thread_id", "turn", "content", "options", asks.alias("asks"), (says & ~asks).alias("says"), "role").where("asks or says")
    followed = marked.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("turn", "content", "says")))
    told = followed.where(F.col("asks") & F.coalesce(F.col("next_says"), F.lit(True)))
    return told.select("thread_id", F.col("turn").alias("asked"), F.col("next_turn").alias("answered"), F.when(F.col("next_turn").isNotNull(), picked(F.col("next_content"), F.col("options"))).alias("option"))
