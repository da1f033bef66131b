"""Benchmark decontamination with DataFrame functions only: a prefix-filtered join of word windows.

A window of an item is contained in a document only if every word of it is, so its prefix under
any order of the words is one word long, and the rarest word of the corpus is the best choice.  Each
window is joined to the documents on that word alone; the word's offset and both lengths bound where
the window would have to lie, and there its words are compared in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: Windows of the benchmark, and distinct words in them, that are broadcast at most; beyond it the joins shuffle.
BROADCAST_WINDOWS = 200_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BREAKS = "".join(chr(c) for c in (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))


def words_of(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased; none for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + BREAKS, UPPER.lower() + " " * len(BREAKS))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(window, items): the distinct word windows of the items with the ids, as strings, that have them."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col).cast("string")).alias("words"))
    n = F.size("words")
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("window")).where(F.col("item").isNotNull()).groupBy("window").agg(F.collect_set("item").alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per input row: doc_id, text_key, n_words, n_hit, items (sorted as strings).

    A word is hit if it lies in an occurrence of a window.  A null or wordless text has no words; an
    item without words or id has no windows; a null doc_id is kept as such; repeated rows are judged once and
    each give a row; match_key finds a row by its text; empty tables give no rows or no hits."""
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = plain.select("doc_id", key.alias("text_key"), words_of(F.col("text")).alias("words"))
    windows = item_windows(items, item_id_col, item_text_col, window)
    small = windows.count() <= broadcast_windows
    hint = F.broadcast if small else lambda d: d

    spread = rows.select("doc_id", "text_key", "words", F.posexplode_outer("words").alias("at", "word"))
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    counts = spread.select("word").join(hint(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    # The rarest word of each window with its first offset; a word that no document has rules the window out.
    held = windows.select("window", "items", F.posexplode("window").alias("offset", "word")).join(hint(counts), "word", "left")
    first = held.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("rarest"), F.first("items").alias("items")).where(F.col("rarest.n") > 0)
    prefix = first.select(F.col("rarest.word").alias("token"), F.col("rarest.offset").alias("offset"), "window", "items")

    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
    if small:
        at = spread.select("doc_id", "text_key", "words", "at", "word", F.size("words").alias("n_words"))
        same = (F.col("word") == F.col("token")) & fits & (F.slice("words", start + 1, F.size("window")) == F.col("window"))
        pairs = at.join(F.broadcast(prefix), same, "left").where(F.col("token").isNotNull() | (F.coalesce("at", F.lit(0)) == 0))
        hits = pairs.select("doc_id", "text_key", "n_words", F.when(F.col("token").isNotNull(), F.struct(start.alias("start"), F.size("window").alias("size"))).alias("hit"), "items")
    else:
        # Places first, without the texts; they are gathered by document and compared there.
        at = spread.select("doc_id", "text_key", "at", "word", F.size("words").alias("n_words"))
        places = at.join(prefix, (F.col("word") == F.col("token")) & fits).select("doc_id", "text_key", start.alias("start"), "window", "items")
        places = places.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "window", "items")).alias("places"))
        both = rows.alias("r").join(places.alias("p"), F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("r.text_key") == F.col("p.text_key")), "left")
        kept = F.filter("places", lambda p: F.slice("words", p["start"] + 1, F.size(p["window"])) == p["window"])
        both = both.select("r.doc_id", "r.text_key", F.size("words").alias("n_words"), F.explode_outer(kept).alias("p"))
        hits = both.select("doc_id", "text_key", "n_words", F.when(F.col("p").isNotNull(), F.struct(F.col("p.start").alias("start"), F.size("p.window").alias("size"))).alias("hit"), F.col("p.items").alias("items"))
    # A row of its own for each input row counts how often it comes.
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in hits.schema}
    each = plain.select("doc_id", key.alias("text_key"), none["n_words"], none["hit"], none["items"], F.lit(1).alias("copies"))
    both = hits.select("doc_id", "text_key", "n_words", "hit", "items", F.lit(0).alias("copies")).unionByName(each)
    found = both.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.sum("copies").cast("int").alias("copies")
    )
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))
    out = found.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), F.size(covered).cast("long").alias("n_hit"), F.array_sort("items").alias("items"), "copies")
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copy", "copies")


def match_key(text: Column) -> Column:
    """The text_key of decontaminate's result for a text column."""
    text = text.cast("string")
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())
