"""Spelling variants of the corpus' words without pairs: wildcard groups for replacements, a join of deletions for the rest.

Words that differ in one replaced code point share the place, what is before and what is after it: that is a group.  A group
keeps its size and its two most frequent words, which tell every member how many such neighbours it has
and which of them is the most frequent, the second for the first word itself.  A word that is another with one code point
inserted gives that other among its deletions, which meet the vocabulary in an equi-join.  Both are added up by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of a run.
LETTERS = r"A-Za-zÀ-ÿ"
#: Stands for the replaced code point; no word has it.
WILD = "*"
#: In a run of LETTERS every code point takes 16 bits.
POINT_BITS = 16
#: A form is so many times as frequent as its variant.
TIMES = 10
#: Among so many (id, run) one is misspelt, by the checksum.
MISSPELT = 31


def misspelt(doc_id: Column, run: Column) -> Column:
    """The run, less one code point where the checksum of `<doc_id>:<run>` says so; a null id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % MISSPELT == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 7, least: int = 2) -> DataFrame:
    """(word, n): the words of at least length code points and their occurrences, least or more, over all texts.

    Shorter runs give no such word, so only those of length or more are cut out of a text."""
    runs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))).alias("run"))
    low = runs.select("doc_id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    words = low.select(misspelt(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def places(word: Column) -> Column:
    return F.sequence(F.lit(1), F.length(word))


def replacements(words: DataFrame) -> DataFrame:
    """(word, near, form_n, form): for each group with more than one word what a word has there.

    In a group words differ in one code point only, so a word is that code point, and count and code point make one
    number, whose order is that of the words: by count, then from the smallest."""
    wild = lambda at: F.concat(F.substring(F.col("word"), F.lit(1), at - 1), F.lit(WILD), F.substring(F.col("word"), at + 1, F.length("word")))
    spread = words.select("n", F.explode(F.transform(places(F.col("word")), lambda at: F.struct(wild(at).alias("key"), F.ascii(F.substring(F.col("word"), at, F.lit(1))).alias("point")))).alias("x"))
    rows = spread.select("x.key", (F.shiftleft("n", POINT_BITS) + (2**POINT_BITS - 1) - F.col("x.point")).alias("rank"))
    group = Window.partitionBy("key").orderBy(F.col("rank").desc())
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = rows.select("key", "rank", F.count("*").over(whole).alias("size"), F.first("rank").over(whole).alias("top"), F.nth_value("rank", 2).over(whole).alias("second")).where("size > 1")
    best = F.when(F.col("rank") == F.col("top"), F.col("second")).otherwise(F.col("top"))
    spelt = lambda rank: F.replace(F.col("key"), F.lit(WILD), F.char((2**POINT_BITS - 1) - rank % 2**POINT_BITS))
    return told.select(spelt(F.col("rank")).alias("word"), (F.col("size") - 1).alias("near"), F.shiftright(best, POINT_BITS).alias("form_n"), spelt(best).alias("form"))


def indels(words: DataFrame, length: int) -> DataFrame:
    """(word, near, form_n, form): a row to each side of a word and a deletion of it that is a word."""
    less = lambda at: F.concat(F.substring(F.col("word"), F.lit(1), at - 1), F.substring(F.col("word"), at + 1, F.length("word")))
    shorter = words.where(F.length("word") > length).select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.explode(F.array_distinct(F.transform(places(F.col("word")), less))).alias("word"))
    links = shorter.join(words, "word")
    side = lambda a, n, b: F.struct(F.col(a).alias("word"), F.lit(1).cast("long").alias("near"), F.col(n).alias("form_n"), F.col(b).alias("form"))
    return links.select(F.explode(F.array(side("word", "long_n", "long"), side("long", "n", "word"))).alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last.  A form has TIMES its variant's count, so
    a chain has as many words as the largest count has digits at most; each round doubles what a row has followed."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        ahead = cut(now.join(on, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        now = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 7, least: int = 2, times: int = TIMES) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n.

    form is the most frequent near word (ties: the first in code-point order) if it has at least times the word's
    occurrences, else null.  A null text has no words, a null id is written as nothing where words are misspelt, repeated
    rows count each, extra columns are ignored, an empty table gives no rows.  A group has no more words than
    there are letters, a word no more neighbours than places times letters: nothing here grows with a hot word or copy."""
    words = cut(vocabulary(docs, id_col, text_col, length, least), "vocabulary")
    none = words.select("word", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form"), "n")
    near = replacements(words).unionByName(indels(words, length)).withColumn("n", F.lit(None).cast("long"))
    # The least of (-count, word) is the most frequent and of these the first.
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("minus"), F.col("form").alias("form"))))
    summed = none.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("best"))
    enough = -F.col("best.minus") >= times * F.col("n")
    found = cut(summed.select("word", F.when(enough, F.col("best.form")).alias("form"), "n", "n_near", F.when(enough, -F.col("best.minus")).alias("form_n")), "forms")
    ends = roots(found.where(F.col("form").isNotNull())).select("word", "root")
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
