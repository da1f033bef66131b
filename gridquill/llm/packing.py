"""Optimal length buckets: boundaries by dynamic programming over the global histogram of lengths.

All documents of a bucket are padded to its boundary, its longest length.  With C(j) documents and S(j) tokens among
the j shortest kinds of lengths, and b(j) the j-th kind, a bucket from i to j pads b(j) (C(j) - C(i)) - (S(j) - S(i)).
For a fixed number of buckets the best split before j minimises a line of slope -C(i) at b(j); slopes
fall and queries rise, so a hull of lines answers each in constant time on the average and the whole takes
kinds times buckets.  Batches of a token budget then form inside each bucket.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BUCKETS, BUDGET = 16, 65_536
#: Documents that are numbered in one group, about; a bucket has as many groups as it takes.
GROUP = 8192


def best_boundaries(histogram: list[tuple[int, int]], buckets: int) -> tuple[list[int], int]:
    """(boundaries, padding) of at most `buckets` buckets over (length, documents) pairs."""
    kinds = sorted(histogram)
    if not kinds:
        return [], 0
    count, total = [0], [0]
    for length, n in kinds:
        count.append(count[-1] + n)
        total.append(total[-1] + n * length)
    n_kinds = len(kinds)
    best: list[int | None] = [0] + [None] * n_kinds
    choices = []
    for _ in range(min(buckets, n_kinds)):
        now: list[int | None] = [None] * (n_kinds + 1)
        choice = [0] * (n_kinds + 1)
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        front = 0
        for j in range(1, n_kinds + 1):
            if best[j - 1] is not None:
                line = (-count[j - 1], best[j - 1] + total[j - 1], j - 1)
                while len(hull) - front >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            x = kinds[j - 1][0]
            while len(hull) - front >= 2 and hull[front + 1][0] * x + hull[front + 1][1] <= hull[front][0] * x + hull[front][1]:
                front += 1
            if len(hull) > front:
                slope, intercept, i = hull[front]
                now[j] = slope * x + intercept + x * count[j] - total[j]
                choice[j] = i
        choices.append(choice)
        best = now
    # Another bucket never pads more, so the last round holds the optimum.
    j, bounds = n_kinds, []
    for choice in reversed(choices):
        bounds.append(kinds[j - 1][0])
        j = choice[j]
    return bounds[::-1], int(best[n_kinds])


def word_count(text: Column) -> Column:
    """Words, as runs of no white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def pack_batches(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None) -> DataFrame:
    """Per input row: doc_id, length, bucket, padded (its bucket's boundary), batch, slot, batch_size.

    length: tokens of a document, by default its words; null counts as 0, and documents of length 0 take
    part like others.  A batch holds budget // padded documents, one at least, so only a document longer than
    the budget exceeds it, alone; each bucket has one batch that isn't full at most.  Documents are dealt to
    batches by a hash of id, length and text, then by id and text, so repeated rows lie side by side; null ids
    are ids like others; an empty table gives no rows."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(word_count(F.col(text_col).cast("string")) if length is None else length.cast("long"), F.lit(0)).alias("length"), F.xxhash64(F.col(text_col).cast("string")).alias("tie")
    )
    rows = cut(rows, "lengths")  # three numbers a document: the texts are read and their words counted once
    # A row for each different length: bounded by the longest document, whatever the number of documents.
    histogram = [(r["length"], r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()]
    bounds, _ = best_boundaries(histogram, buckets)
    sizes = [0] * len(bounds)
    for value, n in histogram:
        sizes[bisect_left(bounds, value)] += n
    spark = docs.sparkSession
    table = [(i, b, max(1, budget // max(b, 1)), -(-n // GROUP)) for i, (b, n) in enumerate(zip(bounds, sizes))]
    if not table:
        return spark.createDataFrame([], "doc_id long, length long, bucket int, padded long, batch long, slot int, batch_size long")
    bucket = F.lit(None).cast("int")
    for i, b in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col("length") <= b, F.lit(i)).otherwise(bucket)
    pick = lambda k: F.element_at(F.array(*(F.lit(t[k]).cast("long") for t in table)), F.col("bucket") + 1)
    rows = rows.withColumn("bucket", bucket).withColumn("group", F.pmod(F.xxhash64("doc_id", "length", "tie"), pick(3)))
    # Numbered within groups; what stands in front of a group is a running sum over counts.
    order = Window.partitionBy("bucket", "group").orderBy("doc_id", "tie")
    numbered = rows.withColumn("at", F.row_number().over(order) - 1)
    before = Window.partitionBy("bucket").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("bucket", "group").agg(F.count("*").alias("n")).select(F.col("bucket").alias("b"), F.col("group").alias("g"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = numbered.join(groups, (F.col("bucket") == F.col("b")) & (F.col("group") == F.col("g"))).withColumn("place", F.col("base") + F.col("at"))
    per = pick(2)
    return placed.select(
        "doc_id", "length", "bucket", pick(1).alias("padded"), F.floor(F.col("place") / per).cast("long").alias("batch"), (F.col("place") % per).cast("int").alias("slot"), per.alias("batch_size")
    )
