"""Filter interaction audit: what each of five filters removes in every order, along a walk of adjacent transpositions.

A scan of the texts gives each document a mask of the filters that it fails; all that follows knows documents
only as counts of masks, 32 cells to a part of the corpus.  The orders of the filters are visited so that one differs from the
last by a swap of neighbours.  What a step removes depends on the set of filters before it, so a swap changes two steps
and leaves the others as they were; those two are summed anew from the cells.  A filter's Shapley value, as a sum
over all orders, accumulates on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

FILTERS = "ABCDE"
#: Words as the filters count them.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed values of the filters: words at least, percent of distinct words at least, percent of capitals at most, marks that must be absent.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, r"[#$%&*|]"
#: The filter that looks at other documents: a copy of one with a smaller id.
COPY = FILTERS.index("E")
#: Parts that are walked at a time: 600 rows each.
PARTS_AT_A_TIME = 256

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def own_mask(text: Column, words: Column) -> Column:
    """Bits of the filters A to D that a text fails, whose words are given."""
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = (
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        100 * capitals > MOST_CAPITALS * F.length(text),
        text.rlike(MARKS),
    )
    mask = F.lit(0)
    for bit, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << bit).otherwise(0)
    return mask


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per input row: doc_id, part (null: empty), mask, good and toxic (0 or 1; any row of labels says so).

    A copy is found by the SHA-256 of its text and told from the first by both digest and id, so the
    rows of a large group of copies meet in no one task.  A row without an id is no copy of a smaller one."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = plain.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = cut(split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_mask(F.col("text"), F.col("words")).cast("int").alias("mask")), "masks")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(1))
    says = lambda c: F.max((F.col(c) == 1).cast("int"))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    found = rows.join(firsts, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    return found.select(
        "doc_id", "part", (F.col("mask") + F.when(copy, 1 << COPY).otherwise(0)).cast("int").alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )


def plain_changes(n: int) -> Iterator[int]:
    """Where to swap neighbours, one swap after the other, to visit all orders of n things: the last thing runs
    through the others' places, down and up in turn, and at each end the others make a step of their own."""
    if n < 2:
        return
    others, down = plain_changes(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(others, None)
        if step is None:
            return
        yield step + down  # the others stand one place further while the last thing is in front
        down = not down


def walk(cells: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(orders, counts): cells is (parts, masks, 3), the documents of a mask, the good and the toxic among them; counts is (parts, orders, steps, COUNTS)."""
    n, all_masks = len(FILTERS), np.arange(1 << len(FILTERS))
    sums = lambda which, of: cells[:, which, of].sum(axis=1)
    order, swaps = list(range(n)), list(plain_changes(n))
    orders, out = [], np.zeros((len(cells), len(swaps) + 1, n, len(COUNTS)), dtype=np.int64)
    now = np.zeros((len(cells), n, len(COUNTS)), dtype=np.int64)
    shapley = np.zeros((len(cells), n), dtype=np.int64)

    def count(step: int) -> None:
        f, before = order[step], sum(1 << g for g in order[:step])
        fails, free = (all_masks >> f & 1) == 1, (all_masks & before) == 0
        here = fails & free
        values = (sums(~fails & free, 0), sums(here, 0), sums(fails & ~free, 0), cells[:, 1 << f, 0], sums(here, 1), sums(here, 2))
        now[:, step, :-1] = np.stack(values, axis=1)

    for step in range(n):
        count(step)
    for visit, swap in enumerate([None, *swaps]):
        if swap is not None:
            order[swap], order[swap + 1] = order[swap + 1], order[swap]
            count(swap)
            count(swap + 1)
        orders.append("".join(FILTERS[f] for f in order))
        out[:, visit] = now
        shapley[:, order] += now[:, :, COUNTS.index("removed")]
    for visit, name in enumerate(orders):
        out[:, visit, :, -1] = shapley[:, [FILTERS.index(f) for f in name]]
    return orders, out


def audit(found: DataFrame) -> DataFrame:
    """SCHEMA for all orders and steps of every part, from (part, mask, good, toxic) rows; a part has 32 cells at most."""
    cells = found.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_A_TIME):
                some = batch.slice(at, PARTS_AT_A_TIME)
                table = np.zeros((some.num_rows, 1 << len(FILTERS), 3), dtype=np.int64)
                for i, part in enumerate(some.column(1).to_pylist()):
                    for c in part:
                        table[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                orders, counts = walk(table)
                steps = len(FILTERS)
                each = len(orders) * steps
                names = pa.array(np.repeat(orders, steps)).take(pa.array(np.tile(np.arange(each), some.num_rows)))
                step = pa.array(np.tile(np.arange(1, steps + 1), some.num_rows * len(orders)), pa.int32())
                part = some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), each)))
                flat = counts.reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([part, names, step, *(pa.array(flat[:, i]) for i in range(len(COUNTS)))], names=["part", "filter_order", "step", *COUNTS])

    return map_arrow(parts, task, SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """SCHEMA: per part, order and step what the step keeps and removes, what fails it but was gone, what fails it alone, the good
    and toxic documents that it loses, and its filter's removals over all orders.

    A null text is empty, a null part is the empty string, repeated rows count each and share the standing of their id,
    a document without labels is neither good nor toxic, extra columns are ignored, an empty table gives no rows."""
    return audit(masks(docs, labels, id_col, text_col, part_col))
