"""Connected components by alternating stars: every round joins the edges with two aggregates over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, cut, map_arrow

MAX_ROUNDS = 60
#: Edges that a task holds at once.
HELD = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least) for each node of the edges but the least of its component, which is what it is tied to."""
    name, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at.reshape(2, -1)
    label = np.arange(len(name))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(name)))
    return name[moved], name[label[moved]]


def combined(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(a, b) of parts, each two rows of nodes: HELD edges at a time become the stars of the components that they make."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*np.concatenate(held, axis=1))], names=["a", "b"])

    for part in parts:
        held.append(part)
        size += part.shape[1]
        if size >= HELD:
            yield made()
            held, size = [], 0
    if size:
        yield made()


def forests(edges: DataFrame) -> DataFrame:
    """(a, b): the edges that a task reads, HELD at a time, become the stars of the components that they make: as a
    combiner before a shuffle, it leaves an edge for each node of a task at most, and short ways between them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from combined(np.stack([batch.column(i).to_numpy() for i in (0, 1)]) for batch in batches)

    return map_arrow(edges.select("a", "b"), task, "a long, b long")


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, least, most): the least and the largest neighbour of each node."""
    both = edges.select(F.col("a").alias("node"), "b").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("b")))
    return both.groupBy(F.bitwise_not("node").alias("turned")).agg(F.min("b").alias("least"), F.max("b").alias("most")).select(F.bitwise_not("turned").alias("node"), "least", "most")


def large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    least = neighbours(edges).select("node", "least")
    low = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("node"))
    return low.join(F.broadcast(least) if few else least, "node").select("a", F.least("node", "least").alias("b"))


def small_star(edges: DataFrame, few: bool) -> DataFrame:
    """A node a and its smaller neighbours b are tied to the least of them; repeated and looped edges are left to forests."""
    least = edges.groupBy(F.bitwise_not("a").alias("turned")).agg(F.min("b").alias("m")).select(F.bitwise_not("turned").alias("a"), "m")
    tied = edges.join(F.broadcast(least) if few else least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return tied.where(F.col("a") != F.col("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the least node it is connected to.

    Each round is written to the shared folder, so a lost executor costs a round at most.  It ends when every node has
    larger neighbours only or one neighbour, and raises if that is not so after MAX_ROUNDS.  A hub's least neighbour is a
    partial aggregate, and is broadcast to its edges while nodes are BROADCAST_KEYS at most.  Beyond, they meet in a join that Spark splits where it is
    skewed: the aggregates are by turned bits, as Spark does it only where both sides have an exchange of their own."""
    now = cut(edges.where(F.col("a") != F.col("b")).select("a", "b"), "edges")
    for _ in range(MAX_ROUNDS):
        size, moving = neighbours(now).agg(F.count("*"), F.count_if((F.col("least") < F.col("node")) & (F.col("least") != F.col("most")))).first()
        if not moving:
            return neighbours(now).select("node", F.least("node", "least").alias("label"))
        few = size <= BROADCAST_KEYS
        now = cut(forests(small_star(large_star(now, few), few)), "edges", release=False)  # small; the next step releases it
    raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")
