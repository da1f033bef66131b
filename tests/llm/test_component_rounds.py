"""Components by few jobs, whether their least neighbours are broadcast or joined; shingles counted by one job."""

from __future__ import annotations

import random
import uuid

import numpy as np
import pytest

from gridquill.llm import graph, partenum


def plain_labels(edges):
    label = {v: v for e in edges if e[0] != e[1] for v in e}
    while any(label[a] != label[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    return set(label.items())


def jobs_of(spark, run):
    """What run returns, and how many jobs it started."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def tangled(seed):
    """Stars, paths, rings and a hub, with repeated edges, loops and edges of either direction."""
    r = random.Random(seed)
    edges = [(900, 1000 + i) for i in range(60)] + [(2000 + i, 2001 + i) for i in range(25)] + [(3000 + (i + 1) % 12, 3000 + i) for i in range(12)] + [(7, 7), (-(2**62), 2**62)]
    edges += [(r.randrange(150), r.randrange(150)) for _ in range(110)]
    return [e[:: r.choice((1, -1))] for e in edges + r.sample(edges, 40)]


@pytest.mark.parametrize("keys", [500_000, 0])
@pytest.mark.parametrize("held", [1 << 20, 1])
def test_tangled_edges(spark, monkeypatch, keys, held):
    monkeypatch.setattr(graph, "BROADCAST_KEYS", keys)
    monkeypatch.setattr(graph, "HELD", held)
    edges = tangled(keys + held)
    df = spark.createDataFrame(edges, "a long, b long")
    want = plain_labels(edges)
    for given in (df, graph.forests(df), graph.forests(df.repartition(7))):
        found = graph.components(given).collect()
        assert len(found) == len(want) and {tuple(r) for r in found} - {(7, 7)} == want - {(7, 7)}


def test_no_edges(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert graph.forests(none).count() == graph.components(none).count() == 0
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_stars():
    a, b = np.array([[5, 4], [4, 9], [9, 5], [20, 30], [30, 10], [1, 2], [2, 1]]).T
    assert sorted(zip(*(x.tolist() for x in graph.stars(a, b)))) == [(2, 1), (5, 4), (9, 4), (20, 10), (30, 10)]


def test_few_jobs(spark):
    """Edges that are stars already take no round of their own."""
    edges = [(100 * i, 100 * i + j) for i in range(30) for j in range(1, 9)]
    df = spark.createDataFrame(edges, "a long, b long")
    found, jobs = jobs_of(spark, lambda: graph.components(df).collect())
    assert {tuple(r) for r in found} == {(v, 100 * (v // 100)) for e in edges for v in e}
    assert jobs <= 8


def test_one_job_counts_shingles(spark):
    """However many partitions the counters come in, and counts add up beyond a partition's own."""
    tops = [0, 1, 1, 5, (1 << 14) - 1, 1 << 14, (1 << 20) - 1]
    rows = [(i, len(tops), np.array([(t << 44) + i for t in tops], dtype=np.uint64).tobytes()) for i in range(40)]
    sets = spark.createDataFrame(rows, "node long, size long, shingles binary").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        counts, jobs = jobs_of(spark, lambda: partenum.shingle_counts(sets))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == {t: 40 * tops.count(t) for t in tops}
    assert jobs <= 6
