"""Near copies are tied by leading signatures: the rows that candidates make do not grow with the buckets that signatures are dealt over."""

from __future__ import annotations

import numpy as np
import pytest

from gridquill.llm import partenum
from tests.llm.fixtures import odd_docs, prose
from tests.llm.test_pairs import JACCARD, counted, plain_jaccard


def near_copies(groups, copies):
    """Groups of texts of some 150 words that differ in a word or two, and texts that have passages of several groups."""
    rows = []
    for g in range(groups):
        words = prose(4000 + g, 150).split(" ")
        for c in range(copies):
            mine = list(words)
            mine[(17 * c) % len(mine)] = f"x{g}y{c}"
            rows.append((1000 * g + c, " ".join(mine)))
    return rows + [(10**6 + g, " ".join(prose(4000 + g + i, 150)[:120] for i in range(3))) for g in range(0, groups, 4)]


def parted(spark, rows, parts, run):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        return run(odd_docs(spark, rows).repartition(6))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n, num", [(5, 80), (3, 90)])
def test_rows_do_not_grow_with_buckets(spark, monkeypatch, n, num):
    tied, made = partenum.tied, []

    def watched(df, emit):
        found = tied(df, emit)
        made.append(found.count())
        return found

    monkeypatch.setattr(partenum, "tied", watched)
    rows = near_copies(30, 4)
    want = plain_jaccard(rows, n, num, 100)
    for parts in (3, 40):
        made.clear()
        assert counted(parted(spark, rows, parts, lambda docs: partenum.jaccard_classes(docs, n, num, 100)), *JACCARD) == want
        assert 0 < sum(made) <= (partenum.LEADS + 1) * len(rows)


@pytest.mark.parametrize("leads, ids", [(1, 500_000), (8, 0), (0, 500_000)])
def test_no_link_hangs_on_leads(spark, monkeypatch, leads, ids):
    """However many signatures lead, whether groups are broadcast or joined; ids that repeat with other texts, and null ones."""
    monkeypatch.setattr(partenum, "LEADS", leads)
    monkeypatch.setattr(partenum, "BROADCAST_IDS", ids)
    rows = near_copies(6, 3)
    rows += [(0, rows[4][1]), (0, rows[8][1]), (1, None), (3000, rows[0][1]), (77, ""), (78, "one"), (79, "One")]
    for n, num in ((5, 80), (1, 60)):
        assert counted(partenum.jaccard_classes(odd_docs(spark, rows), n, num, 100), *JACCARD) == plain_jaccard(rows, n, num, 100)


def test_leading():
    """Distinct signatures of each document, none for a document without any, and the same ones whatever their order."""
    sig, at = np.array([5, 9, 5, 7, 9], dtype=np.uint64), np.array([0, 0, 0, 2, 2])
    lists = [set(np.frombuffer(x, dtype=np.uint64).tolist()) for x in partenum.leading(sig, at, 4)]
    assert lists == [{5, 9}, set(), {7, 9}, set()]
    many = np.arange(100, dtype=np.uint64)
    first = partenum.leading(many, np.zeros(100, dtype=np.int64), 1)
    assert len(first[0]) == 8 * partenum.LEADS and first == partenum.leading(many[::-1], np.zeros(100, dtype=np.int64), 1)
