"""What the Jaccard join moves and writes stays near its input: signatures in passes, texts instead of hashes, no huge clusters by chance."""

from __future__ import annotations

import random

import numpy as np
import pytest

from gridquill.llm import partenum
from tests.llm.fixtures import odd_docs, prose
from tests.llm.test_pairs import JACCARD, counted, plain_jaccard


def watched_cuts(monkeypatch):
    """Tables that partenum has written, by purpose."""
    real, written = partenum.cut, []

    def cut(df, purpose, *args, **options):
        out = real(df, purpose, *args, **options)
        written.append((purpose, out))
        return out

    monkeypatch.setattr(partenum, "cut", cut)
    return written


def by_chance(texts, seed):
    """Texts of which each two share some words, none most; two pairs of near copies among them."""
    r = random.Random(seed)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([f"o{i}x{j}" for j in range(30)] + r.sample(common, 12))) for i in range(texts)]
    return rows + [(1000, rows[3][1] + " more"), (1001, rows[5][1] + " other")]


def test_narrow_signatures():
    """The bytes of a pair, and that what travels with its bucket tells signatures apart."""
    pairs = np.random.default_rng(3).integers(-(2**63), 2**63, (500, 2))
    raw = partenum.narrow(pairs)
    assert len(raw) == 500 * (partenum.SIG_BYTES + 8)
    back = partenum.wide(raw)
    assert (back[:, 1] == pairs[:, 1]).all() and (back[:, 0] == pairs[:, 0] & (2 ** (8 * partenum.SIG_BYTES) - 1)).all()


def test_passes_share_signatures(spark):
    """Each pass sends its part of the signatures, and together they are all."""
    docs = partenum.texts(odd_docs(spark, [(i, prose(50 + i, 120)) for i in range(20)]))
    groups = spark.createDataFrame([], "doc_id long, set long, group long")
    sent, tied = [], partenum.tied

    def watched(df, emit):
        packed = partenum.map_arrow(df, lambda batches: emit(batches, 8), "bucket int, pairs binary, edges boolean")
        sent.append(sum(len(r["pairs"]) for r in packed.where("not edges").collect()))
        return tied(df, emit)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(partenum, "tied", watched)
        for turn, passes in ((0, 1), (0, 3), (1, 3), (2, 3)):
            partenum.candidate_edges(docs, groups, 5, 80, 100, turn, passes)
    assert sum(sent[1:]) == sent[0] and max(sent[1:]) < 0.5 * sent[0]


@pytest.mark.parametrize("ids", [500_000, 0])
def test_no_hashes_written(spark, monkeypatch, ids):
    """Sets, at eight bytes a shingle, outweigh their texts; whether members are broadcast or joined, they are not written, repeated rows included."""
    monkeypatch.setattr(partenum, "BROADCAST_IDS", ids)
    monkeypatch.setattr(partenum, "LARGE", 2)
    written = watched_cuts(monkeypatch)
    rows = by_chance(12, 5) + [(3, f"{by_chance(12, 5)[3][1]}"), (7, None), (3, "another text"), (8, "  ")]
    assert counted(partenum.jaccard_classes(odd_docs(spark, rows), 1, 80, 100), *JACCARD) == plain_jaccard(rows, 1, 80, 100)
    assert written and not any("shingles" in df.columns for _, df in written)


def test_chance_makes_no_huge_cluster(spark, monkeypatch):
    """Where the counters say nothing, words that many prefixes have are put last, and what they tied is parted: few sets meet in blocks."""
    monkeypatch.setattr(partenum, "shingle_counts", lambda found, unpack: np.zeros(partenum.COUNTERS, dtype=np.uint32))
    for name, value in (("LARGE", 4), ("BLOCK", 4), ("ANEW", 4), ("PAIRED", 3), ("MOVED", 1)):
        monkeypatch.setattr(partenum, name, value)
    rows = by_chance(60, 7)
    docs = partenum.texts(odd_docs(spark, rows))
    known = partenum.nodes(docs, 1, 80, 100).select("node", "doc_id")
    members = partenum.cut(known.selectExpr("node", "doc_id", "0L as cluster"), "members")
    written = watched_cuts(monkeypatch)
    placed = partenum.split_large(docs, members, 1, 80, 100)
    huge = [df.count() for purpose, df in written if purpose == "huge-clusters"]
    assert huge[0] > 50 and huge[-1] == 0
    ids = {r["node"]: r["doc_id"] for r in members.collect()}
    assert {frozenset((ids[a], ids[b])) for a, b in partenum.links(docs, placed, 1, 80, 100).collect()} == {frozenset((3, 1000)), frozenset((5, 1001))}


def test_rounds_of_blocks(spark, monkeypatch):
    """Blocks that meet in rounds give the links that they give at once, and each round moves a set about once."""
    monkeypatch.setattr(partenum, "BLOCK", 3)
    rows = [(i, " ".join(f"s{j}" for j in range(40) if j % 13 != i % 13) + f" u{i}") for i in range(24)]
    docs = partenum.texts(odd_docs(spark, rows))
    members = partenum.cut(partenum.nodes(docs, 1, 95, 100).selectExpr("node", "doc_id", "0L as cluster", "node as comp"), "members")
    found = {}
    for moved in (10**6, 1):
        monkeypatch.setattr(partenum, "MOVED", moved)
        written = watched_cuts(monkeypatch)
        edges = partenum.links(docs, members, 1, 90, 100)
        found[moved] = {r["node"]: r["label"] for r in partenum.components(edges).collect()}
        monkeypatch.undo()
        monkeypatch.setattr(partenum, "BLOCK", 3)
        rounds = [df.selectExpr("sum(size(others))").first()[0] for purpose, df in written if purpose == "round"]
        assert not rounds if moved > 1 else len(rounds) > 2 and max(rounds) <= 2 * len(rows)
    assert found[1] == found[10**6]
