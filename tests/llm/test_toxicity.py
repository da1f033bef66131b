"""Toxic spans and scores: the field against enumeration, planted words on held-out documents, odd tables."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridquill.llm import queries, toxicity
from gridquill.llm import textscan as T
from tests.conftest import DATA
from tests.llm.fixtures import clashing, empty_docs, odd_docs, odd_texts

LABELS = "doc_id long, toxic int"
WORDS, STEMS = ("blork", "snarg", "ärgwort", "fleem"), ("quizz", "ôvér")


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2


def planted(seed, docs):
    """(rows, labels, spans): every sixth text has toxic words or words with a toxic beginning, whose places are spans."""
    r = random.Random(seed)
    lexicon = ["".join(r.choice("abdeghiklmnoprstuö") for _ in range(r.randint(2, 8))) for _ in range(900)]
    rows, labels, spans = [], [], {}
    for i in range(docs):
        bad = i % 6 == 0
        words = [r.choice(lexicon) + r.choice(["", "", "", ".", ",", "%%%"]) for _ in range(r.randint(20, 160))]
        places = sorted(r.sample(range(len(words)), 4)) if bad else []
        for at in places:
            words[at] = r.choice(WORDS) if i % 12 else r.choice(STEMS) + r.choice(lexicon)
        starts = list(itertools.accumulate([0] + [len(w) + 1 for w in words]))
        spans[i] = {(starts[at], starts[at] + len(words[at].rstrip(".,%"))) for at in places}
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels, spans


def test_marginals_agree_with_all_taggings():
    r = np.random.default_rng(1)
    evidence, steps = r.normal(size=17), r.normal(size=(2, 2))
    first = np.zeros(17, dtype=bool)
    first[[0, 1, 5, 12]] = True
    marginal, pairs = toxicity.forward_backward(evidence, first, steps)
    expected, counts = np.zeros(17), np.zeros((2, 2))
    for a, b in itertools.pairwise([*np.flatnonzero(first), 17]):
        total, own, moves = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=b - a):
            weight = np.exp(sum(evidence[a + i] for i, t in enumerate(tags) if t) + sum(steps[x, y] for x, y in itertools.pairwise(tags)))
            total += weight
            own += weight * np.array(tags)
            for x, y in itertools.pairwise(tags):
                moves[x, y] += weight
        expected[a:b] = own / total
        counts += moves / total
    assert np.allclose(marginal, expected) and np.allclose(pairs, counts)


def test_chains_end_with_sentences_texts_and_after_sixty_four_tokens():
    texts = ["one two. three! four\nfive six", None, "", "seven " * 150]
    (s,) = T.slices(pa.array(texts))
    t = toxicity.tokens(s, T.Powers())
    assert list(np.flatnonzero(t.first)) == [0, 2, 3, 4, 6, 70, 134]
    assert list(t.counts) == [6, 0, 0, 150]
    again = toxicity.tokens(next(T.slices(pa.array(["four\nFIVE six"]))), T.Powers())
    assert (t.evidence[4, :-1] == again.evidence[1, :-1]).all() and (t.evidence[4, -1] != again.evidence[1, -1])


def test_cues_are_the_planted_words():
    rows, labels, _ = planted(3, 600)
    (s,) = T.slices(pa.array([t for _, t in rows]))
    t = toxicity.tokens(s, T.Powers())
    cues = toxicity.choose_cues(t.doc, t.evidence[:, : toxicity.CUES], np.array([y == 1 for _, y in labels]))
    marked = np.isin(t.evidence[:, : toxicity.CUES], cues).any(axis=1)
    words = {bytes(s.data[a:b]).decode() for a, b in zip(t.start[marked], t.end[marked])}
    assert set(WORDS) <= words
    assert all(w in WORDS or w.startswith(STEMS) for w in words)


def test_held_out_documents_and_their_spans(spark):
    rows, labels, spans = planted(5, 900)
    lied = [(i, 1 - y if held(i) else y) for i, y in labels]  # no label of a held-out document may matter
    docs = clashing(odd_docs(spark, rows))
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, spark.createDataFrame(lied, LABELS)).collect()}
    assert len(found) == len(rows)
    assert {i for i, r in found.items() if r["held_out"]} == {i for i, _ in rows if held(i)}
    out = [i for i, _ in rows if held(i)]
    right = sum(found[i]["predicted"] == (i % 6 == 0) for i in out)
    assert right / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())
    told = {(i, s["start"], s["end"]) for i in out for s in found[i]["spans"]}
    true = {(i, a, b) for i in out for a, b in spans[i]}
    # Toxic words that stand side by side are one span.
    assert len(told & true) >= 0.85 * len(true) and len(told & true) >= 0.85 * len(told)


def test_odd_tables_and_labels(spark):
    rows = odd_texts()
    docs = clashing(odd_docs(spark, rows))
    none = spark.createDataFrame([], LABELS)
    plain = toxicity.score_toxicity(docs, none).collect()
    assert len(plain) == len(rows) and len({r["score"] for r in plain}) == 1
    odd = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1), (5, 0), (999, 1), (12, 1), (1, 0), (9, 0)], LABELS)
    found = toxicity.score_toxicity(docs, odd.withColumn("text", odd["toxic"])).collect()
    assert len(found) == len(rows)
    for r, (doc, text) in zip(sorted(found, key=lambda r: (r["doc_id"] is None, r["doc_id"])), sorted(rows, key=lambda x: (x[0] is None, x[0]))):
        assert r["held_out"] == held(doc)
    assert len({r["score"] for r in found if r["n_tokens"] == 0}) == 1
    assert toxicity.score_toxicity(empty_docs(spark), odd).count() == 0
    assert toxicity.score_toxicity(empty_docs(spark), none).count() == 0
    only = spark.createDataFrame([(i, 1) for i, _ in rows if i is not None], LABELS)
    assert toxicity.score_toxicity(docs, only).count() == len(rows)


def test_scores_do_not_depend_on_neighbours(spark):
    rows, labels, _ = planted(7, 240)
    field = toxicity.learn(odd_docs(spark, rows), spark.createDataFrame(labels, LABELS), "doc_id", "text", "toxic", toxicity.SAMPLE)

    def score(texts):
        (s,) = T.slices(pa.array(texts))
        t = toxicity.tokens(s, T.Powers())
        m = toxicity.forward_backward(field.weights[toxicity.slots(t.evidence)].sum(axis=1), t.first, field.steps)[0]
        return toxicity.sums_of(m, t.doc, t.counts)

    together = score([t for _, t in rows])
    alone = np.concatenate([score([t]) for _, t in rows])
    assert np.allclose(together, alone, atol=1e-9)


@pytest.mark.parametrize("bound", [toxicity.Sample(3, 5, 200_000), toxicity.Sample(1000, 2000, 100)])
def test_samples_are_bounded(spark, bound):
    rows, labels, _ = planted(9, 120)
    docs = odd_docs(spark, rows)
    assert toxicity.score_toxicity(docs, spark.createDataFrame(labels, LABELS), sample=bound).count() == len(rows)


def test_query_scores_every_document(spark):
    found = queries.QUERIES["op13_toxicity"](spark, DATA)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
