"""Jaccard classes, substring and window removal, decontamination: against brute force on odd tables and random ones."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gridquill.llm import blocks, decontam, partenum, queries, repeats
from tests.conftest import DATA, assert_same
from tests.llm.fixtures import clashing, empty_docs, odd_docs, odd_texts, prose

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_jaccard(rows, n, num, den):
    sets = []
    for _, text in rows:
        w = BLANK.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[root(i)].append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return Counter((doc, len(sets[i]), least[root(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def plain_repeats(rows, length):
    places, raws = defaultdict(int), [(t or "").encode() for _, t in rows]
    for raw in raws:
        for i in range(len(raw) - length + 1):
            places[raw[i : i + length]] += 1
    out = Counter()
    for (doc, _), raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if places[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[(doc, len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    return out


def plain_windows(rows, window):
    first, words = {}, [BLANK.findall(t or "") for _, t in rows]
    for (doc, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = Counter()
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[(doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def plain_hits(rows, items, window=10):
    wins = defaultdict(set)
    for item, text in items:
        w = PLAIN.findall((text or "").translate(LOWER))
        if item is not None and w:
            for i in range(max(1, len(w) - window + 1)):
                wins[tuple(w[i : i + window])].add(str(item))
    out = []
    for doc, text in rows:
        w = PLAIN.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


def counted(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


JACCARD, REPEATS, WINDOWS = ("doc_id", "n_shingles", "component_id"), ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("n, num, den", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_jaccard_odd(spark, n, num, den):
    assert counted(partenum.jaccard_classes(clashing(odd_docs(spark)), n, num, den), *JACCARD) == plain_jaccard(odd_texts(), n, num, den)


@pytest.mark.parametrize("length", [200, 30])
def test_repeats_odd(spark, length):
    assert counted(repeats.remove_repeats(clashing(odd_docs(spark)), length), *REPEATS) == plain_repeats(odd_texts(), length)


@pytest.mark.parametrize("window", [50, 7])
def test_windows_odd(spark, window):
    assert counted(blocks.remove_seen_windows(clashing(odd_docs(spark)), window), *WINDOWS) == plain_windows(odd_texts(), window)


ITEMS = [(1, " ".join(odd_texts()[0][1].split(" ")[18:40])), (2, "changed"), (3, None), (4, "..."), (None, "one"), (10, "ONE"), (2, odd_texts()[2][1]), (7, "same same same same same same same same same same same"), (8, "Éàü éàü")]


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination_odd(spark, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontam.decontaminate(clashing(odd_docs(spark)), items, broadcast_windows=most)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found.collect()) == plain_hits(odd_texts(), ITEMS)


def test_empty_tables(spark):
    none, docs = empty_docs(spark), odd_docs(spark)
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert partenum.jaccard_classes(none).count() == repeats.remove_repeats(none).count() == blocks.remove_seen_windows(none).count() == 0
    assert decontam.decontaminate(none, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert decontam.decontaminate(docs, no_items).where("n_hit > 0").count() == 0


#: Few words, so that windows, shingles and substrings repeat in every way.
TEXTS = st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "B", "cc", "d."]), max_size=14).map(" ".join)), min_size=1, max_size=8)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=TEXTS)
def test_random_texts(spark, texts):
    rows = list(enumerate(texts))
    docs = odd_docs(spark, rows)
    assert counted(partenum.jaccard_classes(docs, 2, 60, 100), *JACCARD) == plain_jaccard(rows, 2, 60, 100)
    assert counted(repeats.remove_repeats(docs, 5), *REPEATS) == plain_repeats(rows, 5)
    assert counted(blocks.remove_seen_windows(docs, 3), *WINDOWS) == plain_windows(rows, 3)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name])


def test_size_band_edges(spark):
    """Sets of every size whose similarity is just at the threshold or just below it."""
    rows = []
    for i, size in enumerate(range(10, 60, 3)):
        base = [f"w{i}x{j}" for j in range(size)]
        rows += [(1000 + 10 * i, " ".join(base)), (1001 + 10 * i, " ".join(base + [f"z{i}"])), (1002 + 10 * i, " ".join(base + [f"y{i}x{j}" for j in range(size // 9 + 1)]))]
    assert counted(partenum.jaccard_classes(odd_docs(spark, rows), 1, 90, 100), *JACCARD) == plain_jaccard(rows, 1, 90, 100)


@pytest.mark.parametrize("paired", [1, 2, 8])
def test_jaccard_large_clusters(spark, monkeypatch, paired):
    """Clusters that are split by rare shingles and dealt into many blocks lose no link."""
    monkeypatch.setattr(partenum, "LARGE", 2)
    monkeypatch.setattr(partenum, "PAIRED", paired)
    monkeypatch.setattr(partenum, "BLOCK", 2)
    shared = " ".join(f"s{j}" for j in range(40))
    rows = [(i, f"{shared} " + " ".join(f"t{i // 3}x{j}" for j in range(12)) + (f" u{i}" if i % 3 else "")) for i in range(24)] + odd_texts()
    for n, num, den in ((1, 80, 100), (3, 90, 100), (2, 60, 100)):
        assert counted(partenum.jaccard_classes(odd_docs(spark, rows), n, num, den), *JACCARD) == plain_jaccard(rows, n, num, den)


NUL_ROWS = [(3 * i + j, t) for i in range(20) for j, t in enumerate((f"{prose(700 + i, 3)}{'q%d ' % i}{prose(900 + i, 60)[:145]}" + chr(0) * 50, f"{'q%d ' % i}{prose(900 + i, 60)[:145]}" + chr(0) * 50, f"{'q%d ' % i}{prose(900 + i, 60)[:145]}"))]
NUL_ROWS += [(100, chr(0) * 300), (101, "a" + chr(0) * 230 + "b"), (102, chr(0) * 199), (103, f"{chr(0) * 90}{prose(5, 60)}"), (104, f"x{chr(0) * 120}{prose(5, 60)}{chr(0)}"), (105, f"{prose(5, 60)}{chr(0) * 3}")]


@pytest.mark.parametrize("hot, length", [(1024, 200), (1024, 120), (1, 200)])
def test_repeats_nul_bytes(spark, monkeypatch, hot, length):
    """An end of a text is no NUL byte, whatever pads it."""
    monkeypatch.setattr(repeats, "HOT", hot)
    assert counted(repeats.remove_repeats(odd_docs(spark, NUL_ROWS), length), *REPEATS) == plain_repeats(NUL_ROWS, length)


def plain_groups(rows, length):
    """The bytes of each string of `length` bytes that repeats, with all places where it begins."""
    places = defaultdict(set)
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            places[raw[i : i + length]].add((doc, i))
    return {k: v for k, v in places.items() if len(v) > 1}


@pytest.mark.parametrize("hot", [1024, 1])
def test_maximal_repeats(spark, monkeypatch, hot):
    """Occurrences of a group are equal bytes, no group can be extended within its reach, and together they have every repeated window at every place."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rows, length = [(i, t) for i, (_, t) in enumerate(odd_texts()) if i not in (11, 12)] + [(100 + i, t) for i, t in NUL_ROWS], 90
    groups = defaultdict(set)
    for g, doc, lo, hi in repeats.maximal_repeats(odd_docs(spark, rows), length).collect():
        groups[g].add((doc, lo, hi))
    raw = {i: (t or "").encode() for i, t in rows}
    want, seen = plain_groups(rows, length), defaultdict(set)
    for spans in groups.values():
        content = {raw[d][lo:hi] for d, lo, hi in spans}
        assert len(content) == 1 and len(next(iter(content))) >= length and len(spans) > 1
        lo, hi = min(h - l for _, l, h in spans), max(h - l for _, l, h in spans)
        assert lo == hi <= 2 * length - min(repeats.ANCHOR, length)
        for d, lo, hi in spans:
            for i in range(lo, hi - length + 1):
                seen[raw[d][i : i + length]].add((d, i))
    assert seen == want


def test_jaccard_same_id_other_text(spark):
    """Rows that share an id are texts like others."""
    rows = [(1, "a b c d e f g h i j k"), (1, "z y x w v u t s r q p"), (2, "z y x w v u t s r q p"), (3, "a b c d e f g h i j k l"), (1, None)]
    assert counted(partenum.jaccard_classes(odd_docs(spark, rows), 1, 80, 100), *JACCARD) == plain_jaccard(rows, 1, 80, 100)


@pytest.mark.parametrize("hot", [1024, 1])
def test_repeats_hot_anchors(spark, monkeypatch, hot):
    """A short passage that all texts share, whole copies, and passages that overlap; with and without trees."""
    monkeypatch.setattr(repeats, "HOT", hot)
    passage, other = prose(21, 40), prose(22, 70)
    rows = [(i, f"{prose(200 + i, 25)} {passage} {prose(300 + i, 25)}") for i in range(25)] + [(100 + i, f"{other} {passage[: 60 + i]}") for i in range(6)] + [(200 + i, rows_) for i, rows_ in enumerate([other] * 4 + [None, ""])]
    for parts in (1, 7):
        docs = odd_docs(spark, rows).repartition(parts)
        for length in (200, 90):
            assert counted(repeats.remove_repeats(docs, length), *REPEATS) == plain_repeats(rows, length)
        assert counted(blocks.remove_seen_windows(docs, 20), *WINDOWS) == plain_windows(rows, 20)
