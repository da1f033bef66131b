"""Filter interaction audit and spelling variants: against brute force on odd tables, and their SQL twins."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest

from gridquill.llm import interplay, queries, variants
from tests.conftest import DATA, assert_same
from tests.llm.fixtures import ODD, clashing, empty_docs, odd_docs, odd_texts, prose

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fails(rows):
    """For each (doc_id, text) the letters of the filters that it fails."""
    out = []
    for doc, text in rows:
        text = text or ""
        w = BLANK.findall(text)
        copies = [d for d, t in rows if (t or "") == text and d is not None]
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc is not None and any(d < doc for d in copies),
        }
        out.append({f for f, bad in fails.items() if bad})
    return out


def plain_audit(rows, parts, labels):
    fails, out = plain_fails(rows), Counter()
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    for part in {p or "" for p in parts}:
        docs = [(d, f) for (d, _), f, p in zip(rows, fails, parts) if (p or "") == part]
        done, total = {}, Counter()
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone, kept = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                total[f] += len(gone)
                done[order, step] = (len(kept), len(gone), sum(f in x[1] for x in docs) - len(gone), sum(x[1] == {f} for x in docs), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))
                left = kept
        for (order, step), counts in done.items():
            out[(part, order, step, *counts, total[order[step - 1]])] += 1
    return out


def test_plain_changes_visit_every_order_once_by_neighbours():
    for n in range(6):
        order, seen = list(range(n)), set()
        seen.add(tuple(order))
        for swap in interplay.plain_changes(n):
            order[swap], order[swap + 1] = order[swap + 1], order[swap]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(n))))


def audit_rows():
    texts = [*odd_texts(), (21, prose(5, 60) + " # mark"), (22, prose(6, 70).upper()), (23, prose(6, 70).upper()), (23, prose(6, 70).upper()), (24, "a " * 80 + "| A"), (25, None)]
    parts = [("web", "book", None, "")[i % 4] for i in range(len(texts))]
    return texts, parts


def test_audit_agrees_with_every_order_applied_in_turn(spark):
    rows, parts = audit_rows()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 25)]
    labels = [(i, q, int(t)) for i, q, t in labels] + [(3, 0, 1), (3, None, None), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(i, t, "en", p, 0) for (i, t), p in zip(rows, parts)], ODD)
    marks = spark.createDataFrame(labels, LABELS)
    expected = plain_audit(rows, parts, labels)
    found = interplay.filter_audit(clashing(docs.drop("x")).withColumn("part", docs["source"]), marks.withColumn("extra", marks["toxic"]))
    assert Counter(map(tuple, found.collect())) == expected
    assert sum(expected.values()) == 600 * 3


def test_audit_of_no_documents_and_without_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert interplay.filter_audit(empty_docs(spark), none).count() == 0
    rows, parts = audit_rows()
    docs = spark.createDataFrame([(i, t, "en", p, 0) for (i, t), p in zip(rows, parts)], ODD)
    assert Counter(map(tuple, interplay.filter_audit(docs, none).collect())) == plain_audit(rows, parts, [])


def plain_variants(rows, length=7, least=2, times=10):
    n = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w in n:
        others = [o for o in n if o != w and near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
        out[w] = len(others)
    rows = Counter()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows[(w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None)] += 1
    return rows


def variant_rows(seed):
    """Texts over few letters, with words of many near ones, chains of forms, ties and misspelt copies."""
    r = random.Random(seed)
    base = ["abababab", "éàüÉÀÜßx", "aaaaaaa", "aaaaaaaa", "zzzyyyxxx"]
    words = list(base)
    for w in base:
        for _ in range(25):
            at, kind = r.randrange(len(w)), r.randrange(3)
            words.append(w[:at] + r.choice("abzé÷") + w[at + (kind < 2) :] if kind else w[:at] + w[at + 1 :])
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(40)))) for i in range(60)]
    rows += [(100 + i, "chainone " * 3) for i in range(400)] + [(600, "chainon, " * 70), (601, "CHAINO! chaino\nchaino" + " chaino2"), (602, "chainin " * 6), (602, "chainin")]
    return rows + [(None, "chainone abababab " * 40), (603, None), (604, ""), (605, "Ωabababab abababab_éàüéàüßx")]


@pytest.mark.parametrize("seed", range(3))
def test_variants_agree_with_all_pairs(spark, seed):
    rows = variant_rows(seed)
    found = variants.spelling_variants(clashing(odd_docs(spark, rows)))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = plain_variants(rows)
    assert Counter(map(tuple, found.collect())) == expected
    assert any(form for _, form, *_ in expected)


def test_variants_follow_chains_and_longer_words_only_by_parameter(spark):
    rows = [(0, "stemword " * 2), (0, "stemwort " * 40), (0, "stemworts " * 800)]
    plain = plain_variants(rows, 8, 2, 10)
    assert Counter(map(tuple, variants.spelling_variants(odd_docs(spark, rows), length=8).collect())) == plain
    assert {w: root for w, _, root, *_ in plain}["stemword"] == "stemworts"


def test_variants_of_odd_and_empty_tables(spark):
    assert variants.spelling_variants(empty_docs(spark)).count() == 0
    assert variants.spelling_variants(odd_docs(spark, [(1, None), (None, "")])).count() == 0
    rows = odd_texts()
    rows = [(i, t if t is None or len(t) < 5000 else t[:2000]) for i, t in rows]
    assert Counter(map(tuple, variants.spelling_variants(odd_docs(spark, rows)).collect())) == plain_variants(rows)


def test_no_word_is_too_long(spark):
    rows = [(0, "x" * 1000 + " " + "x" * 1000), (1, "x" * 999 + "y"), (1, "x" * 999 + "y")]
    assert Counter(map(tuple, variants.spelling_variants(odd_docs(spark, rows)).collect())) == plain_variants(rows)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_variants"])
def test_queries_agree_with_their_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name])


