"""Secret scans, the quality classifier, packing and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from gridquill.llm import packing, quality, queries, secrets
from gridquill.llm import textscan as T
from tests.conftest import DATA
from tests.llm.fixtures import clashing, empty_docs, odd_docs, odd_texts, prose
from tests.llm.test_pairs import plain_hits, plain_jaccard

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def plain_base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(found)


def random_tokens(n=60, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(n)], ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(44)) for _ in range(n)]


def test_secrets_odd(spark):
    rows = [*odd_texts(), (50, "🙂 é token = 'abcdefgh12345678' PASSWORD:x passwd='' secret=\"aaaa.bbbb-cc=\" AKIA AKIA0123456789AB AKIA0123456789ABC"), (51, "ſecret=12345678 api-key=12345678 apikey = 12345678 toKen:=12345678")]
    found = secrets.scan_secrets(clashing(odd_docs(spark, rows)), keep=("score",))
    got = sorted((str(r["doc_id"]), r["n_chars"], [(s["start"], s["kind"], s["end"]) for s in r["base"]]) for r in found.collect())
    assert got == sorted((str(i), len(t or ""), plain_base(t)) for i, t in rows)
    assert secrets.scan_secrets(empty_docs(spark)).count() == 0


def test_random_tokens_are_found(spark):
    hexes, b64 = random_tokens()
    ordinary = ["antidisestablishmentarianismuswordsgoonandonhere", "00000000000000000000000000000000000000000000", "abababababababababababababababababababababab", "0123456789abcdef0123456789abcdef01234567"]
    rows = [(i, f"{prose(i, 5)} {h} / {b}") for i, (h, b) in enumerate(zip(hexes, b64))] + [(1000 + i, w) for i, w in enumerate(ordinary * 10)]
    found = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == 3] for r in secrets.scan_secrets(odd_docs(spark, rows)).collect()}
    assert sum(bool(found[i]) for i in range(60)) >= 50
    assert not any(found[1000 + i] for i in range(40))


def plain_p(token):
    """The combined p value of a token, by the formulas with exact normal tails; 1 for a pattern, None without an encoding."""
    body = token.rstrip("=")
    name = next((k for k in secrets.ALPHABETS if set(body) <= set(secrets.ALPHABETS[k])), None)
    if name is None:
        return None
    tail = lambda z: max(math.erfc(z / math.sqrt(2)) / 2, 1e-15)

    def uniform(text, symbols, squares):
        n, df = len(text), symbols - 1
        chi = sum(text.count(c) ** 2 for c in set(text)) * symbols / n - n
        off = n * (symbols * squares - 1)
        return tail(-(chi - df - off) / math.sqrt(2 * (df + 2 * off)))

    plain = re.sub("[^A-Za-z0-9]", "", body)
    ends = len(re.findall("[A-Z]?[a-z]+|[A-Z]+|[0-9]+", body)) - 1
    steps = len(plain) - 1
    runs = tail((ends - 0.27 * steps) / (0.6 * math.sqrt(steps * 0.27 * 0.73))) if steps >= 1 else 1.0
    if name in ("hex", "HEX"):
        ps = [uniform(body, 16, 0.1), runs]
    else:
        letters = re.sub("[^a-z]", "", body.lower())
        kinds = ["v" if c in "aeiouy" else "c" if c.isalpha() else "0" for c in plain.lower()]
        pairs = [(a, b) for a, b in itertools.pairwise(kinds) if "0" not in (a, b)]
        turns = sum(a != b for a, b in pairs)
        ps = [uniform(letters, 26, 0.066) if len(letters) >= 8 else 1.0, runs, tail((len(pairs) / 2 - turns - 0.5) / math.sqrt(len(pairs) / 4)) if len(pairs) >= 8 else 1.0]
    x = -sum(map(math.log, ps))
    p = math.exp(-x) * (1 + x + x * x / 2)
    alphabet, n = secrets.ALPHABETS[name], len(body)
    values = [alphabet.index(c) for c in body]
    bits = [v >= len(alphabet) // 2 for v in values]
    ones, found = sum(bits), 1 + sum(a != b for a, b in zip(bits, bits[1:]))
    mean = 2 * ones * (n - ones) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    mu = sum(values) / n
    spread = sum(v * v for v in values) / n - mu * mu
    odd = var <= 0 or abs(found - mean) / math.sqrt(var) > 3.5 or spread <= 0 or abs((sum(a * b for a, b in zip(values, values[1:])) / (n - 1) - mu * mu) / spread * math.sqrt(n)) > 3.5
    return 1.0 if odd and p < 0.25 else p


def some_tokens():
    hexes, b64 = random_tokens(30, 8)
    r = random.Random(9)
    words = ["".join(r.choice(["anti", "dis", "establish", "ment", "arian", "Word", "Other", "page", "and", "more"]) for _ in range(r.randint(6, 14))) for _ in range(60)]
    short = ["".join(r.choice("0123456789abcdef") for _ in range(22)) for _ in range(10)]
    b32 = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(52)) + "==" for _ in range(10)]
    return [*hexes, *b64, *short, *b32, *(w for w in words if len(w) >= 20) , "0123456789abcdef" * 20, "ab" * 40, "0" * 30, "1234567890" * 5]


def test_combined_p(spark):
    tokens = some_tokens()
    got = {r["t"]: r["x"]["bin"] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.token_tests(F.col("t")).alias("x")).collect()}
    for t in tokens:
        p = plain_p(t)
        assert p is not None and abs(got[t] - min(max((math.log10(p) - secrets.LOWEST) * secrets.BINS_PER_DECADE, 0), secrets.LAST_BIN)) <= 4, t
    none = spark.range(1).select(secrets.token_tests(F.lit("a+b-c_d/" * 4)).alias("x")).first()["x"]
    assert none["bin"] == secrets.LAST_BIN


@pytest.mark.parametrize("rate", [0.05, 0.3])
def test_false_discovery_control(spark, rate):
    """The limits of each stratum are those of the Benjamini-Hochberg procedure over its tokens' p values, each taken as the largest of its bin."""
    r = random.Random(4)
    tested = [(s, int(r.choice([r.uniform(0, 60), r.uniform(250, 321)]))) for s in (8, 9, 10) for _ in range(40)] + [(11, secrets.LAST_BIN)]
    got = {x["stratum"]: x["most"] for x in secrets.thresholds(spark.createDataFrame(tested, "stratum int, bin int"), rate).collect()}
    want = {}
    for s in {s for s, _ in tested}:
        bins = sorted(b for x, b in tested if x == s)
        p = [10 ** ((b + 1) / secrets.BINS_PER_DECADE + secrets.LOWEST) for b in bins]
        good = [b for i, (b, q) in enumerate(zip(bins, p)) if b < secrets.LAST_BIN and q * len(bins) <= rate * sum(x <= b for x in bins)]
        if good:
            want[s] = max(good)
    assert got == want


def test_redaction(spark):
    rows = [(1, "a password=hunter2hunter2 b"), (2, None), (3, "nothing"), (4, "token=12345678 token=abcdefgh"), (5, f"é {'ab' * 20} x")]
    found = secrets.scan_secrets(odd_docs(spark, rows), keep=("text",))
    out = {r["doc_id"]: r["t"] for r in found.select("doc_id", secrets.redact(F.col("keep_text"), F.col("spans")).alias("t")).collect()}
    assert out == {1: "a [SECRET] b", 2: None, 3: "nothing", 4: "[SECRET] [SECRET]", 5: "é [SECRET] x"}


def test_secrets_whole_table(spark):
    found = {r["doc_id"]: r for r in queries.QUERIES["op8_secrets"](spark, DATA).collect()}
    for doc, text in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        base = plain_base(text)
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert found[doc]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and set(said.split(",")) - {""} <= set(found[doc]["spans"].split(","))


def ranked(y, x):
    """Area under the curve."""
    pairs = [(a, b) for a in x[y == 1] for b in x[y == 0]]
    return sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op3_quality"](spark, sf).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    y, x = np.array([labels[r["doc_id"]] for r in rows]), np.array([r["score"] for r in rows])
    assert ranked(y, x) > 0.85 and np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.9
    assert np.mean([r["predicted"] for r in rows if labels[r["doc_id"]] == 1]) > 0.95


def test_quality_odd(spark):
    docs = clashing(odd_docs(spark))
    labels = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (7, 0, "x"), (14, 0, "x"), (None, 1, "x"), (3, None, "x"), (3, 1, "x")], "doc_id long, quality int, score string")
    found = quality.score_quality(docs, labels, keep=("text", "score")).collect()
    assert len(found) == len(odd_texts()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    by_text = {}
    for r in found:
        assert by_text.setdefault(r["keep_text"] or "", r["score"]) == r["score"]
    none = labels.limit(0)
    assert len({round(r["score"], 9) for r in quality.score_quality(docs, none).collect()}) == 1
    assert quality.score_quality(empty_docs(spark), labels).count() == quality.score_quality(empty_docs(spark), none).count() == 0


def plain_risk(w, inputs, marked, prior):
    """The risk, a document at a time."""
    costs = {0: [], 1: []}
    gains = []
    for x, m in zip(inputs, marked):
        f = float(x @ w)
        costs[m].append(math.log1p(math.exp(-abs(f))) + max(f, 0))  # of being negative
        if m:
            gains.append(math.log1p(math.exp(-abs(f))) + max(-f, 0))  # of being positive
    mean = lambda v: sum(v) / len(v)
    return prior * mean(gains) + max(0.0, mean(costs[0]) - prior * mean(costs[1])) + quality.RIDGE / 2 * float(w @ w)


def test_quality_is_the_minimum(spark):
    """The scores over a small table are those of a plain descent on the risk over the same rows."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    table = docs.select("doc_id", "text").orderBy("doc_id").toArrow()
    ids = table.column(0).to_pylist()
    x = np.concatenate([quality.features(s, T.Powers()) for s in T.slices(table.column(1))]).astype(float)
    learning = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in ids])
    fold = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    prior = (sum(fold.values()) + 1) / (len(fold) + 2)
    positive = x[[fold.get(i) == 1 for i in ids]]
    root = np.sqrt(np.maximum(x[learning], 0))
    scorer = quality.Scorer(root.mean(axis=0), root.std(axis=0) + 1e-3, np.zeros(quality.N_FEATURES * (1 + len(quality.KNOTS)) + 1))
    inputs, marked = scorer.inputs(np.concatenate([positive, x[learning]])), [1] * len(positive) + [0] * int(learning.sum())
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    # The weights behind the scores, from the documents' own log odds.
    odds = np.log(np.array([got[i] for i in ids]) / (1 - np.array([got[i] for i in ids])))
    w = np.linalg.lstsq(scorer.inputs(x), odds, rcond=None)[0]
    at = plain_risk(w, inputs, marked, prior)
    down, step = np.zeros(len(w)), 0.02
    p, u = inputs[np.array(marked) == 1], inputs[np.array(marked) == 0]
    for _ in range(4000):
        gp, gu = 1 / (1 + np.exp(-p @ down)), 1 / (1 + np.exp(-u @ down))
        negative = np.logaddexp(0, u @ down).mean() - prior * np.logaddexp(0, p @ down).mean()
        slope = prior * ((gp - 1) @ p) / len(p) + (negative > 0) * (gu @ u / len(u) - prior * (gp @ p) / len(p)) + quality.RIDGE * down
        down = down - step * slope
    assert at <= plain_risk(down, inputs, marked, prior) + 2e-3 + math.log(2) * quality.ROUND
    assert np.mean(np.abs(1 / (1 + np.exp(-scorer.inputs(x) @ down)) - np.array([got[i] for i in ids]))) < 0.1


def test_risk_of_two_clouds():
    """The fit parts two clouds whose prior it is told."""
    rng = np.random.default_rng(0)
    good, bad = rng.gamma(4, 1, (600, quality.N_FEATURES)), rng.gamma(4, 3, (600, quality.N_FEATURES))
    un = np.concatenate([good[300:], bad[:300]])
    x, marked = np.concatenate([good[:300], un]), np.array([1] * 300 + [0] * 600)
    scorer = quality.minimise(quality.begin(quality.moments_of(un), 0.5), 0.5, lambda s: quality.sums_of(s, x, marked))
    assert np.mean(scorer.scores(bad[300:]) < 0.5) > 0.9 and np.mean(scorer.scores(good) >= 0.5) > 0.9


def test_a_fit_that_does_not_converge_says_so(monkeypatch):
    monkeypatch.setattr(quality, "MOST_EVALUATIONS", 1)
    rng = np.random.default_rng(0)
    x, marked = rng.gamma(4, 1, (60, quality.N_FEATURES)), np.array([1] * 20 + [0] * 40)
    with pytest.warns(RuntimeWarning, match="not converged"):
        quality.minimise(quality.begin(quality.moments_of(x), 0.5), 0.5, lambda s: quality.sums_of(s, x, marked))


def test_the_risk_is_never_below_that_of_positives():
    """Where unlabelled text would cost less than its positives, negatives cost nothing and do not pull the fit back."""
    rng = np.random.default_rng(1)
    good = rng.gamma(4, 1, (200, quality.N_FEATURES))
    x, marked = np.concatenate([good, good[:150]]), np.array([1] * 200 + [0] * 150)
    start = quality.begin(quality.moments_of(good), 0.9)
    scorer = quality.minimise(start, 0.9, lambda s: quality.sums_of(s, x, marked))
    t = quality.sums_of(scorer, x, marked)
    risk, negative = quality.risk_of(t, scorer.w, 0.9)
    positive = 0.9 * (t.cost_pos - t.x_pos @ scorer.w) / t.n_pos
    assert risk >= positive and abs(risk - positive - max(0.0, negative) - quality.RIDGE / 2 * (scorer.w @ scorer.w)) <= math.log(2) * quality.ROUND + 1e-9


def least_padding(lengths, buckets):
    """By trying every choice of boundaries."""
    kinds = sorted(set(lengths))
    best = None
    for r in range(1, min(buckets, len(kinds)) + 1):
        for cuts in itertools.combinations(kinds[:-1], r - 1):
            bounds = [*cuts, kinds[-1]]
            pad = sum(min(b for b in bounds if b >= x) - x for x in lengths)
            best = pad if best is None else min(best, pad)
    return best or 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.integers(1, 5))
def test_boundaries_are_optimal(lengths, buckets):
    hist = {x: lengths.count(x) for x in lengths}
    bounds, padding = packing.best_boundaries(list(hist.items()), buckets)
    assert padding == least_padding(lengths, buckets) and len(bounds) <= buckets
    assert sum(min(b for b in bounds if b >= x) - x for x in lengths) == padding


def check_batches(rows, budget):
    batches = {}
    for r in rows:
        assert r["length"] <= r["padded"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for group in batches.values():
        assert sorted(r["slot"] for r in group) == list(range(len(group)))
        assert len(group) <= group[0]["batch_size"] and (len(group) == 1 or group[0]["padded"] * len(group) <= budget)
    open_ = {}
    for (bucket, _), group in batches.items():
        open_[bucket] = open_.get(bucket, 0) + (len(group) < group[0]["batch_size"])
    assert all(n <= 1 for n in open_.values())


@pytest.mark.parametrize("buckets, budget, group", [(16, 65_536, 8192), (3, 50, 2), (1, 1, 1)])
def test_packing_odd(spark, monkeypatch, buckets, budget, group):
    monkeypatch.setattr(packing, "GROUP", group)
    rows = packing.pack_batches(clashing(odd_docs(spark)), buckets, budget).collect()
    want = sorted((str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in odd_texts())
    assert sorted((str(r["doc_id"]), r["length"]) for r in rows) == want
    check_batches(rows, budget)
    kinds = {n for _, n in want}
    assert {r["padded"] for r in rows} <= kinds and packing.pack_batches(empty_docs(spark)).count() == 0
    if len(kinds) < 12 or buckets < 4:
        assert sum(r["padded"] - r["length"] for r in rows) == least_padding([n for _, n in want], buckets)


def test_pipeline(spark):
    """Each stage against a plain version of it on what the stage before has kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        kept[name] = out.collect()
        docs = spark.createDataFrame(kept[name], out.schema) if name != "packing" else None
    names = [n for n, _ in corpus_pipeline.STAGES]
    rows = {n: [(r["doc_id"], r["text"]) for r in kept[n]] for n in names[:-1]}
    before = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    scored = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op3_quality"](spark, DATA).collect()}
    assert sorted(rows[names[0]]) == sorted(r for r in before if scored[r[0]])
    classes = plain_jaccard(rows[names[0]], 5, 80, 100)
    assert {i for i, _ in rows[names[1]]} == {d for d, _, c in classes if d == c}
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {d for d, _, n, _ in plain_hits(rows[names[1]], items) if n}
    assert {i for i, _ in rows[names[2]]} == {i for i, _ in rows[names[1]]} - hit
    assert {i for i, _ in rows[names[3]]} == {i for i, _ in rows[names[2]]}
    assert all(not plain_base(t) for _, t in rows[names[3]]) and all(r["n_chars"] == len(r["text"] or "") for r in kept[names[3]])
    assert sorted(r["doc_id"] for r in kept["packing"]) == sorted(i for i, _ in rows[names[3]])
    check_batches(kept["packing"], packing.BUDGET)
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, kept["packing"]))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_odd(spark, stage):
    for docs in (odd_docs(spark), odd_docs(spark).withColumn("score", F.lit("clash")), empty_docs(spark)):
        out = stage(spark, docs, DATA)
        n, whole = out.count(), docs.count()
        assert n <= whole and (whole or n == 0)
        if stage is not corpus_pipeline.pack:
            assert out.columns == list(corpus_pipeline.COLUMNS)
