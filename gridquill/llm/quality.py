"""A quality classifier learned from trusted positives and unlabelled text: non-negative PU risk.

The positive class' share of the corpus, its prior p, is estimated from the labelled rows of the learning fold as their share
of ones: right where labels are a random sample of the corpus, else it can be given.  With it the risk of a scorer f under a loss l is
p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)]): what negatives cost is what unlabelled text costs less the positives in
it, and never less than nothing.  The fit sees all rows in each step, so it takes no turn back where a batch's estimate falls below
nothing, as descents over batches do; there the maximum and its slope are 0.  With the logistic loss the parts are convex in
the weights of f, a sum of hinges over counts that a scan of the bytes gives: shares of kinds of bytes, lengths,
repetition of words and lines.  So some Newton steps minimise it, the maximum rounded by ROUND at its corner, each a sum over
all positives and all unlabelled documents that tasks add up.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .common import cut, map_arrow

#: Weight of the squared weights in the risk, evaluations of the risk at most, and the gain under which the fit ends.
RIDGE, MOST_EVALUATIONS, LEAST_GAIN = 1e-3, 30, 1e-4
#: How far the corner at nothing is rounded: the risk is too high by no more than ln 2 times this.
ROUND = 0.01
#: Where hinges begin, in standard deviations, and how far a feature counts.
KNOTS, FAR = (-1.5, -0.75, 0.0, 0.75, 1.5), 5.0
#: Partial sums of tasks are added up in so many groups before they reach the driver.
SUM_GROUPS = 8

#: Kinds of bytes whose shares are features; later ones win.
KINDS = np.zeros(256, dtype=np.uint8)
for _kind, _bytes in enumerate(
    (b"", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!", b"?", b"#$%&*", b"|", b"\"'()[]{}<>", b":;", b"-_=+/\\@~^`", bytes(range(128, 256)))
):
    KINDS[list(_bytes)] = _kind
N_KINDS = 16
N_FEATURES = N_KINDS + 13
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[10] = True


def distinct_per_doc(doc: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, occurrences of the most frequent one) for each doc."""
    if not len(h):
        zero = np.zeros(docs)
        return zero, zero
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    times = np.diff(np.concatenate([at, [len(h)]]))
    most = np.zeros(docs)
    np.maximum.at(most, doc[at], times)
    return np.bincount(doc[at], minlength=docs).astype(float), most


def features(s: T.Slice, pow_: T.Powers) -> np.ndarray:
    """A row of N_FEATURES numbers for each text, from the text alone; an empty text is a row near zero."""
    docs = len(s.starts)
    size = (s.ends - s.starts).astype(float)
    owner = np.repeat(np.arange(docs), s.ends - s.starts)
    kinds = np.bincount(owner * N_KINDS + KINDS[s.data], minlength=docs * N_KINDS).reshape(docs, N_KINDS) / np.maximum(size, 1)[:, None]
    w = T.words(s, T.WHITE, T.LOWER, pow_)
    n = w.counts.astype(float)
    some = np.maximum(n, 1)
    distinct, most = distinct_per_doc(w.doc, w.hash, docs)
    same = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    stutter = np.bincount(w.doc[1:][same], minlength=docs)
    length = w.end - w.start
    spread = np.bincount(w.doc, length**2, docs) / some - (np.bincount(w.doc, length, docs) / some) ** 2
    capital = np.bincount(w.doc, KINDS[s.data[w.start]] == 2, docs) if len(w.start) else np.zeros(docs)
    lines = T.words(s, NEWLINE, T.LOWER, pow_)
    m = np.maximum(lines.counts.astype(float), 1)
    line_kinds, _ = distinct_per_doc(lines.doc, lines.hash, docs)
    pairs = T.mix(w.hash[:-1] * np.uint64(3) + w.hash[1:])
    inside = w.doc[1:] == w.doc[:-1]
    pair_kinds, pair_most = distinct_per_doc(w.doc[1:][inside], pairs[inside], docs)
    couples = np.maximum(n - 1, 1)
    more = [np.log1p(size), np.log1p(n), distinct / some, np.log1p(distinct), most / some, stutter / some, np.bincount(w.doc, length, docs) / some, np.sqrt(np.maximum(spread, 0)), capital / some, np.log1p(size / m), line_kinds / m, pair_kinds / couples, pair_most / couples]
    return np.concatenate([kinds, np.stack(more, axis=1)], axis=1).astype(np.float32)


class Scorer(NamedTuple):
    """Hinges over standardised, square-rooted features, weighted; w has the constant at its end."""

    middle: np.ndarray
    scale: np.ndarray
    w: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((np.sqrt(np.maximum(x, 0)) - self.middle) / self.scale, -FAR, FAR)
        return np.concatenate([z, *(np.maximum(z - k, 0) for k in KNOTS), np.ones((len(z), 1))], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        # A sum along each row, not a product of matrices, whose last digit depends on a row's place.
        return 1 / (1 + np.exp(-np.clip((self.inputs(x) * self.w).sum(axis=1), -30, 30)))


class Sums(NamedTuple):
    """What a fit adds up over documents: how many positive and unlabelled ones, what they cost as negatives, the positives' inputs, and of both costs the slope and the upper half of the curvature."""

    n_pos: float
    n_un: float
    cost_pos: float
    cost_un: float
    x_pos: np.ndarray
    slope_pos: np.ndarray
    slope_un: np.ndarray
    curve_pos: np.ndarray
    curve_un: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([np.atleast_1d(np.asarray(v, dtype=np.float64)) for v in self])

    @staticmethod
    def size(d: int) -> int:
        return 4 + 3 * d + d * (d + 1)

    @classmethod
    def of(cls, flat: np.ndarray, d: int) -> Sums:
        return cls(*flat[:4], *np.split(flat[4 : 4 + 3 * d], 3), *np.split(flat[4 + 3 * d :], 2))


def sums_of(scorer: Scorer, x: np.ndarray, marked: np.ndarray) -> Sums:
    inputs = scorer.inputs(x)
    f = inputs @ scorer.w
    g = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    cost, p, u = np.logaddexp(0, f), marked == 1, marked == 0
    half = np.triu_indices(inputs.shape[1])
    curve = lambda take: ((inputs[take] * (g * (1 - g))[take, None]).T @ inputs[take])[half]
    return Sums(p.sum(), u.sum(), cost[p].sum(), cost[u].sum(), inputs[p].sum(axis=0), g[p] @ inputs[p], g[u] @ inputs[u], curve(p), curve(u))


def risk_of(t: Sums, w: np.ndarray, prior: float) -> tuple[float, float]:
    """(the risk, its corner rounded and with its ridge, what negatives cost)."""
    negative = t.cost_un / t.n_un - prior * t.cost_pos / t.n_pos
    positive = (t.cost_pos - t.x_pos @ w) / t.n_pos  # the loss of being positive is that of being negative less f
    return float(prior * positive + ROUND * np.logaddexp(0, negative / ROUND) + RIDGE / 2 * (w @ w)), float(negative)


def symmetric(half: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = half
    return out + np.triu(out, 1).T


def minimise(start: Scorer, prior: float, evaluate: Callable[[Scorer], Sums]) -> Scorer:
    """Newton steps on the risk, each accepted if it lowers the risk, else shortened.  Warns if the last one still gains LEAST_GAIN."""
    best, t = start, evaluate(start)
    risk, negative = risk_of(t, best.w, prior)
    d, share = len(start.w), 1.0
    for _ in range(MOST_EVALUATIONS):
        # The slope of the rounded maximum: 1 where negatives cost something, 0 where they would cost less than nothing.
        way = 1 / (1 + np.exp(-np.clip(negative / ROUND, -50, 50)))
        cost = t.slope_un / t.n_un - prior * t.slope_pos / t.n_pos
        slope = prior * (t.slope_pos - t.x_pos) / t.n_pos + way * cost + RIDGE * best.w
        curve = prior * (1 - way) * symmetric(t.curve_pos, d) / t.n_pos + way * symmetric(t.curve_un, d) / t.n_un
        curve += way * (1 - way) / ROUND * np.outer(cost, cost) + RIDGE * np.eye(d)
        step = np.linalg.solve(curve, slope)
        tried = best._replace(w=best.w - share * step)
        found = evaluate(tried)
        new, at = risk_of(found, tried.w, prior)
        if new < risk:
            gain, best, t, risk, negative = risk - new, tried, found, new, at
            if gain < LEAST_GAIN:
                return best
            share = min(1.0, share * 2)
        elif share * float(slope @ step) < LEAST_GAIN:
            return best
        else:
            share /= 4
    warnings.warn(f"the fit has not converged after {MOST_EVALUATIONS} evaluations; the risk is {risk:.4f}", RuntimeWarning, stacklevel=2)
    return best


def prior_only(prior: float) -> Scorer:
    """What scores everything alike."""
    d = N_FEATURES
    w = np.zeros(d * (1 + len(KNOTS)) + 1)
    w[-1] = np.log(prior / (1 - prior))
    return Scorer(np.zeros(d), np.ones(d), w)


def moments_of(x: np.ndarray) -> np.ndarray:
    root = np.sqrt(np.maximum(x, 0))
    return np.concatenate([[len(x)], root.sum(axis=0), (root**2).sum(axis=0)])


def begin(moments: np.ndarray, prior: float) -> Scorer:
    """The scorer that a fit begins with, standardised by the unlabelled documents."""
    n, total, squares = moments[0], moments[1 : 1 + N_FEATURES], moments[1 + N_FEATURES :]
    middle = total / n
    scale = np.sqrt(np.maximum(squares / n - middle**2, 0)) + 1e-3
    return prior_only(prior)._replace(middle=middle, scale=scale)


def held_out(doc_id) -> F.Column:
    """Whether a document is out of the learning fold: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, marked, x) from (doc_id, text, marked): x has the features packed as 32-bit floats."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pow_ = T.Powers()
        for batch in batches:
            for s in T.slices(batch.column(1)):
                k = len(s.starts)
                x = features(s, pow_)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, k), batch.column(2).slice(s.first, k), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "marked", "x"])

    return map_arrow(docs, task, "doc_id long, marked int, x binary")


def added(rows: DataFrame, sums: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of sums(features, marked) over (doc_id, marked, x) rows: a row of numbers from each task, added up in SUM_GROUPS groups."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float32).reshape(-1, N_FEATURES).astype(np.float64)
                total += sums(x, batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUM_GROUPS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(1):
                total = np.frombuffer(raw.as_buffer()) + (0 if total is None else total)
        if total is None:
            return
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    parts = map_arrow(rows.select("marked", "x"), part, "part int, sums binary").repartition(SUM_GROUPS, "part")
    out = np.zeros(size)
    for r in map_arrow(parts, add, "part int, sums binary").select("sums").collect():  # SUM_GROUPS rows at most
        out += np.frombuffer(r["sums"])
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, prior: float | None = None) -> Scorer:
    """Fits a scorer on all positives and all documents, labelled or not, of the learning fold.  prior: the share of positives in the
    corpus; without it that among the labelled rows."""
    fold = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    if prior is None:
        n, ones = fold.agg(F.count("*"), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0))).first()
        prior = (ones + 1) / (n + 2)
    prior = min(max(prior, 0.01), 0.99)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(0).alias("marked")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    unlabelled = cut(feature_rows(rows), "features")
    trusted = fold.where("label = 1").select("doc_id").distinct()
    positive = cut(unlabelled.join(trusted, "doc_id", "left_semi").withColumn("marked", F.lit(1)).select("doc_id", "marked", "x"), "positives")
    if positive.isEmpty():
        return prior_only(prior)
    start = begin(added(unlabelled, lambda x, marked: moments_of(x), 1 + 2 * N_FEATURES), prior)
    both, d = positive.unionByName(unlabelled), len(start.w)
    return minimise(start, prior, lambda scorer: Sums.of(added(both, lambda x, marked: sums_of(scorer, x, marked).flat(), Sums.size(d)), d))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: tuple[str, ...] = (), prior: float | None = None) -> DataFrame:
    """Per input row: doc_id, held_out, score in 0..1 and predicted (1 from 0.5 on); keep: further columns to carry along; prior: the share
    of positives in the corpus, by default that among the labelled rows, which has to be a random sample then.

    Only the text goes into a score.  A null text is empty and is scored like one; a null id is never learned
    from and not held out; rows that repeat are scored alike; without labels every score is the prior; an empty
    table gives no rows."""
    scorer = learn(docs, labels, id_col, text_col, label_col, prior)
    others = [c for c in keep if c != text_col]  # the text itself goes to the workers once
    carried = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"keep_{c}") for c in others))
    dropped = {"text"} if text_col not in keep else set()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema if f.name not in dropped)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pow_ = T.Powers()
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.concatenate([scorer.scores(features(s, pow_)) for s in T.slices(batch.column(1))])
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in dropped]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(found)], names=[*(n for n, _ in rest), "score"])

    scored = map_arrow(carried, task, schema + ", score double")
    kept = (F.col("text" if c == text_col else f"keep_{c}").alias(f"keep_{c}") for c in keep)
    return scored.select("doc_id", *kept, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
