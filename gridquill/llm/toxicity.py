"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Only documents have labels, so tokens are labelled first: cues, which are words and beginnings of words, are chosen one after the other
so that they cover the toxic documents of a sample and few of the clean ones; in a toxic document the tokens with a cue are
toxic, all others and all of a clean document are not.  The field has two states; a token's evidence is a sum of hashed weights
of its word, beginnings, ends, length and case.  Chains are sentences, of CHAIN tokens at most.  Forward-backward
gives each token's marginal of being toxic.  A document's score is a logistic function of their sum, of the largest and of the length;
its spans are the runs of tokens that are more likely toxic than not.

The fit takes a bounded sample of labelled documents (SAMPLE), in one task; everything else covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .common import map_arrow


class Sample(NamedTuple):
    """Bounds of what is learned from: documents of either label, in the order of a hash of their ids, and the bytes of one of them."""

    toxic: int = 1000
    clean: int = 2000
    most_bytes: int = 200_000


SAMPLE = Sample()
#: Tokens of a chain at most; hashed weights; passes of the fit, tokens of a step, its rate and the weight of squares.
CHAIN, SLOTS, PASSES, STEP_TOKENS, RATE, RIDGE = 64, 1 << 18, 5, 30_000, 0.3, 2e-7
#: What a clean document with a cue costs, in toxic documents, and the least that a cue may gain.
CLEAN_COST, LEAST_GAIN = 3.0, 4.0
#: Lengths in bytes of the beginnings and ends of a word that are evidence; cues are words and beginnings.
BEGINNINGS, ENDS = (3, 4, 5, 6, 7, 8), (3, 4)
CUES = 1 + len(BEGINNINGS)
N_FEATURES = CUES + len(ENDS) + 2
#: Scores from this on are predicted toxic, tokens from this marginal on are in a span.
THRESHOLD, SPAN_FROM = 0.3, 0.5

#: Tokens are runs of ASCII letters and digits and of all that is not ASCII.
BREAKS = np.ones(256, dtype=bool)
BREAKS[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = False
BREAKS[128:] = False
ENDING = np.zeros(256, dtype=bool)
ENDING[list(b".!?\n")] = True


class Tokens(NamedTuple):
    """Tokens of a slice: first and last byte, text, hashes of evidence (a row each), whether a chain begins; tokens of each text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    evidence: np.ndarray
    first: np.ndarray
    counts: np.ndarray


def tokens(s: T.Slice, pow_: T.Powers) -> Tokens:
    w = T.words(s, BREAKS, T.LOWER, pow_)
    n, k = len(s.data), len(w.start)
    if not k:
        return Tokens(w.start, w.end, w.doc, np.zeros((0, N_FEATURES), dtype=np.uint64), np.zeros(0, dtype=bool), w.counts)
    up, down = pow_.to(n + 1)
    size = w.end - w.start
    ends = np.concatenate([[0], np.cumsum(ENDING[s.data])])
    stop = np.ones(k, dtype=bool)  # a sentence or a text ends before the token
    stop[1:] = (ends[w.start[1:]] > ends[w.end[:-1]]) | (w.doc[1:] != w.doc[:-1])
    begun = np.maximum.accumulate(np.where(stop, np.arange(k), 0))
    first = (np.arange(k) - begun) % CHAIN == 0
    out = np.empty((k, N_FEATURES), dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(T.BYTE_CODES[T.LOWER[s.data]] * up[:n], out=total[1:])
        out[:, 0] = w.hash
        for i, length in enumerate(BEGINNINGS, 1):
            to = np.minimum(w.start + length, w.end)
            out[:, i] = (total[to] - total[w.start]) * down[w.start] + np.uint64(2 * i + 1) * (size >= length)
        for i, length in enumerate(ENDS, CUES):
            at = np.maximum(w.end - length, w.start)
            out[:, i] = (total[w.end] - total[at]) * down[at] + np.uint64(2 * i + 1)
        upper = (s.data[w.start] >= 65) & (s.data[w.start] <= 90)
        out[:, -2] = np.uint64(1 << 40) + np.minimum(size, 40).astype(np.uint64)
        out[:, -1] = np.uint64(1 << 41) + (upper * 2 + stop).astype(np.uint64)
        out[:, 1:] = T.mix(out[:, 1:] * np.uint64(2 * N_FEATURES + 1) + np.arange(1, N_FEATURES, dtype=np.uint64))
    return Tokens(w.start, w.end, w.doc, out, first, w.counts)


class Field(NamedTuple):
    """weights: evidence for toxic, by slot; steps: (from, to) log weights of neighbours; score: weights of a document's sums."""

    weights: np.ndarray
    steps: np.ndarray
    score: np.ndarray

    def packed(self) -> bytes:
        return np.concatenate([self.steps.ravel(), self.score, self.weights]).astype(np.float32).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> Field:
        x = np.frombuffer(raw, dtype=np.float32).astype(np.float64)
        return cls(x[4 + N_SUMS :], x[:4].reshape(2, 2), x[4 : 4 + N_SUMS])


def slots(evidence: np.ndarray) -> np.ndarray:
    return (evidence % np.uint64(SLOTS)).astype(np.int32)


def steps_of(first: np.ndarray) -> list[np.ndarray]:
    """Tokens by their place in a chain: all first ones, those of them with a second, and so on."""
    at = np.flatnonzero(first)
    length = np.diff(np.concatenate([at, [len(first)]]))
    out = []
    for i in range(int(length.max(initial=0))):
        at, length = at[length > i], length[length > i]
        out.append(at + i)
    return out


def forward_backward(evidence: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of toxic for each token, expected counts of (from, to)): two states, all chains side by side."""
    n = len(evidence)
    own = np.stack([np.ones(n), np.exp(np.clip(evidence, -30, 30))], axis=1)
    own /= own.sum(axis=1, keepdims=True)
    move = np.exp(np.clip(steps, -30, 30))
    alpha, beta = np.empty((n, 2)), np.ones((n, 2))
    places = steps_of(first)
    for i, at in enumerate(places):
        a = own[at] * (alpha[at - 1] @ move if i else 1.0)
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    for at in places[:0:-1]:
        b = (own[at] * beta[at]) @ move.T
        beta[at - 1] = b / b.sum(axis=1, keepdims=True)
    both = alpha * beta
    later = np.flatnonzero(~first)
    pairs = alpha[later - 1][:, :, None] * move * (own[later] * beta[later])[:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    return both[:, 1] / both.sum(axis=1), pairs.sum(axis=0)


def fit_field(evidence: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, steps) by steps of the log likelihood's gradient over some chains at a time, each weight at a rate
    of its own that falls with what it has moved."""
    weights, steps = np.zeros(SLOTS), np.zeros((2, 2))
    moved, moved_steps = np.full(SLOTS, 1e-8), np.full((2, 2), 1e-8)
    starts = np.flatnonzero(first)
    order = np.random.default_rng(7).permutation(len(starts))
    length = np.diff(np.concatenate([starts, [len(first)]]))
    parts = np.split(order, np.searchsorted(np.cumsum(length[order]), np.arange(STEP_TOKENS, len(first), STEP_TOKENS)))
    for _ in range(PASSES):
        for part in parts:
            if not len(part):
                continue
            size = length[part]
            at = np.repeat(starts[part] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            f, y, head = slots(evidence[at]), toxic[at], first[at]
            p, pairs = forward_backward(weights[f].sum(axis=1), head, steps)
            later = np.flatnonzero(~head)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[later - 1].astype(int), y[later].astype(int)), 1.0)
            g = np.bincount(f.ravel(), np.repeat(y - p, N_FEATURES), SLOTS) - RIDGE * len(at) * weights
            moved += g * g
            weights += RATE * g / np.sqrt(moved)
            g = seen - pairs - 1e-3 * steps
            moved_steps += g * g
            steps += RATE * g / np.sqrt(moved_steps)
    return weights, steps


def per_text_unique(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, cue) pairs of texts in ascending order, in the order of cues."""
    order = np.argsort(h, kind="stable")
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def choose_cues(doc: np.ndarray, cues: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Cues that cover toxic texts, the next always that which gains most: toxic texts, half as much with each cue that they have
    already, less CLEAN_COST times the clean ones with it, both as shares of their label.  Ties go to the cue that fewer texts
    have, then to the least hash."""
    n_toxic, n_clean = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    mine = toxic[doc]
    of, h = per_text_unique(np.repeat(doc[mine], CUES), cues[mine].ravel())
    kinds, begin, count = np.unique(h, return_index=True, return_counts=True)
    least = min(LEAST_GAIN, max(2.0, n_toxic / 10))
    kinds, begin, count = (x[count >= least] for x in (kinds, begin, count))
    if not len(kinds):
        return kinds
    clean_doc, clean_cues = doc[~mine], cues[~mine]
    place = np.searchsorted(kinds, clean_cues.ravel())
    place[place == len(kinds)] = 0
    hit = kinds[place] == clean_cues.ravel()
    _, known = per_text_unique(np.repeat(clean_doc, CUES)[hit], place[hit].astype(np.uint64))
    clean = np.bincount(known.astype(np.int64), minlength=len(kinds)) * (n_toxic / n_clean)
    member = np.concatenate([of[b : b + c] for b, c in zip(begin, count)])
    owner = np.repeat(np.arange(len(kinds)), count)
    worth, chosen = np.ones(len(toxic)), []
    while True:
        gain = np.bincount(owner, worth[member], minlength=len(kinds)) - CLEAN_COST * clean
        gain[chosen] = 0.0
        best = np.flatnonzero(gain == gain.max())
        best = best[np.argmin(count[best] + clean[best])]
        if gain[best] < least:
            return np.sort(kinds[chosen]) if chosen else kinds[:0]
        chosen.append(best)
        worth[member[owner == best]] /= 2


N_SUMS = 5


def sums_of(marginal: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """N_SUMS numbers for each text: the logarithms of the sum of its marginals and of its tokens, the largest marginal, its log odds, and 1."""
    texts = len(counts)
    total, most = np.bincount(doc, marginal, texts), np.zeros(texts)
    np.maximum.at(most, doc, marginal)
    odds = np.clip(most, 1e-4, 1 - 1e-4)
    return np.stack([np.log(total + 0.01), np.log1p(counts), most, np.log(odds / (1 - odds)) / 4, np.ones(texts)], axis=1)


def fit_score(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps."""
    w = np.zeros(N_SUMS)
    ridge = np.diag([0.3] * (N_SUMS - 1) + [1e-3])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, slope)
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: pa.Array, toxic: np.ndarray, prior: float) -> Field:
    """A field and its score from sampled texts; prior: the share of toxic documents among the labelled ones, by which samples are weighted."""
    pow_ = T.Powers()
    parts, base = [], 0
    for s in T.slices(texts):
        t = tokens(s, pow_)
        parts.append(t._replace(doc=t.doc + base))
        base += len(s.starts)
    doc, evidence, first, counts = (np.concatenate([getattr(t, f) for t in parts]) for f in ("doc", "evidence", "first", "counts"))
    del parts
    share = np.where(toxic, prior / max(toxic.mean(), 1e-9), (1 - prior) / max(1 - toxic.mean(), 1e-9))
    if not toxic.any() or not len(doc):
        return Field(np.zeros(SLOTS), np.zeros((2, 2)), np.array([0.0] * (N_SUMS - 1) + [np.log(prior / (1 - prior))]))
    half = np.random.default_rng(11).permutation(len(toxic)) % 2
    # The score is fitted to sums of documents that the field has not seen: with each half's field those of the other.
    sums = np.zeros((len(toxic), N_SUMS))
    for mine in (0, 1):
        weights, steps = fit_part(doc, evidence, first, toxic, half[doc] == mine)
        sums[half != mine] = sums_of(forward_backward(weights[slots(evidence)].sum(axis=1), first, steps)[0], doc, counts)[half != mine]
    weights, steps = fit_part(doc, evidence, first, toxic, np.ones(len(doc), dtype=bool))
    return Field(weights, steps, fit_score(sums, toxic.astype(float), share))


def fit_part(doc: np.ndarray, evidence: np.ndarray, first: np.ndarray, toxic: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, steps) from the tokens of some whole texts.  A toxic text without any cue tells nothing about its tokens and is left out."""
    doc, evidence, first = doc[of], evidence[of], first[of]
    if not toxic[doc].any():
        return np.zeros(SLOTS), np.zeros((2, 2))
    cues = choose_cues(doc, evidence[:, :CUES], toxic)
    marked = np.isin(evidence[:, :CUES], cues).any(axis=1) & toxic[doc]
    told = ~toxic
    told[np.unique(doc[marked])] = True
    take = told[doc]
    return fit_field(evidence[take], first[take], marked[take].astype(float))


def held_out(doc_id: Column) -> Column:
    """Whether a document is out of the learning fold: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: Sample) -> Field:
    """A field from sampled labelled documents of the learning fold; of ids that both tables have, those of the smallest hashes."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(F.col(text_col).cast("string")).alias("size")).where(F.col("doc_id").isNotNull() & F.col("size").between(1, sample.most_bytes) & ~held_out(F.col("doc_id")))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = ids.select("doc_id").distinct().join(marks, "doc_id")
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = min(max((ones + 1) / (n + 2), 0.001), 0.999)
    pick = lambda label, most: known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = pick(1, sample.toxic).unionByName(pick(0, sample.clean))  # ids alone, no more than the sample's bound
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fits = F.octet_length("text").between(1, sample.most_bytes)
    chosen = texts.where(fits).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema=pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("text", pa.string())]))
        rows = rows.sort_by("doc_id")
        first = rows.append_column("at", pa.array(np.arange(rows.num_rows))).group_by(["text", "label"]).aggregate([("at", "min")])
        rows = rows.take(pa.array(np.sort(first["at_min"].to_numpy())))  # copies of a text tell nothing new
        field = fit(rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string()), rows["label"].to_numpy() == 1, prior)
        yield pa.RecordBatch.from_arrays([pa.array([field.packed()], pa.binary())], names=["field"])

    if not n:
        return Field(np.zeros(SLOTS), np.zeros((2, 2)), np.array([0.0] * (N_SUMS - 1) + [np.log(prior / (1 - prior))]))
    return Field.unpacked(map_arrow(chosen.coalesce(1), task, "field binary").first()["field"])  # one row of SLOTS numbers


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: Sample = SAMPLE) -> DataFrame:
    """Per input row: doc_id, held_out, score in 0..1, predicted (1 from THRESHOLD on), n_tokens, spans: array of struct<start,end,marginal>,
    the runs of tokens that are more likely toxic than not, in code points, end exclusive, with the largest marginal.

    Only the text goes into a score.  A null text is empty and is scored as one, a null id is never learned from and not
    held out, rows that repeat are scored alike, an id with labels of both kinds is toxic, without labels every score is the same, an
    empty table gives no rows."""
    field = learn(docs, labels, id_col, text_col, label_col, sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pow_ = T.Powers()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        for batch in batches:
            for s in T.slices(batch.column(1)):
                t, k = tokens(s, pow_), len(s.starts)
                marginal = forward_backward(field.weights[slots(t.evidence)].sum(axis=1), t.first, field.steps)[0] if len(t.doc) else np.zeros(0)
                # A sum along each row, not a product of matrices, whose last digit depends on a row's place.
                score = 1 / (1 + np.exp(-np.clip((sums_of(marginal, t.doc, t.counts) * field.score).sum(axis=1), -30, 30)))
                hit = np.flatnonzero(marginal >= SPAN_FROM)
                new = np.ones(len(hit), dtype=bool)
                new[1:] = (np.diff(hit) > 1) | (t.doc[hit[1:]] != t.doc[hit[:-1]])
                at = np.flatnonzero(new)
                head, tail = hit[at], hit[np.concatenate([at[1:], [len(hit)]]) - 1] if len(hit) else hit
                points = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
                origin = points[s.starts[t.doc[head]]] if len(head) else head
                spans = pa.StructArray.from_arrays(
                    [pa.array((points[t.start[head]] - origin).astype(np.int32)), pa.array((points[t.end[tail]] - origin).astype(np.int32)), pa.array(np.maximum.reduceat(marginal[hit], at) if len(at) else np.zeros(0))], names=["start", "end", "marginal"]
                )
                offsets = np.concatenate([[0], np.cumsum(np.bincount(t.doc[head], minlength=k))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), spans).cast(kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, k), pa.array(score), pa.array(t.counts.astype(np.int64)), lists], names=["doc_id", "score", "n_tokens", "spans"])

    scored = map_arrow(rows, task, "doc_id long, score double, n_tokens long, spans array<struct<start:int,end:int,marginal:double>>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_tokens", "spans")
