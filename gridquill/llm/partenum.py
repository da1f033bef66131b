"""Jaccard join of n-gram sets by PartEnum signatures, and the classes that its links make.

Sets are banded by size.  Two sets whose Jaccard similarity reaches the threshold lie in the same or in
neighbouring bands, and there the threshold bounds how many elements they differ in, say by k.  The domain of the elements is
split by hash into k // 2 + 1 + slack parts, and each part into SUBPARTS smaller ones.  Of the parts 1 + slack or more hold
one difference at most, and then all but one of their subparts agree: so the subsets of all subparts but one are
enumerated, and the elements in each make one signature.  Subsets that are empty in both sets would agree as well but say
nothing, so they give no signature.  Of a set with slack thin parts or fewer, those that have an empty subset, some part
that agrees isn't thin; sets with more are split once more by another hash, and so is any partner that they'd be missed
by.  So no pair is lost, whatever the sizes.

Sets that share a signature make candidate clusters.  Near copies share hundreds, dealt over as many buckets; so sets are
first tied by LEADS signatures of each, and then all signatures are matched under the names of the groups that these make:
a group's own links are not made again in every bucket.  Signatures outweigh the texts, so they are matched in PASSES, each with
its part of them.  A large cluster is split by prefixes of rare shingles, which parts sets that only share a passage; where that leaves
huge ones, shingles that many of its prefixes have are put last in the order, and it is split anew.
The sets of candidates are not written: their hashes outweigh the texts as well, so each step makes them of the texts anew.  A cluster that fits a block of sets goes to one task.
Of a larger one every set is first held against the most alike of those that it was tied to, which mostly joins near copies to
one component; then only the sets outside of the largest component are compared with all others, block by block, in rounds that each move a set about once.
Within a task pairs already connected are skipped, a byte sketch of the parts rules out
most others by a lower bound of their difference, and the rest are intersected.  Only a spanning forest of the
links leaves a task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from . import common
from .common import cut, give_back, let_go, merged, partitions, texts
from .graph import combined, components, forests

#: Members of a block, about; a task holds two.
BLOCK = 1024
#: Subparts of a part; a part with one difference agrees in all but one of them.
SUBPARTS = 3
#: Splits by another hash before empty parts give signatures after all.
LEVELS = 6
#: Signatures of a set, those of least hash, that tie near copies before all are matched.
LEADS = 8
#: Parts of all signatures that are matched one after the other; the disk that they take is that of one.
PASSES = 3
#: Candidate documents whose ids are broadcast at most; beyond it the texts are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Clusters of more sets than this are split by their rarest shingles before pairs are looked at.
LARGE = BLOCK
#: Sets that share a rare shingle are compared with each other up to this many, beyond it through one of them.
PAIRED = 8
#: Counters of shingles, and how many of them travel together.
COUNTERS, CHUNK = 1 << 20, 1 << 14
#: How often a cluster is split while huge ones have more sets than ANEW, and how many prefixes may have a shingle that does not go last the next time.
SPLITS, ANEW, COMMON = 4, 16 * BLOCK, 3
#: Sets that a round of blocks moves, if that is more than all that there are.
MOVED = 100_000
#: Ranges of signatures, and bits for each, that say which of them are common.
RANGES, RANGE_BITS = 1 << 10, 1 << 16
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def map_arrow(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """As common.map_arrow, by workers that give back what a task has freed: tasks of several steps follow each other in one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return common.map_arrow(df, run, schema)


class Bands:
    """Size bands, and for each group (a band with the one below it) the parts, their subparts and the slack."""

    def __init__(self, num: int, den: int, largest: int) -> None:
        low = [1]
        while low[-1] <= largest:
            low.append(low[-1] * den // num + 1)
        self.low = np.array(low, dtype=np.int64)
        self.parts = np.ones(len(low) + 1, dtype=np.int64)
        self.subparts = np.ones(len(low) + 1, dtype=np.int64)
        self.slack = np.zeros(len(low) + 1, dtype=np.int64)
        for g in range(len(low) + 1):
            high = low[min(g, len(low) - 1)] * den // num if g < len(low) else (low[-1] * den // num + 1) * den // num
            least = low[g - 1] if g else 1
            k = 2 * high * (den - num) // (den + num)
            if not k:
                continue  # equal sets only
            base, slack = k // 2 + 1, 0
            for _ in range(8):
                n = base + slack
                empty = (1 - 1 / (SUBPARTS * n)) ** least
                thin = n * (SUBPARTS * empty ** (SUBPARTS - 1) * (1 - empty) + empty**SUBPARTS)
                slack = min(base, int(np.ceil(thin + 3 * np.sqrt(thin)))) if thin > 0.05 else 0
            self.parts[g], self.subparts[g], self.slack[g] = base + slack, SUBPARTS, slack

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1


@lru_cache(maxsize=64)
def bands_for(num: int, den: int, power: int) -> Bands:
    return Bands(num, den, 1 << power)


def shingle_rows(s: T.Slice, n: int, pow_: T.Powers) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of the distinct n-word shingles of each text, in order of doc; a text of fewer words has one."""
    w = T.words(s, T.WHITE, T.LOWER, pow_)
    begin = np.cumsum(w.counts) - w.counts
    grams = T.ngrams(w.hash, n)
    per = np.maximum(w.counts - n + 1, 0)
    doc = np.repeat(np.arange(len(per)), per)
    at = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + np.repeat(begin, per)
    h = grams[at]
    for size in range(1, n):
        few = np.flatnonzero(w.counts == size)
        if len(few):
            short = T.mix(T.ngrams(w.hash, size)[begin[few]] + np.uint64(size))
            doc, h = np.concatenate([doc, few]), np.concatenate([h, short])
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(per) <= 1 << 16 else np.int64), kind="stable")]  # numpy sorts 16 bits by radix
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def cell_sums(key: np.ndarray, values: np.ndarray, cells: int) -> np.ndarray:
    """Sums modulo 2**64 by key; halves add up exactly in double precision."""
    low = np.bincount(key, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), cells).astype(np.uint64)
    high = np.bincount(key, (values >> np.uint64(32)).astype(np.float64), cells).astype(np.uint64)
    return low + (high << np.uint64(32))


def set_hashes(doc: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    return T.mix(cell_sums(doc, T.mix(h + np.uint64(77)), docs) + np.bincount(doc, minlength=docs).astype(np.uint64))


def signatures(doc: np.ndarray, h: np.ndarray, docs: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, doc) of sets given as (doc, distinct hash) rows in order of doc."""
    sizes = np.bincount(doc, minlength=docs)
    if not len(doc):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    bands = bands_for(num, den, int(sizes.max()).bit_length() + 1)
    own = bands.of(np.maximum(sizes, 1))
    out_sig, out_doc = [], []
    for offset in (0, 1):
        todo = sizes > 0
        for level in range(LEVELS):
            ids = np.flatnonzero(todo)
            if not len(ids):
                break
            again = np.zeros(docs, dtype=bool)
            for width in (1, SUBPARTS):
                mine = ids[bands.subparts[own[ids] + offset] == width]
                if len(mine):
                    sig, at, thin = enumerated(doc, h, mine, own[mine] + offset, bands, width, level, docs)
                    out_sig.append(sig)
                    out_doc.append(at)
                    again[mine] = thin > bands.slack[own[mine] + offset]
            todo = again
    return np.concatenate(out_sig), np.concatenate(out_doc)


def enumerated(doc: np.ndarray, h: np.ndarray, ids: np.ndarray, group: np.ndarray, bands: Bands, width: int, level: int, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, doc) of the subsets of width - 1 of the width subparts of every part (of the part where width is 1), and the thin parts of each of ids."""
    n = bands.parts[group]
    base, parts = np.zeros(docs, dtype=np.int64), np.zeros(docs, dtype=np.uint64)
    base[ids], parts[ids] = np.cumsum(n) - n, (n * width).astype(np.uint64)
    take = parts[doc] > 0
    d, x = doc[take], h[take]
    spread = T.mix(x ^ np.uint64(int(GOLDEN) * (2 * level + 3) % 2**64))
    subpart = (((spread >> np.uint64(32)) * parts[d]) >> np.uint64(32)).astype(np.int64)
    key, cells = base[d] * width + subpart, int(n.sum()) * width
    filled = np.bincount(key, minlength=cells).reshape(-1, width)
    sums = cell_sums(key, T.mix(x + GOLDEN), cells).reshape(-1, width)
    sums = np.where(filled > 0, T.mix(sums ^ T.mix(np.arange(width, dtype=np.uint64) + np.uint64(7))), np.uint64(0))
    part_doc = np.repeat(ids, n)
    part = np.arange(len(part_doc)) - base[part_doc]
    label = T.mix(np.repeat(group, n).astype(np.uint64) * np.uint64(64) + np.uint64(level)) ^ T.mix(part.astype(np.uint64) + GOLDEN)
    total, count = sums.sum(axis=1, dtype=np.uint64), filled.sum(axis=1)
    sig, at, thin = [], [], np.zeros(len(part_doc), dtype=bool)
    for left_out in range(width):
        rest, some = (total, count) if width == 1 else (total - sums[:, left_out], count - filled[:, left_out])
        thin |= some == 0
        keep = some > 0 if level < LEVELS - 1 else np.ones(len(some), dtype=bool)
        sig.append(T.mix(rest[keep] ^ T.mix(label[keep] + np.uint64(left_out))))
        at.append(part_doc[keep])
    return np.concatenate(sig), np.concatenate(at), np.bincount(part_doc, thin, docs).astype(np.int64)[ids]


def leading(sig: np.ndarray, at: np.ndarray, docs: int) -> list[bytes]:
    """Of each document up to LEADS of its distinct signatures, those whose hashes are least: sets that share many share one of these."""
    spread = T.mix(sig + GOLDEN)
    order = np.lexsort((spread, at))
    sig, at = sig[order], at[order]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = (sig[1:] != sig[:-1]) | (at[1:] != at[:-1])
    sig, at = sig[new], at[new]
    count = np.bincount(at, minlength=docs)
    cuts = np.cumsum(count) - count
    return [sig[c : c + min(k, LEADS)].tobytes() for c, k in zip(cuts, count)]


def nodes(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, node, leads): node names a distinct set, null for a document without words; leads are its leading signatures, packed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pow_ = T.Powers()
        for batch in batches:
            for s in T.slices(batch.column(1)):
                k = len(s.starts)
                doc, h = shingle_rows(s, n, pow_)
                sizes = np.bincount(doc, minlength=k)
                node = pa.array(set_hashes(doc, h, k).view(np.int64), mask=sizes == 0)
                leads = pa.array(leading(*signatures(doc, h, k, num, den), k), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, k), pa.array(sizes.astype(np.int64)), node, leads], names=["doc_id", "n_shingles", "node", "leads"])

    return map_arrow(docs, task, "doc_id long, n_shingles long, node long, leads binary")


def star_edges(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (signature, node) pairs: which are the first of their signature, and edges from those to the others."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    head = np.ones(len(sig), dtype=bool)
    head[1:] = sig[1:] != sig[:-1]
    first = node[np.flatnonzero(head)][np.cumsum(head) - 1]
    rest = ~head & (first != node)
    edges = np.unique(np.stack([first[rest], node[rest]], axis=1), axis=0) if rest.any() else np.zeros((0, 2), dtype=np.int64)
    return np.stack([sig[head].view(np.int64), node[head]], axis=1), edges[:, 0], edges[:, 1]


#: Bytes of a signature that travel with a node; bits of the others deal it to its bucket.  Signatures that agree in both are matched, which may only add candidates.
SIG_BYTES = 5


def narrow(pairs: np.ndarray) -> bytes:
    """(signature, node) rows in SIG_BYTES + 8 bytes each."""
    raw = np.ascontiguousarray(pairs, dtype="<i8").view(np.uint8)
    return np.concatenate([raw[:, :SIG_BYTES], raw[:, 8:]], axis=1).tobytes()


def wide(raw: bytes) -> np.ndarray:
    """The (signature, node) rows of narrow; of the signatures what it has kept."""
    kept = np.frombuffer(raw, dtype=np.uint8).reshape(-1, SIG_BYTES + 8)
    out = np.zeros((len(kept), 16), dtype=np.uint8)
    out[:, :SIG_BYTES], out[:, 8:] = kept[:, :SIG_BYTES], kept[:, SIG_BYTES:]
    return out.view("<i8")


def packed_heads(sig: np.ndarray, node: np.ndarray, count: int) -> pa.RecordBatch:
    """(signature, node) pairs as a row for each bucket of signatures, and the edges they make on the spot in one more."""
    heads, a, b = star_edges(sig, node)
    bucket = (heads[:, 0].view(np.uint64) >> np.uint64(8 * SIG_BYTES)) % np.uint64(count)
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    heads, bucket = heads[order], bucket[order].astype(np.int64)
    cuts = np.searchsorted(bucket, np.arange(count + 1))
    some = np.flatnonzero(np.diff(cuts))
    rows = [(int(i), narrow(heads[cuts[i] : cuts[i + 1]]), False) for i in some]
    if len(a):
        rows.append((int(bucket[0]), np.stack([a, b], axis=1).tobytes(), True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.bool_()))], names=["bucket", "pairs", "edges"])


def tied(df: DataFrame, emit: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(a, b): each node that shares a signature with others is tied to the least of those that a task's signatures connect.

    emit makes packed_heads of a task's batches; where it makes just those of one of emit.passes, their buckets and tasks are as many fewer.  Signatures travel packed, a row for each bucket of signatures and
    batch; a signature that many sets of a batch share leaves it once, its edges made on the spot."""
    parts = -(-partitions(df.sparkSession) // getattr(emit, "passes", 1))
    count = 4 * parts

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for table in merged(batches, "bucket"):
            made = table.column("edges").to_pylist()
            raw, bucket = table.column("pairs").to_pylist(), table.column("bucket").to_pylist()
            yield from (np.frombuffer(x, dtype=np.int64).reshape(-1, 2).T for x, e in zip(raw, made) if e)
            # One table holds whole buckets, perhaps several; what travels of a signature tells it from others of its bucket.
            mine = [wide(x) for x, e in zip(raw, made) if not e]
            if mine:
                both = np.concatenate(mine)
                of = np.repeat([k for k, e in zip(bucket, made) if not e], [len(x) for x in mine])
                sig = np.ascontiguousarray(both[:, 0]).view(np.uint64) | (of.astype(np.uint64) << np.uint64(8 * SIG_BYTES))
                _, a, b = star_edges(sig, np.ascontiguousarray(both[:, 1]))
                yield np.stack([a, b])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from combined(edges(batches))

    packed = map_arrow(df, lambda batches: emit(batches, count), "bucket int, pairs binary, edges boolean")
    dealt = packed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return map_arrow(dealt, match, "a long, b long")


def lead_edges(known: DataFrame) -> DataFrame:
    """(a, b): edges that connect what shares a leading signature, LEADS for each row at most; known: rows of nodes."""

    def emit(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(1)]
                yield packed_heads(np.concatenate(raw), np.repeat(batch.column(0).to_numpy(), [len(x) for x in raw]), count)

    return tied(known.where(F.col("node").isNotNull()).select("node", "leads"), emit)


def candidate_edges(docs: DataFrame, groups: DataFrame, n: int, num: int, den: int, turn: int, passes: int) -> DataFrame:
    """(a, b): edges that connect what shares a PartEnum signature of this turn of passes; a set that its leading signatures have tied goes by its group's name.

    groups: (doc_id, set, group), a row for an id at most; it holds for those of the id's rows whose text makes that set."""
    named = groups.select(F.col("doc_id").alias("grouped"), "set", "group")
    named = F.broadcast(named) if groups.count() <= BROADCAST_IDS else named.hint("shuffle_hash")  # texts are not sorted
    rows = docs.join(named, F.col("doc_id") == F.col("grouped"), "left").select("text", "set", "group")

    def emit(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
        pow_ = T.Powers()
        for batch in batches:
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            set_, group = (batch.column(i).fill_null(0).to_numpy() for i in (1, 2))
            for s in T.slices(batch.column(0)):
                k = len(s.starts)
                here = slice(s.first, s.first + k)
                doc, h = shingle_rows(s, n, pow_)
                if len(doc):
                    sig, at = signatures(doc, h, k, num, den)
                    now = np.flatnonzero(sig % np.uint64(passes) == turn)
                    node = set_hashes(doc, h, k).view(np.int64)
                    node = np.where(known[here] & (set_[here] == node), group[here], node)
                    if len(now):
                        yield packed_heads(sig[now], node[at[now]], count)

    emit.passes = passes
    return tied(rows, emit)


def candidate_clusters(docs: DataFrame, known: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, label): the clusters of what shares PartEnum signatures; known: nodes of docs, written."""
    leads = cut(components(forests(cut(lead_edges(known), "leads"))).where("label <> node"), "groups")
    of_docs = known.where(F.col("doc_id").isNotNull()).join(F.broadcast(leads) if leads.count() <= BROADCAST_IDS else leads, "node")
    # Rows may share an id: the least of their sets goes by its group's name, others by their own, so that no row is joined twice.
    groups = cut(of_docs.groupBy("doc_id").agg(F.min(F.struct("node", "label")).alias("of")).select("doc_id", F.col("of.node").alias("set"), F.col("of.label").alias("group")), "groups")
    turns = [cut(candidate_edges(docs, groups, n, num, den, turn, PASSES), "candidates") for turn in range(PASSES)]
    return components(forests(reduce(DataFrame.unionByName, turns).unionByName(leads.select(F.col("label").alias("a"), F.col("node").alias("b")))))


def shingled(texts_: pa.Array, node: np.ndarray, n: int, pow_: T.Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mine, cuts, hashes): the sets of texts, in order, and which of them are the set that node names: rows may share an id but not the text."""
    mine, sizes, hashes = [np.zeros(0, bool)], [np.zeros(1, np.int64)], [np.zeros(0, np.uint64)]
    for s in T.slices(texts_):
        k = len(s.starts)
        doc, h = shingle_rows(s, n, pow_)
        mine.append(set_hashes(doc, h, k).view(np.int64) == node[s.first : s.first + k])
        sizes.append(np.bincount(doc, minlength=k))
        hashes.append(h)
    return np.concatenate(mine), np.cumsum(np.concatenate(sizes)), np.concatenate(hashes)


#: Of a batch: its rows that count, and (cuts, hashes) of their sets.
Unpack = Callable[[pa.RecordBatch], tuple[pa.RecordBatch, np.ndarray, np.ndarray]]


def of_texts(n: int) -> Unpack:
    """Of batches of (node, text, ...)."""
    pow_ = T.Powers()

    def unpack(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        mine, cuts, h = shingled(batch.column(1), batch.column(0).to_numpy(), n, pow_)
        sizes = np.diff(cuts)
        return batch.filter(pa.array(mine)), np.concatenate([[0], np.cumsum(sizes[mine])]), h[np.repeat(mine, sizes)]

    return unpack


def unpacked(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Of a batch of (node, size, shingles, ...), where sets are packed hashes."""
    sizes = batch.column(1).to_numpy()
    raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
    return batch, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(raw) if raw else np.zeros(0, np.uint64)


def standing(docs: DataFrame, members: DataFrame, *columns: str) -> DataFrame:
    """(node, text, columns): of members (node, doc_id, ...) the rows of docs that have the ids, those with other texts as well."""
    mine = members.select(F.col("doc_id").alias("member"), "node", *columns)
    mine = F.broadcast(mine) if members.count() <= BROADCAST_IDS else mine.hint("shuffle_hash")  # texts are not sorted
    return docs.select(F.col("doc_id").alias("of"), "text").join(mine, F.col("of") == F.col("member")).select("node", "text", *columns)


def held(docs: DataFrame, members: DataFrame, *columns: str) -> DataFrame:
    """As standing; where that takes a shuffle of all texts, those of members are written, for several steps read them."""
    found = standing(docs, members, *columns)
    return found if members.count() <= BROADCAST_IDS else cut(found, "member-texts", compression="zstd")


def once(docs: DataFrame, known: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """docs, or where a row that stands for one of members is repeated, just one row for each of members."""
    repeated = known.groupBy("node", "doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    if repeated.join(members, ["node", "doc_id"], "left_semi").isEmpty():
        return docs

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = of_texts(n)
        for batch in batches:
            yield unpack(batch)[0]

    rows = map_arrow(standing(docs, members, "doc_id"), task, "node long, text string, doc_id long")
    return cut(rows.dropDuplicates(["node"]).select("doc_id", "text"), "repeated-rows")


def shingle_counts(found: DataFrame, unpack: Unpack = unpacked) -> np.ndarray:
    """How often shingles come in the rows of found, by COUNTERS buckets of their hashes: 4 bytes a bucket, whatever
    the input's size.  Shingles of one bucket count together, which makes some look less rare than they are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            total += np.bincount((unpack(batch)[2] >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
        parts = np.minimum(total, 2**32 - 1).astype("<u4").reshape(-1, CHUNK)
        some = np.flatnonzero(parts.any(axis=1))
        if len(some):
            at = [np.flatnonzero(parts[i]) for i in some]
            columns = [pa.array(some.astype(np.int32)), pa.array([x.astype("<u2").tobytes() for x in at], pa.binary()), pa.array([parts[i][x].tobytes() for i, x in zip(some, at)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "at", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, at, raw in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                sums.setdefault(chunk, np.zeros(CHUNK, dtype=np.int64))[np.frombuffer(at.as_buffer(), dtype="<u2")] += np.frombuffer(raw.as_buffer(), dtype="<u4")
        for chunk, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())], names=["chunk", "counts"])

    packed = map_arrow(found, count, "chunk int, at binary, counts binary").repartition(min(partitions(found.sparkSession), COUNTERS // CHUNK), "chunk")
    out = np.zeros((COUNTERS // CHUNK, CHUNK), dtype=np.uint32)
    for r in map_arrow(packed, add, "chunk int, counts binary").collect():  # one job; an iterator makes one of each partition
        out[r["chunk"]] = np.frombuffer(r["counts"], dtype="<u4")
    let_go(found.sparkSession)
    return out.reshape(-1)


def tied_or_paired(df: DataFrame, emit: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(a, b, sure) of nodes that share a signature.

    emit makes (signature, node) pairs.  Up to PAIRED nodes of a signature are paired with each other, sure is
    false; where there are more, each is tied to the least of them, sure is true, and those of one batch leave it as one."""
    count = 4 * partitions(df.sparkSession)
    entry, edge, hot = 0, 1, 2

    def groups(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
        sig, node = sig[new], node[new]
        head = np.concatenate([[True], sig[1:] != sig[:-1]])
        first = np.flatnonzero(head)
        return sig, node, first, np.diff(np.concatenate([first, [len(sig)]]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, node in emit(batches):
            sig, node, first, size = groups(sig, node)
            many = np.repeat(size > PAIRED, size)
            start = np.repeat(node[first], size)
            lead = np.zeros(len(sig), dtype=bool)
            lead[first] = True
            rows = []
            for kind, take in ((entry, ~many), (hot, many & lead)):
                bucket = ((sig[take] >> np.uint64(20)) % np.uint64(count)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                both = np.stack([sig[take].view(np.int64), node[take]], axis=1)[order]
                cuts = np.searchsorted(bucket[order], np.arange(count + 1))
                rows += [(int(i), both[cuts[i] : cuts[i + 1]].tobytes(), kind) for i in np.flatnonzero(np.diff(cuts))]
            rest = many & ~lead
            if rest.any():
                rows.append((int(start[rest][0]) % count, np.stack([start[rest], node[rest]], axis=1).tobytes(), edge))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.int32()))], names=["bucket", "pairs", "kind"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in merged(batches, "bucket"):
            kinds = table.column("kind").to_pylist()
            parts = [np.frombuffer(x.as_py(), dtype=np.int64).reshape(-1, 2) for x in table.column("pairs")]
            ties = [p for p, k in zip(parts, kinds) if k == edge]
            known = np.unique(np.concatenate([p[:, 0] for p, k in zip(parts, kinds) if k == hot] or [np.zeros(0, np.int64)]))
            mine = [p for p, k in zip(parts, kinds) if k != edge]
            pairs = []
            if mine:
                both = np.concatenate(mine)
                sig, node, first, size = groups(np.ascontiguousarray(both[:, 0]).view(np.uint64), np.ascontiguousarray(both[:, 1]))
                many = np.repeat((size > PAIRED) | np.isin(sig[first].view(np.int64), known), size)
                start = np.repeat(node[first], size)
                rest = many & (start != node)
                ties.append(np.stack([start[rest], node[rest]], axis=1))
                for step in range(1, PAIRED):
                    near = np.flatnonzero((sig[:-step] == sig[step:]) & ~many[:-step])
                    pairs.append(np.stack([node[near], node[near + step]], axis=1))
            for found, sure in ((ties, True), (pairs, False)):
                out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
                if len(out):
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(out[:, i])) for i in (0, 1)), pa.array(np.full(len(out), sure))], names=["a", "b", "sure"])

    packed = map_arrow(df, send, "bucket int, pairs binary, kind int")
    dealt = packed.repartition(partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket")
    return map_arrow(dealt, match, "a long, b long, sure boolean")


def common_signatures(df: DataFrame, emit: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
    """A bit for each of RANGES * RANGE_BITS stretches of signatures: whether it has one that more than COMMON nodes have.

    emit makes (signature, node) pairs, each once.  A task counts whole ranges of signatures; 8 MB reach the driver at most."""
    bits = np.uint64(RANGE_BITS - 1)
    at = np.uint64(64 - (RANGES * RANGE_BITS).bit_length() + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, _ in emit(batches):
            sig = np.sort(sig)
            cuts = np.searchsorted(sig, np.arange(RANGES, dtype=np.uint64) << np.uint64(64 - RANGES.bit_length() + 1))
            cuts = np.append(cuts, len(sig))
            rows = [(int(i), sig[cuts[i] : cuts[i + 1]].tobytes()) for i in np.flatnonzero(np.diff(cuts))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary()))] if rows else [pa.array([], pa.int32()), pa.array([], pa.binary())], names=["range", "signatures"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in merged(batches, "range"):
            sig, times = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("signatures")]), return_counts=True)
            sig = sig[times > COMMON]
            range_ = (sig >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64)
            for i in np.unique(range_):
                flags = np.zeros(RANGE_BITS, dtype=bool)
                flags[((sig[range_ == i] >> at) & bits).astype(np.int64)] = True
                yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["range", "flags"])

    sent = map_arrow(df, send, "range int, signatures binary").repartition(partitions(df.sparkSession), "range").sortWithinPartitions("range")
    out = np.zeros((RANGES, RANGE_BITS // 8), dtype=np.uint8)
    for r in map_arrow(sent, count, "range int, flags binary").collect():
        out[r["range"]] = np.frombuffer(r["flags"], dtype=np.uint8)
    let_go(df.sparkSession)
    return out.reshape(-1)


def prefix_edges(found: DataFrame, num: int, den: int, unpack: Unpack, again: bool) -> DataFrame:
    """(a, b, sure) among rows (node, text, cluster): sets of a cluster that share one of their rarest shingles.

    Linked sets share num/den of the larger one's shingles, so under any order of the shingles they share one of the
    first that a set has more than it may lack; ordered by rarity, a passage that many texts share comes last.  Counters tell
    rare shingles from others only while they are many more than common shingles; so again puts those last that, by the counters alone, more than COMMON prefixes of a cluster have."""
    context = found.sparkSession.sparkContext
    counts = context.broadcast(shingle_counts(found, unpack))  # COUNTERS numbers
    at = np.uint64(64 - (RANGES * RANGE_BITS).bit_length() + 1)

    def prefixes(common: Broadcast[np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for whole in batches:
                batch, cuts, h = unpack(whole)
                if not batch.num_rows:
                    continue
                node, cluster = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                sizes = np.diff(cuts)
                owner = np.repeat(np.arange(len(node)), sizes)
                sig = T.mix(h ^ T.mix(cluster.view(np.uint64))[owner])
                seen = counts.value[(h >> np.uint64(44)).astype(np.int64)].astype(np.int64)
                if common is not None:
                    bit = (sig >> at).astype(np.int64)
                    seen += ((common.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).astype(np.int64) << 32
                order = np.lexsort((h, seen, owner))
                rank = np.arange(len(h)) - np.repeat(cuts[:-1], sizes)
                first = rank < (sizes - (sizes * num + den - 1) // den + 1)[owner]
                yield sig[order][first], node[owner[first]]

        return emit

    return tied_or_paired(found, prefixes(context.broadcast(common_signatures(found, prefixes(None))) if again else None))


def sketch_rows(found: DataFrame, num: int, den: int, unpack: Unpack) -> DataFrame:
    """(node, size, sketch) of rows of found: a byte for each of a power of two of parts, more than
    may differ between linked sets; a wider sketch folds into a narrower one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch, cuts, h = unpack(whole)
            sizes = np.diff(cuts)
            most = sizes * 2 * (den - num) // (den + num)
            width = np.array([1 << min(max(6, int(m + m // 4 + 4).bit_length()), 12) for m in most], dtype=np.int64)
            base = np.cumsum(width) - width
            owner = np.repeat(np.arange(len(sizes)), sizes)
            x = T.mix(h + np.uint64(5))
            flat = np.zeros(int(width.sum()), dtype=np.uint8)
            np.bitwise_xor.at(flat, base[owner] + (x & (width[owner] - 1).astype(np.uint64)).astype(np.int64), (x >> np.uint64(56)).astype(np.uint8))
            sketch = [flat[b : b + w].tobytes() for b, w in zip(base, width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(sketch, pa.binary())], names=["node", "size", "sketch"])

    return map_arrow(found, task, "node long, size long, sketch binary")


def alike(pairs: DataFrame, sketched: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) whose sizes and sketches do not rule a link out, and unlike, how many bytes of the sketches differ."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            fits = np.minimum(size_a, size_b) * den >= np.maximum(size_a, size_b) * num
            unlike = np.zeros(len(fits), dtype=np.int64)
            for i in np.flatnonzero(fits):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint8) for c in (3, 5))
                while len(x) != len(y):
                    x, y = (x, y) if len(x) < len(y) else (y, x)
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                unlike[i] = np.count_nonzero(x != y)
                fits[i] = unlike[i] * (den + num) <= (size_a[i] + size_b[i]) * (den - num)
            kept = pa.array(fits)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(kept) for i in (0, 1)), pa.array(unlike[fits])], names=["a", "b", "unlike"])

    side = lambda c: sketched.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b")
    return map_arrow(both, task, "a long, b long, unlike long")


def shares(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets, each in order, are linked."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    shared = int(np.count_nonzero(y[at] == x))
    return den * shared >= num * (len(x) + len(y) - shared)


def verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The (a, b) of pairs that are linked; a set that many pairs have meets them in a join that Spark splits where it is skewed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pow_ = T.Powers()
        for batch in batches:
            (mine_a, at_a, x), (mine_b, at_b, y) = (shingled(batch.column(c + 2), batch.column(c).to_numpy(), n, pow_) for c in (0, 1))
            kept = pa.array([bool(mine_a[i] and mine_b[i]) and shares(x[at_a[i] : at_a[i + 1]], y[at_b[i] : at_b[i + 1]], num, den) for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(kept) for i in (0, 1)], names=["a", "b"])

    asked = members.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    rows = standing(docs, cut(asked.select("node", "doc_id"), "asked"))
    side = lambda c: rows.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return map_arrow(both, task, "a long, b long")


def large_of(members: DataFrame, most: int) -> DataFrame:
    """(cluster) of more than most members; by turned bits, as in graph.least_neighbours."""
    sized = members.groupBy(F.bitwise_not("cluster").alias("turned")).agg(F.count("*").alias("members"))
    return sized.where(F.col("members") > most).select(F.bitwise_not("turned").alias("cluster"))


def split_large(docs: DataFrame, members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """members (node, doc_id, cluster) with comp: clusters of more than LARGE sets split by prefix_edges, and of those that still have more than BLOCK the components that links found at once make.

    Texts that share a passage share signatures that hold little else, and through them most of a corpus
    may hang together; what shares none of its rarest shingles, or shares some but differs too much by its
    sketch, is parted here, and no link is lost.  What is huge still is split anew, SPLITS times in all at most and while it shrinks, with what was common in its prefixes last.
    Then each set of a cluster beyond a block is held against the one, of those that it is tied to, whose sketch differs least."""
    unpack = of_texts(n)
    ids = members.select("node", "doc_id")
    plain = members.select("node", "doc_id", "cluster", F.col("node").alias("comp"))
    big = cut(members.join(large_of(members, LARGE), "cluster", "left_semi").select("node", "doc_id", "cluster"), "large-clusters")
    if big.isEmpty():
        return plain
    done = [plain.join(big.select("node"), "node", "left_anti")]
    found = held(docs, big, "cluster")
    sketched = cut(sketch_rows(found, num, den, unpack), "sketches")
    for turn in range(SPLITS):
        edges = cut(prefix_edges(found, num, den, unpack, turn > 0), "prefixes")
        near = cut(alike(edges.where("not sure").select("a", "b").distinct(), sketched, num, den), "near")
        tied_ = edges.where("sure").select("a", "b")
        parts = cut(components(forests(tied_.unionByName(near.select("a", "b")))).select("node", F.col("label").alias("cluster")).join(ids, "node"), "parts")
        huge = cut(parts.join(large_of(parts, BLOCK), "cluster", "left_semi"), "huge-clusters")
        done.append(parts.join(huge.select("node"), "node", "left_anti").withColumn("comp", F.col("node")))
        before, left = big.count(), huge.count()
        if not left:
            return cut(reduce(DataFrame.unionByName, done), "members")
        if left <= ANEW or turn == SPLITS - 1 or turn and 10 * left > 9 * before:
            break
        big, found = huge, held(docs, huge, "cluster")
    mine = huge.select(F.col("node").alias("b"))
    choices = alike(tied_.distinct().join(mine, "b", "left_semi"), sketched, num, den).unionByName(near.join(mine, "b", "left_semi"))
    best = choices.groupBy("b").agg(F.min(F.struct("unlike", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    comps = components(forests(cut(verified(cut(best, "ties"), docs, ids, n, num, den), "tied"))).withColumnRenamed("label", "comp")
    done.append(huge.join(comps, "node", "left").select("node", "doc_id", "cluster", F.coalesce("comp", "node").alias("comp")))
    return cut(reduce(DataFrame.unionByName, done), "members")


def sketches(sets: list[np.ndarray], width: int) -> np.ndarray:
    """A byte for each of width parts of each set; two sets differ in at least as many elements as bytes."""
    out = np.zeros((len(sets), width), dtype=np.uint8)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    x = T.mix(np.concatenate(sets) + np.uint64(5))
    np.bitwise_xor.at(out, (row, (x % np.uint64(width)).astype(np.int64)), (x >> np.uint64(56)).astype(np.uint8))
    return out


def forest(sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different components, of one side, or where there are two sides between them."""
    sizes = np.array([len(x) for x in sets])
    most = int(sizes.max() * 2 * (den - num) // (den + num))
    sk = sketches(sets, 1 << min(max(6, (4 * most + 4).bit_length()), 12))
    two = side.any() and not side.all()
    parent = np.unique(comp, return_index=True, return_inverse=True)
    parent = parent[1][parent[2].reshape(-1)].tolist()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(len(sets)):
        near = np.arange(i + 1, len(sets))
        small, large = np.minimum(sizes[i], sizes[near]), np.maximum(sizes[i], sizes[near])
        near = near[(small * den >= large * num) & (comp[near] != comp[i]) & ((side[near] != side[i]) if two else True)]
        if not len(near):
            continue
        unlike = np.count_nonzero(sk[near] != sk[i], axis=1)
        fits = unlike * (den + num) <= (sizes[near] + sizes[i]) * (den - num)
        near = near[fits][np.argsort(unlike[fits], kind="stable")]
        for j in near:
            a, b = root(i), root(int(j))
            if a != b and shares(sets[i], sets[j], num, den):
                parent[b] = a
                links.append((i, int(j)))
    return links


def placed_in_blocks(members: DataFrame) -> DataFrame:
    """members (node, doc_id, cluster, comp) with block and the range first..last of blocks to meet: all of a cluster's sets in one block where they fit.
    Of others those outside of the largest component fill the first blocks and meet all; those in it come behind and meet the first
    ones only, so a cluster that is one component goes nowhere."""
    comps = members.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    main = comps.groupBy(F.bitwise_not("cluster").alias("turned")).agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("main"))
    main = main.select(F.bitwise_not("turned").alias("cluster"), "size", F.col("main.comp").alias("main"), F.ceil((F.col("size") - F.col("main.n")) / BLOCK).cast("int").alias("outer"), F.ceil(F.col("main.n") / BLOCK).cast("int").alias("inner"))
    whole, inside = F.col("size") <= BLOCK, F.col("comp") == F.col("main")
    deal = lambda count: F.pmod(F.xxhash64("node", F.lit(9)), F.greatest(count, F.lit(1))).cast("int")
    zero = F.lit(0)
    block = F.when(whole, zero).when(inside, F.col("outer") + deal(F.col("inner"))).otherwise(deal(F.col("outer")))
    last = F.when(whole, zero).when(inside, F.col("outer") - 1).otherwise(F.col("outer") + F.col("inner") - 1)
    return members.join(main, "cluster").select("node", "doc_id", "cluster", "comp", block.alias("block"), last.alias("last")).where("last >= 0")


def links(docs: DataFrame, members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b): links that connect all sets of each cluster which links connect at all and which comp doesn't join.

    members: (node, doc_id, cluster, comp).  Each two blocks meet in one of so many rounds that a round moves a set once, on the average, or MOVED sets in all."""
    placed = cut(placed_in_blocks(members), "blocks")
    sets, moves = placed.agg(F.count("*"), F.sum(F.col("last") + 1)).first()
    rounds = -(-(moves or 0) // max(sets, MOVED))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pow_ = T.Powers()
        for table in merged(batches, "task"):
            key = table.column("task").to_numpy()
            for part in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):
                mine = table.slice(int(part[0]), len(part))
                node = mine.column("node").to_numpy()
                right, cuts, h = shingled(mine.column("text"), node, n, pow_)
                at = np.flatnonzero(right)
                if len(at) < 2:
                    continue
                comp, second = mine.column("comp").to_numpy(), mine.column("second").to_numpy(zero_copy_only=False)
                pairs = forest([h[cuts[i] : cuts[i + 1]] for i in at], comp[at], second[at], num, den)
                if pairs:
                    found = at[np.array(pairs)]
                    yield pa.RecordBatch.from_arrays([pa.array(node[found[:, i]]) for i in (0, 1)], names=["a", "b"])

    def met(turn: int) -> DataFrame:
        others = F.filter(F.sequence(F.lit(0), F.col("last")), lambda x: F.pmod(x + F.col("block"), F.lit(rounds)) == turn)
        now = cut(placed.withColumn("others", others).where(F.size("others") > 0), "round") if rounds > 1 else placed.withColumn("others", others)
        tasks = standing(docs, now, "cluster", "comp", "block", "others").select("*", F.explode("others").alias("other")).select(
            F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other")).alias("task"), (F.col("block") > F.col("other")).alias("second"), "node", "comp", "text"
        )
        tasks = tasks.repartition(partitions(docs.sparkSession), "task").sortWithinPartitions("task")
        return cut(map_arrow(tasks, verify, "a long, b long"), "links")

    return reduce(DataFrame.unionByName, [met(turn) for turn in range(max(rounds, 1))])


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, n_shingles (distinct n-word shingles of the text, A-Z lower-cased) and
    component_id, the smallest doc_id that links of Jaccard similarity num/den or more lead to.

    A text of fewer than n words has its whole sequence as the one shingle; a null or wordless text has
    none and stays alone.  Repeated rows each give a row; a null id stays null and names no class;
    an empty table gives no rows."""
    rows = texts(docs, id_col, text_col)
    known = cut(nodes(rows, n, num, den), "sets")
    candidates = candidate_clusters(rows, known, n, num, den)
    worded = known.where(F.col("node").isNotNull())
    reps = worded.where(F.col("doc_id").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    members = cut(candidates.select("node", F.col("label").alias("cluster")).join(reps, "node"), "members")
    rows = once(rows, worded, members, n)
    placed = split_large(rows, members, n, num, den)
    joined = placed.where(F.col("comp") != F.col("node")).select(F.col("comp").alias("a"), F.col("node").alias("b"))
    found = components(forests(links(rows, placed, n, num, den).unionByName(joined)))
    # The least id of a class by way of its sets, then of each set; documents without words meet nothing.
    in_class = reps.join(found, "node")
    least = in_class.groupBy(F.bitwise_not("label").alias("turned")).agg(F.min("doc_id").alias("least")).select(F.bitwise_not("turned").alias("label"), "least")
    of_node = in_class.join(least, "label").select("node", "least")
    named = cut(reps.join(of_node, "node", "left").select("node", F.coalesce("least", "doc_id").alias("component_id")), "classes")
    out = worded.join(named, "node", "left").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(known.where(F.col("node").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
