"""Removal of word windows that an earlier document has, by fixed-block anchors.

Every window of w words holds a whole block of b = w // 2 words at a multiple of b, wherever the window
begins (2b - 1 <= w).  So the index needs only the non-overlapping blocks of each document, and every rolling
b-word window probes it.  A hit is extended to the windows that contain it: where the words around it are
those around an indexed block of an earlier document all of them repeat at once; otherwise each window around it
is looked up among the windows around the blocks that were hit.  Windows that repeat join to maximal exact repeats.
A block may be hit by chance; what decides, surroundings and windows, is told by two 64-bit hashes of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textscan as T
from .common import cut, map_arrow, texts
from .slicerows import Held, answers, answers_schema, buckets, by_bucket, dealt, dealt_schema, entry_counts, held, slice_rows, column, with_answers

WINDOW = 50
#: An anchor with more distinct surroundings in the index sends none of them along with a hit; its hits look up windows.
SURROUNDINGS = 8
INDEX, PROBE, SPANS = 0, 1, 2
SURE, SEEK, GIVE = 0, 1, 2


class WordSlice:
    """The words of a slice, with hashes of any run of them."""

    def __init__(self, h: Held, pow_: T.Powers) -> None:
        self.words = T.words(h.text, T.WHITE, T.SAME, pow_)
        counts = self.words.counts
        self.begin = np.cumsum(counts) - counts
        self.end = self.begin + counts
        up, self.down = pow_.to(len(self.words.hash) + 1)
        self.total, self.other = np.zeros((2, len(self.words.hash) + 1), dtype=np.uint64)
        for total, start in ((self.total, 3), (self.other, 11)):
            np.cumsum(T.mix(self.words.hash + np.uint64(start)) * up[: len(self.words.hash)], out=total[1:])

    def run(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return T.mix((self.total[hi] - self.total[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))

    def check(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Another hash of a run: runs alike in both are taken as equal."""
        return T.mix((self.other[hi] - self.other[lo]) * self.down[lo])

    def around(self, at: np.ndarray, window: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows whose first whole block is at a place can lie, within its document."""
        doc = self.words.doc[at]
        return np.maximum(at - (block - 1), self.begin[doc]), np.minimum(at + window, self.end[doc])

    def surroundings(self, at: np.ndarray, window: int, block: int) -> np.ndarray:
        lo, hi = self.around(at, window, block)
        return T.mix(self.run(lo, hi) ^ T.mix((at - lo).astype(np.uint64) * np.uint64(1 << 32) + (hi - at).astype(np.uint64)))


def least_of(ids: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Places of the least id for each combination of keys."""
    order = np.lexsort((ids, *keys))
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order[new]


class BlockIndex:
    """The blocks of one bucket, which probes are held against one row after the other."""

    def __init__(self, rows: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(rows)
        ids, near, check, key = column(table, "c2", "<i8"), column(table, "c3", "<u8"), column(table, "c4", "<u8"), column(table, "c0", "<u4")
        name = np.repeat(table.column("slice").to_numpy(), entry_counts(table, "c0", 4))
        first = least_of(ids, check, near, key)
        self.at, self.ids, self.near, self.check, self.name = column(table, "c1", "<u4")[first], ids[first], near[first], check[first], name[first]
        self.keys, self.first = np.unique(key[first], return_index=True)
        self.kinds = np.diff(np.concatenate([self.first, [len(first)]]))
        self.least = np.minimum.reduceat(self.ids, self.first)
        self.hit = np.zeros(len(self.keys), dtype=bool)

    def answer(self, row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """SURE with surroundings of an earlier block, or SEEK for a hit to look its windows up."""
        short = np.frombuffer(row.column("c0")[0].as_buffer(), "<u4")
        where = np.minimum(np.searchsorted(self.keys, short), len(self.keys) - 1)
        same = np.flatnonzero(self.keys[where] == short)
        if not len(same):
            return
        raw = memoryview(row.column("c1")[0].as_buffer())
        place = np.cumsum(np.frombuffer(raw[1:], "<u4" if bytes(raw[:1]) == b"W" else "<u2"), dtype=np.int64)
        doc = np.repeat(np.frombuffer(row.column("c2")[0].as_buffer(), "<i8"), np.frombuffer(row.column("c3")[0].as_buffer(), "<u4"))
        where, place, doc = where[same], place[same], doc[same]
        later = self.least[where] < doc
        where, place, doc = where[later], place[later], doc[later]
        if not len(where):
            return
        self.hit[where] = True
        few = self.kinds[where] <= SURROUNDINGS
        n = np.where(few, self.kinds[where], 0)
        entry = np.repeat(self.first[where], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        earlier = self.ids[entry] < np.repeat(doc, n)
        at, near, check = np.repeat(place, n)[earlier], self.near[entry][earlier], self.check[entry][earlier]
        many = place[~few]
        none = np.zeros(len(many), np.uint64)
        out = [np.concatenate([at, many]).astype("<u4"), np.concatenate([np.full(len(at), SURE, np.uint8), np.full(len(many), SEEK, np.uint8)]), np.concatenate([near, none]), np.concatenate([check, none])]
        yield answers(np.full(len(out[0]), row.column("slice")[0].as_py(), dtype=np.int64), out)

    def end(self) -> Iterator[pa.RecordBatch]:
        """GIVE for the blocks that were hit and whose windows are to be looked up in."""
        give = np.repeat(self.hit, self.kinds)
        if give.any():
            yield answers(self.name[give], [self.at[give].astype("<u4"), np.full(int(give.sum()), GIVE, np.uint8), self.near[give], self.check[give]])


class WindowIndex:
    """The windows of one bucket with the least document that has each."""

    def __init__(self, rows: list[pa.RecordBatch], window: int) -> None:
        table = pa.Table.from_batches(rows)
        key, ids, check = column(table, "c0", "<u8"), column(table, "c1", "<i8"), column(table, "c3", "<u8")
        first = least_of(ids, check, key)
        self.key, self.check, self.ids, self.window = key[first], check[first], ids[first], window

    def answer(self, row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        mine, doc, at, check = (np.frombuffer(row.column(c)[0].as_buffer(), k) for c, k in (("c0", "<u8"), ("c1", "<i8"), ("c2", "<u4"), ("c3", "<u8")))
        where = np.minimum(np.searchsorted(self.key, mine), len(self.key) - 1)
        while True:  # on to the next of other windows with the same first hash
            next_ = np.minimum(where + 1, len(self.key) - 1)
            wrong = (self.key[where] == mine) & (self.check[where] < check) & (self.key[next_] == mine) & (next_ > where)
            if not wrong.any():
                break
            where = np.where(wrong, next_, where)
        gone = at[(self.key[where] == mine) & (self.check[where] == check) & (self.ids[where] < doc)]
        if len(gone):
            spans = np.stack([gone, gone + np.uint32(self.window)], axis=1).astype("<u4")
            yield pa.RecordBatch.from_arrays([row.column("slice"), pa.array([spans.tobytes()], pa.binary())], names=["slice", "c0"])

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def probed(batches: Iterator[pa.RecordBatch], build: Callable[[list[pa.RecordBatch]], BlockIndex | WindowIndex]) -> Iterator[pa.RecordBatch]:
    """Of rows by bucket, an index' in front of its probes: a task holds one bucket's index, never its probes."""
    bucket, rows, index = None, [], None
    for batch in batches:
        for i, (b, kind) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist())):
            if b != bucket:
                if index is not None:
                    yield from index.end()
                bucket, rows, index = b, [], None
            row = batch.slice(i, 1)
            if kind == SPANS:
                yield pa.RecordBatch.from_arrays([row.column("slice"), row.column("c0")], names=["slice", "c0"])
            elif kind == INDEX:
                rows.append(row)
            elif rows:
                if index is None:
                    index = build(rows)
                yield from index.answer(row)
    if index is not None:
        yield from index.end()


def remove_seen_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per input row: doc_id, n_words, n_removed, kept_sha256 and spans, an array of the removed runs'
    begins and ends in words; with keep_text also kept, the remaining words joined by one space.

    Words are runs of no white space.  Removed is each word of a window whose words also stand, in this order and
    unchanged, in a document with a smaller id.  A null text has no words; a document with a null id
    is neither earlier nor later than any; rows with the same id don't affect each other; an empty table gives no rows."""
    block = (window + 1) // 2
    slices = slice_rows(texts(docs, id_col, text_col))
    count = buckets(slices)
    cache: dict[str, T.Powers] = {}

    def powers_() -> T.Powers:
        return cache.setdefault("", T.Powers())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h in held(batch):
                ws = WordSlice(h, powers_())
                n = ws.words.counts
                per = np.where(h.known & (n >= window), n - block + 1, 0)
                if not per.sum():
                    continue
                doc = np.repeat(np.arange(len(per)), per)
                inside = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
                at = ws.begin[doc] + inside
                key = ws.run(at, at + block)
                bucket = key % np.uint64(count)
                short = (key >> np.uint64(32)).astype(np.uint32)
                aligned = np.flatnonzero(inside % block == 0)
                # One block, of the slice's least document, stands for all with the same surroundings.
                near, check = ws.surroundings(at[aligned], window, block), ws.check(*ws.around(at[aligned], window, block))
                first = least_of(h.ids[doc[aligned]], check, near, key[aligned])
                aligned, near, check = aligned[first], near[first], check[first]
                index = dealt(h.name, bucket[aligned], count, [short[aligned], at[aligned].astype(np.uint32), h.ids[doc[aligned]], near, check], INDEX)
                order = np.argsort(bucket.astype(np.uint32), kind="stable")
                bucket, short, at, doc = bucket[order], short[order], at[order], doc[order]
                rows = dealt_probes(h, bucket, count, short, at, doc)
                yield index  # every document with a window has a block
                yield rows

    def dealt_probes(h: Held, bucket: np.ndarray, count: int, short: np.ndarray, at: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        """Probes by bucket: hashes, places as differences, and for each document its id and number of probes."""
        cuts = np.searchsorted(bucket, np.arange(count + 1))
        some = np.flatnonzero(np.diff(cuts))
        columns: list[list[bytes]] = [[], [], [], []]
        for i in some:
            a, b = cuts[i], cuts[i + 1]
            steps = np.diff(at[a:b], prepend=0)
            wide = int(steps.max()) >= 1 << 16
            heads = np.flatnonzero(np.concatenate([[True], doc[a + 1 : b] != doc[a : b - 1]]))
            runs = np.diff(np.concatenate([heads, [b - a]]))
            columns[0].append(short[a:b].tobytes())
            columns[1].append((b"W" + steps.astype("<u4").tobytes()) if wide else (b"N" + steps.astype("<u2").tobytes()))
            columns[2].append(h.ids[doc[a:b][heads]].astype("<i8").tobytes())
            columns[3].append(runs.astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), PROBE, np.int32)), pa.array(np.full(len(some), h.name, np.int64)), *(pa.array(c, pa.binary()) for c in columns), pa.nulls(len(some), pa.binary())],
            names=["bucket", "kind", "slice", "c0", "c1", "c2", "c3", "c4"],
        )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers (place, what, surroundings) of BlockIndex."""
        return probed(batches, BlockIndex)

    found = cut(map_arrow(by_bucket(map_arrow(slices, probe, dealt_schema(5)), count), match, answers_schema(4)), "hits")

    def extend(h: Held, right: pa.Table) -> Iterator[pa.RecordBatch]:
        if not right.num_rows:
            return
        ws = WordSlice(h, powers_())
        at, what = column(right, "c0", "<u4").astype(np.int64), column(right, "c1", "u1")
        lo, hi = ws.around(at, window, block)
        same = (ws.surroundings(at, window, block) == column(right, "c2", "<u8")) & (ws.check(lo, hi) == column(right, "c3", "<u8"))
        hit = what != GIVE
        done = np.unique(at[hit & (what == SURE) & same & (hi - lo >= window)])
        spans = np.stack(ws.around(done, window, block), axis=1).astype("<u4") if len(done) else np.zeros((0, 2), "<u4")
        if len(done):
            yield pa.RecordBatch.from_arrays([pa.array([h.name % count], pa.int32()), pa.array([SPANS], pa.int32()), pa.array([h.name]), pa.array([spans.tobytes()], pa.binary()), *(pa.nulls(1, pa.binary()) for _ in range(3))], names=["bucket", "kind", "slice", "c0", "c1", "c2", "c3"])
        for kind, places in ((INDEX, np.unique(at[~hit])), (PROBE, np.setdiff1d(at[hit], done))):
            if not len(places):
                continue
            lo, hi = ws.around(places, window, block)
            n = np.maximum(np.minimum(hi - window, places) - lo + 1, 0)
            begin = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            begin = np.unique(begin)
            if kind == PROBE and len(spans):
                inside = np.zeros(len(ws.total) + 1, dtype=np.int64)
                np.add.at(inside, spans[:, 0].astype(np.int64), 1)
                np.add.at(inside, np.maximum(spans[:, 1].astype(np.int64) - window + 1, 0), -1)
                begin = begin[np.cumsum(inside)[begin] <= 0]
            if not len(begin):
                continue
            key, check, ids = ws.run(begin, begin + window), ws.check(begin, begin + window), h.ids[ws.words.doc[begin]]
            if kind == INDEX:
                first = least_of(ids, check, key)
                key, check, ids, begin = key[first], check[first], ids[first], begin[first]
            yield dealt(h.name, key % np.uint64(count), count, [key, ids, begin.astype(np.uint32), check], kind)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return probed(batches, lambda rows: WindowIndex(rows, window))

    spans = cut(map_arrow(by_bucket(with_answers(slices, found, extend, dealt_schema(4)), count), settle, answers_schema(1)), "windows")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<int>, kept string"

    def finish(h: Held, right: pa.Table) -> Iterator[pa.RecordBatch]:
        ws = WordSlice(h, powers_())
        n = len(ws.words.hash)
        pairs = column(right, "c0", "<u4").reshape(-1, 2).astype(np.int64)
        change = np.bincount(pairs[:, 0], minlength=n + 1) - np.bincount(pairs[:, 1], minlength=n + 1)
        gone = np.cumsum(change)[:n] > 0
        # One space after every kept word, and then none at the end.
        size = (ws.words.end - ws.words.start + 1) * ~gone
        to = np.cumsum(size) - size
        flat = np.full(int(size.sum()), 0x20, dtype=np.uint8)
        keep = np.flatnonzero(~gone)
        length = (ws.words.end - ws.words.start)[keep]
        step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        flat[np.repeat(to[keep], length) + step] = h.text.data[np.repeat(ws.words.start[keep], length) + step]
        upto = np.concatenate([to, [len(flat)]])
        rows = []
        for i, (a, b) in enumerate(zip(ws.begin, ws.end)):
            kept = flat[upto[a] : max(upto[a], upto[b] - 1)].tobytes()
            mine = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
            rows.append((int(h.ids[i]) if h.known[i] else None, int(b - a), int(mine.sum()), hashlib.sha256(kept).hexdigest(), edges.tolist(), kept.decode("utf-8", "replace") if keep_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"])

    out = with_answers(slices, spans, finish, schema)
    return out if keep_text else out.drop("kept")
