"""Removal of repeated substrings by the common-prefix interval trees of cut-out suffix arrays.

A suffix array of a whole corpus would be one giant sort.  It is cut where it can be cut without loss: among the
hashes of the ANCHOR-byte grams of every window of `length` bytes the least is its anchor (the leftmost
of equals), so equal windows have equal anchors at equal offsets.  Occurrences of an anchor
elsewhere are found by hash; each different surrounding of it then takes along the bytes that windows around it can reach.
Their suffixes, sorted, make an enhanced suffix array per anchor, in which surroundings that come several times are
leaves of weight two: they stand twice.  A stack scan over the common-prefix lengths gives the interval tree, whose every node is
a repeat that ends alike in all its occurrences.  A node's occurrences, sorted by what stands before them, make
such a tree again, whose nodes have different left extensions; of these a maximal repeat group is what does not lie in one child of
the first node.  Every group that reaches the length is put out with all its occurrences, copies of a leaf too.

No anchor makes a large group.  Surroundings that repeat within a slice of some megabytes leave it once.
An anchor with more than HOT different surroundings, as a short passage that very many texts share has, is lengthened to
whole windows: an anchor of `length` bytes has a tree of one node, so its occurrences are the group.  These are told by two
64-bit hashes and leave a slice once each, which spreads them over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .common import cut, map_arrow, merged, texts
from .slicerows import Held, answers, buckets, by_bucket, column, dealt, dealt_schema, entry_counts, held, slice_rows, with_answers

ANCHOR = 64
#: Windows whose least gram is looked for at once: places in them fit 24 bits.
STRETCH = 8 << 20
#: What a slice does with an anchor: settle it whole, show its surroundings (as a leaf of weight two), show its windows.
WHOLE, OPEN, WEIGHTED, WINDOWS = 0, 1, 2, 3
#: Different surroundings of an anchor up to which they are sorted together.
HOT = 1024
#: Marks a place that stands for several of its slice; places themselves need 31 bits.
SEVERAL = np.uint32(1 << 31)
#: Kinds of rows between the steps: entries of anchors, surroundings, copies of surroundings elsewhere and in the same slice, settled spans, windows.
ENTRY, AROUND, COPY, ALIAS, SETTLED, WINDOW, SHOW = range(7)
#: Stands for the anchor of a span that belongs to none.
NO_ANCHOR = np.uint32(0xFFFFFFFF)
FOUND = "slice long, kind int, bucket int, c0 binary, c1 binary, c2 binary, c3 binary"
#: Codes for a second hash.
OTHER_CODES = T.mix(T.BYTE_CODES) | np.uint64(1)


class Grams:
    """Hashes of any stretch of a slice's bytes."""

    def __init__(self, data: np.ndarray, pow_: T.Powers, codes: np.ndarray = T.BYTE_CODES) -> None:
        up, self.down = pow_.to(len(data) + 1)
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(codes[data] * up[: len(data)], out=self.total[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return T.mix((self.total[hi] - self.total[lo]) * self.down[lo])

    def all(self, size: int) -> np.ndarray:
        n = len(self.total) - size
        return T.mix((self.total[size:] - self.total[:-size]) * self.down[:n])


def anchors(s: T.Slice, length: int, gram: int, grams: Grams) -> np.ndarray:
    """Places of the anchors of all windows of a slice that lie within one text."""
    n = len(s.data)
    if n < length:
        return np.zeros(0, dtype=np.int64)
    whole, width, found = grams.all(gram), length - gram + 1, []
    last = np.repeat(s.ends - length, s.ends - s.starts)  # the last place in its text where a window begins
    for lo in range(0, n - length + 1, STRETCH):
        hi = min(lo + STRETCH, n - length + 1)
        h = whole[lo : hi + width - 1]
        least = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64) + lo
        at = at[np.arange(lo, hi) <= last[lo:hi]]
        if len(at):
            found.append(at[np.concatenate([[True], at[1:] != at[:-1]])])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


def reach(s: T.Slice, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows that an anchor can be in begin and end, within its text."""
    doc = np.searchsorted(s.ends, at, side="right")
    return np.maximum(at - (length - gram), s.starts[doc]), np.minimum(at + length, s.ends[doc])


def common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Leading bytes that rows of a and b share, at most `most`."""
    if not a.shape[1]:
        return np.zeros(len(a), dtype=np.int64)
    unlike = a != b
    first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), a.shape[1])
    return np.minimum(first, most)


def prefix_intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the nodes of the common-prefix interval tree over suffixes 0..len(lcp),
    lcp[i] being what suffixes i and i + 1 share; a stack scan from left to right."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > value:
            size, first = stack.pop()
            yield size, first, i
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def by_content(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The order of zero-padded rows of bytes; of rows alike but for zeros a shorter one comes first, so an end sorts before any byte."""
    if not rows.shape[1]:
        return np.argsort(sizes, kind="stable")
    order = np.argsort(sizes, kind="stable")
    return order[np.argsort(np.ascontiguousarray(rows[order]).view(f"S{rows.shape[1]}").ravel(), kind="stable")]


def repeat_groups(right: np.ndarray, r_len: np.ndarray, left: np.ndarray, l_len: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(members, bytes before, bytes after) of the maximal repeats of one anchor that have `length` bytes or more: right holds
    the bytes from the anchor on, left those before it, nearest first; the members are sorted by right."""
    lcp = common(right[:-1], right[1:], np.minimum(r_len[:-1], r_len[1:]))
    for size, first, last in prefix_intervals(lcp, gram):
        need = max(length - size, 0)
        part = np.arange(first, last + 1)
        if len(part) > 2:
            part = part[by_content(left[part], l_len[part])]
        shared = common(left[part[:-1]], left[part[1:]], np.minimum(l_len[part[:-1]], l_len[part[1:]]))
        if shared.max() < need:
            continue
        for before, a, b in prefix_intervals(shared, need):
            members = part[a : b + 1]
            if lcp[members.min() : members.max()].min() == size:  # else they lie in one child and repeat further to the right
                yield members, before, size


def once(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, which places of it are the first of equal keys, how many equals each place has), keys from the last on."""
    order = np.lexsort(keys)
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    kind = np.cumsum(new) - 1
    return order, new, np.bincount(kind)[kind] if len(order) else np.zeros(0, dtype=np.int64)


def packed(name: int, kind: int, bucket: int, arrays: list[np.ndarray], width: int) -> pa.RecordBatch:
    """One row (bucket, kind, slice, c0..) as dealt makes them, with nulls up to width columns."""
    cells = [pa.array([a.tobytes()], pa.binary()) for a in arrays] + [pa.array([None], pa.binary())] * (width - len(arrays))
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([name], pa.int64()), *cells], names=["bucket", "kind", "slice", *(f"c{i}" for i in range(width))])


def spread(rows: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """rows of dealt with nulls up to width columns."""
    have = rows.num_columns - 3
    return pa.RecordBatch.from_arrays([*rows.columns, *(pa.nulls(rows.num_rows, pa.binary()) for _ in range(width - have))], names=[*rows.schema.names, *(f"c{i}" for i in range(have, width))])


def by_slice(kind: int, rows: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
    """answers as rows of FOUND."""
    if rows is not None:
        n, cells = rows.num_rows, rows.columns[1:]
        cells += [pa.nulls(n, pa.binary())] * (4 - len(cells))
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.int32()), *cells], names=["slice", "kind", "bucket", "c0", "c1", "c2", "c3"])


def first_of_equals(*keys: np.ndarray) -> np.ndarray:
    """For each place the first place with equal keys."""
    order, new, _ = once(*keys)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the spans (rows lo, hi) cover."""
    change = np.bincount(spans[:, 0], minlength=n + 1) - np.bincount(spans[:, 1], minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def anchor_rows(slices: DataFrame, length: int, gram: int, count: int) -> DataFrame:
    """FOUND: what each slice is to do with its anchors, the copies of surroundings by bucket, and those within a slice."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pow_ = T.Powers()
        for batch in batches:
            for h in held(batch):
                grams = Grams(h.text.data, pow_)
                at = anchors(h.text, length, gram, grams)
                lo, hi = reach(h.text, at, length, gram)
                key, around = grams.of(at, at + gram), surroundings(grams, at, lo, hi)
                order, new, copies = once(around, key)
                at, key, around = at[order], key[order], around[order]
                rest = ~new  # their whole surroundings repeat in this slice
                if rest.any():
                    first = at[new][np.cumsum(new) - 1]
                    yield packed(h.name, ALIAS, h.name % count, [at[rest].astype("<u4"), first[rest].astype("<u4")], 3)
                place = at.astype(np.uint32) | np.where(copies > 1, SEVERAL, np.uint32(0))
                out = dealt(h.name, (key[new] >> np.uint64(40)) % np.uint64(count), count, [key[new], around[new], place[new]], ENTRY)
                if out is not None:
                    yield out

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in merged(batches, "bucket"):
            kinds_of = table.column("kind").to_numpy()
            alias = table.filter(pa.array(kinds_of == ALIAS))
            for row in alias.select(["slice", "c0", "c1"]).to_batches():
                yield from by_slice(ALIAS, row)
            table = table.filter(pa.array(kinds_of == ENTRY))
            if not table.num_rows:
                continue
            key, around, at = column(table, "c0", "<u8"), column(table, "c1", "<u8"), column(table, "c2", "<u4")
            name = np.repeat(table.column("slice").to_numpy(), entry_counts(table, "c0", 8))
            bucket = np.repeat(table.column("bucket").to_numpy(), entry_counts(table, "c0", 8))
            order = np.lexsort((around, key))
            key, around, at, name, bucket = key[order], around[order], at[order], name[order], bucket[order]
            several, at = (at & SEVERAL) != 0, at & ~SEVERAL
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            new = new_key | np.concatenate([[True], around[1:] != around[:-1]])
            group, kind = np.cumsum(new_key) - 1, np.cumsum(new) - 1
            again = np.bincount(kind, 1 + several)[kind] > 1
            kinds = np.bincount(group, new)[group]
            hot = kinds > HOT
            # The first of equal surroundings is the leaf; surroundings that come once show windows where the anchor is hot.
            leaf, whole = new & ~hot & ((kinds > 1) | again), hot & again
            shown = np.concatenate([np.flatnonzero(leaf), np.flatnonzero(whole), np.flatnonzero(hot & new)])
            what = np.concatenate([np.where(again[leaf], WEIGHTED, OPEN), np.full(int(whole.sum()), WHOLE), np.full(int((hot & new).sum()), WINDOWS)]).astype(np.uint8)
            yield from by_slice(SHOW, answers(name[shown], [at[shown], what]))
            copy = np.flatnonzero(~new & ~hot)
            for b in np.unique(bucket[copy]):
                mine = copy[bucket[copy] == b]
                cells = [key[mine], around[mine], at[mine].astype("<u4"), name[mine].astype("<i8")]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([COPY], pa.int32()), pa.array([b], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], names=["slice", "kind", "bucket", "c0", "c1", "c2", "c3"])

    return cut(map_arrow(by_bucket(map_arrow(slices, find, dealt_schema(3)), count), match, FOUND), "anchors")


def surroundings(grams: Grams, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of what surrounds anchors, and of where they lie in it."""
    return T.mix(grams.of(lo, hi) ^ T.mix((at - lo).astype(np.uint64) * np.uint64(1 << 32) + (hi - at).astype(np.uint64)))


def shown_rows(slices: DataFrame, found: DataFrame, length: int, gram: int, count: int) -> DataFrame:
    """Rows for scan_rows: surroundings, windows, settled spans, and the copies that found has."""
    before = length - gram
    cache: dict[str, T.Powers] = {}

    def windows_of(h: Held, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, pow_: T.Powers) -> Iterator[pa.RecordBatch]:
        n = np.maximum(np.minimum(at, hi - length) - lo + 1, 0)
        begin = np.unique(np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        if not len(begin):
            return
        key, other = Grams(h.text.data, pow_).of(begin, begin + length), Grams(h.text.data, pow_, OTHER_CODES).of(begin, begin + length)
        order, new, copies = once(other, key)
        begin, key, other = begin[order], key[order], other[order]
        again = begin[copies > 1]
        if len(again):
            yield packed(h.name, SETTLED, h.name % count, [spans_of(np.full(len(again), NO_ANCHOR), again, again + length)], 6)
        place = begin.astype(np.uint32) | np.where(copies > 1, SEVERAL, np.uint32(0))
        yield spread(dealt(h.name, (key[new] >> np.uint64(40)) % np.uint64(count), count, [key[new], other[new], place[new]], WINDOW), 6)

    def show(h: Held, right: pa.Table) -> Iterator[pa.RecordBatch]:
        pow_ = cache.setdefault("", T.Powers())
        at, what = column(right, "c0", "<u4").astype(np.int64), column(right, "c1", "u1")
        lo, hi = reach(h.text, at, length, gram)
        sure = what == WHOLE
        if sure.any():
            yield packed(h.name, SETTLED, h.name % count, [spans_of(at[sure], lo[sure], hi[sure])], 6)
        wide = what == WINDOWS
        if wide.any():
            yield from windows_of(h, at[wide], lo[wide], hi[wide], pow_)
        tree = (what == OPEN) | (what == WEIGHTED)
        at, lo, hi, what = at[tree], lo[tree], hi[tree], what[tree]
        if len(at):
            data = np.concatenate([np.zeros(before, np.uint8), h.text.data, np.zeros(length, np.uint8)])
            after = data[(at + before)[:, None] + np.arange(length)]
            ahead = data[(at + before)[:, None] - 1 - np.arange(before)] if before else np.zeros((len(at), 0), np.uint8)
            after[np.arange(length) >= (hi - at)[:, None]] = 0
            ahead[np.arange(before) >= (at - lo)[:, None]] = 0
            grams = Grams(h.text.data, pow_)
            key = grams.of(at, at + gram)
            place = at.astype(np.uint32) | np.where(what == WEIGHTED, SEVERAL, np.uint32(0))
            sizes = np.stack([at - lo, hi - at], axis=1).astype("<u4")
            yield dealt(h.name, (key >> np.uint64(40)) % np.uint64(count), count, [key, surroundings(grams, at, lo, hi), place, sizes, ahead, after], AROUND)

    shown = with_answers(slices, found.where(F.col("kind") == SHOW).select("slice", "c0", "c1"), show, dealt_schema(6))
    none = F.lit(None).cast("binary")
    copies = found.where(F.col("kind") == COPY).select("bucket", "kind", F.lit(0).cast("long").alias("slice"), "c0", "c1", "c2", "c3", none.alias("c4"), none.alias("c5"))
    return shown.unionByName(copies)


def spans_of(place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rows (anchor, begin, end)."""
    return np.stack([place, lo, hi], axis=1).astype("<u4")


def trees_of(mine: pa.Table, length: int, gram: int) -> Iterator[tuple[dict[str, np.ndarray], Iterator[tuple[np.ndarray, int, int]]]]:
    """For each anchor its leaves in the order of the suffix array, and its maximal repeat groups as (leaves, bytes before, bytes after)."""
    sizes = column(mine, "c3", "<u4").reshape(-1, 2).astype(np.int64)
    place = column(mine, "c2", "<u4")
    leaves = {"key": column(mine, "c0", "<u8"), "around": column(mine, "c1", "<u8"), "at": (place & ~SEVERAL).astype(np.int64), "name": np.repeat(mine.column("slice").to_numpy(), entry_counts(mine, "c0", 8)), "l_len": sizes[:, 0], "r_len": sizes[:, 1]}
    left, right = column(mine, "c4", "u1").reshape(len(place), length - gram), column(mine, "c5", "u1").reshape(len(place), length)
    order = by_content(right, leaves["r_len"])
    order = order[np.argsort(leaves["key"][order], kind="stable")]
    order = np.repeat(order, 1 + ((place[order] & SEVERAL) != 0))  # a leaf of weight two stands twice
    leaves = {k: v[order] for k, v in leaves.items()}
    cuts = np.concatenate([[0], np.flatnonzero(leaves["key"][1:] != leaves["key"][:-1]) + 1, [len(order)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a > 1:
            part = order[a:b]
            yield {k: v[a:b] for k, v in leaves.items()}, repeat_groups(right[part], leaves["r_len"][a:b], left[part], leaves["l_len"][a:b], length, gram)


def scan_rows(shown: DataFrame, length: int, gram: int, count: int) -> DataFrame:
    """(slice, c0): spans (anchor, begin, end) that the groups of the trees and of the windows cover, around each anchor the widest."""

    def copies_of(leaf: dict[str, np.ndarray], copy: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(slice, place, bytes before, bytes after) of the copies of leaves."""
        key, around = column(copy, "c0", "<u8"), column(copy, "c1", "<u8")
        n = len(leaf["key"])
        first = first_of_equals(np.concatenate([leaf["around"], around]), np.concatenate([leaf["key"], key]))[n:]
        if len(first) and first.max() >= n:
            raise ValueError("copies of surroundings that are not there")
        return column(copy, "c3", "<i8"), column(copy, "c2", "<u4").astype(np.int64), leaf["l"][first], leaf["r"][first]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in merged(batches, "bucket"):
            kinds = table.column("kind").to_numpy()
            sure = table.filter(pa.array(kinds == SETTLED))
            yield from sure.select(["slice", "c0"]).to_batches()
            wide = table.filter(pa.array(kinds == WINDOW))
            if wide.num_rows:
                key, other, at = column(wide, "c0", "<u8"), column(wide, "c1", "<u8"), column(wide, "c2", "<u4")
                name = np.repeat(wide.column("slice").to_numpy(), entry_counts(wide, "c0", 8))
                first = first_of_equals(other, key)
                twice = np.bincount(first, 1 + ((at & SEVERAL) != 0), len(first))[first] > 1
                begin = (at & ~SEVERAL)[twice].astype(np.int64)
                if len(begin):
                    yield answers(name[twice], [spans_of(np.full(len(begin), NO_ANCHOR), begin, begin + length)])
            mine = table.filter(pa.array(kinds == AROUND))
            if not mine.num_rows:
                continue
            done: list[dict[str, np.ndarray]] = []
            for leaf, groups in trees_of(mine, length, gram):
                leaf["l"], leaf["r"] = np.full(len(leaf["at"]), -1), np.zeros(len(leaf["at"]), dtype=np.int64)
                for members, l_, r_ in groups:
                    leaf["l"][members] = np.maximum(leaf["l"][members], l_)
                    leaf["r"][members] = np.maximum(leaf["r"][members], r_)
                if (leaf["l"] >= 0).any():
                    done.append({k: v[leaf["l"] >= 0] for k, v in leaf.items()})
            if done:
                leaf = {k: np.concatenate([d[k] for d in done]) for k in done[0]}
                found = [(leaf["name"], leaf["at"], leaf["l"], leaf["r"]), copies_of(leaf, table.filter(pa.array(kinds == COPY)))]
                name, at, l_, r_ = (np.concatenate(c) for c in zip(*found))
                yield answers(name, [spans_of(at, at - l_, at + r_)])

    return cut(map_arrow(by_bucket(shown, count), scan, "slice long, c0 binary"), "spans")


def maximal_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The maximal repeat groups of `length` bytes or more with all occurrences of each: group, doc_id, begin and end in bytes.

    An occurrence is seen as far as windows of `length` bytes around its anchor reach, so a longer repeat
    makes a group for each of its anchors.  A group's name is a hash of its bytes.  Anchors with more than HOT surroundings give their
    repeated windows as groups.  Nulls, repeats and empty tables are as in remove_repeats."""
    gram = min(ANCHOR, length)
    slices = slice_rows(texts(docs, id_col, text_col))
    count = buckets(slices)
    found = anchor_rows(slices, length, gram, count)
    shown = cut(shown_rows(slices, found, length, gram, count), "surroundings")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in merged(batches, "bucket"):
            mine = table.filter(pa.array(table.column("kind").to_numpy() == AROUND))
            copy = table.filter(pa.array(table.column("kind").to_numpy() == COPY))
            key, around, where, name = column(copy, "c0", "<u8"), column(copy, "c1", "<u8"), column(copy, "c2", "<u4").astype(np.int64), column(copy, "c3", "<i8")
            for leaf, found_ in trees_of(mine, length, gram) if mine.num_rows else ():
                for members, l_, r_ in found_:
                    first = np.unique(first_of_equals(leaf["around"][members], leaf["name"][members], leaf["at"][members]))
                    at, who = leaf["at"][members][first], leaf["name"][members][first]
                    same = np.flatnonzero((key == leaf["key"][0]) & np.isin(around, leaf["around"][members]))
                    at, who = np.concatenate([at, where[same]]), np.concatenate([who, name[same]])
                    yield answers(who, [spans_of(at, at - l_, at + r_)])

    repeated = map_arrow(by_bucket(shown, count), groups, "slice long, c0 binary")
    settled_ = scan_rows(shown.where(F.col("kind").isin(SETTLED, WINDOW)), length, gram, count)
    aliases = found.where(F.col("kind") == ALIAS).select("slice", "c0", "c1")
    none = F.lit(None).cast("binary").alias("c1")
    replies = repeated.unionByName(settled_).select("slice", "c0", none).unionByName(aliases)
    cache: dict[str, T.Powers] = {}

    def name_groups(h: Held, right: pa.Table) -> Iterator[pa.RecordBatch]:
        spans = expanded(right)
        whole = np.flatnonzero(spans[:, 2] - spans[:, 1] >= length)
        spans = np.unique(spans[whole][:, 1:], axis=0)
        if len(spans):
            lo, hi = spans[:, 0], spans[:, 1]
            pow_ = cache.setdefault("", T.Powers())
            group = Grams(h.text.data, pow_).of(lo, hi) ^ T.mix((hi - lo).astype(np.uint64))
            doc = np.searchsorted(h.text.ends, lo, side="right")
            ids = pa.array(h.ids[doc], pa.int64(), mask=~h.known[doc])
            yield pa.RecordBatch.from_arrays([pa.array(group.view(np.int64)), ids, pa.array(lo - h.text.starts[doc]), pa.array(hi - h.text.starts[doc])], names=["group", "doc_id", "begin", "end"])

    return with_answers(slices, replies, name_groups, "group long, doc_id long, begin long, end long")


def expanded(right: pa.Table) -> np.ndarray:
    """The spans (anchor, begin, end) of a slice, with those of anchors that have the same surroundings as another one of the slice."""
    plain = np.array(right.column("c1").is_null().to_numpy(zero_copy_only=False), dtype=bool)
    spans = column(right.filter(pa.array(plain)), "c0", "<u4").reshape(-1, 3).astype(np.int64)
    alias = right.filter(pa.array(~plain))
    at, first = column(alias, "c0", "<u4").astype(np.int64), column(alias, "c1", "<u4").astype(np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    lo, hi = np.searchsorted(spans[:, 0], first), np.searchsorted(spans[:, 0], first, side="right")
    n = hi - lo
    row = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    shift = np.repeat(at - first, n)
    return np.concatenate([spans, np.stack([spans[row, 0] + shift, spans[row, 1] + shift, spans[row, 2] + shift], axis=1)])


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """Per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans, an array of the removed
    runs' begins and ends in bytes; with keep_bytes also kept, the remaining bytes.

    Removed is each byte that lies in a string of `length` bytes that starts at another place too, in the same
    text or another; NUL bytes are bytes like others.  A null text is empty; rows with a null or repeated id count as texts like others;
    an empty table gives no rows."""
    gram = min(ANCHOR, length)
    slices = slice_rows(texts(docs, id_col, text_col))
    count = buckets(slices)
    found = anchor_rows(slices, length, gram, count)
    spans = scan_rows(shown_rows(slices, found, length, gram, count), length, gram, count)
    aliases = found.where(F.col("kind") == ALIAS).select("slice", "c0", "c1")
    replies = spans.select("slice", "c0", F.lit(None).cast("binary").alias("c1")).unionByName(aliases)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>, kept binary"

    def finish(h: Held, right: pa.Table) -> Iterator[pa.RecordBatch]:
        s = h.text
        gone = covered(expanded(right)[:, 1:], len(s.data))
        rows = []
        for i, (a, b) in enumerate(zip(s.starts, s.ends)):
            mine = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
            kept = s.data[a:b][~mine].tobytes() if len(edges) else s.data[a:b].tobytes()
            rows.append((int(h.ids[i]) if h.known[i] else None, int(b - a), int(b - a) - len(kept), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges.tolist(), kept if keep_bytes else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    out = with_answers(slices, replies, finish, schema)
    return out if keep_bytes else out.drop("kept")
