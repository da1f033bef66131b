"""Vectorised scans over the UTF-8 buffers of Arrow string columns.

A text column arrives in a Python worker as one Arrow buffer holding all
texts end to end.  Word splitting, lower-casing of A-Z and hashing are table
lookups and cumulative sums over that buffer, so no Python object is made per
word.  Slices are cut at document boundaries and bounded in bytes, which
bounds the memory of a worker however large a batch is; a document longer than
the bound forms a slice alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice holds at most, unless one document is longer.
SLICE_BYTES = 2_000_000

_RNG = np.random.default_rng(20240229)
#: One random odd 64-bit value per byte value: the alphabet of the polynomial hashes.
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))

#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


class Slice(NamedTuple):
    """Texts first..first+len(starts)-1 of a column: their bytes and where each begins and ends."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class Words(NamedTuple):
    """Words of a slice in text order; doc counts from the slice's first text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    counts: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Bounded slices of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Slice(i, data[at[i] : at[j]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i])
        i = j


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    out = np.ones(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        done = 1
        step = base
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * step
            done += more
            step = step * step
    return out


class Powers:
    """Powers of the base and of its inverse, grown as longer slices come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(n), powers(n, _INVERSE)
        return self.up, self.down


def words(s: Slice, separators: np.ndarray, fold: np.ndarray, pow_: Powers) -> Words:
    """Maximal runs of bytes that are no separator, hashed after folding; none spans two texts."""
    n = len(s.data)
    docs = len(s.starts)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, none.astype(np.uint64), np.zeros(docs, dtype=np.int64))
    inside = ~separators[s.data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = s.starts[s.starts < n]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = s.ends[s.ends > s.starts] - 1
    last[edge] = inside[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = pow_.to(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODES[fold[s.data]] * up[:n], out=total[1:])
        h = mix((total[end] - total[start]) * down[start])
    doc = np.searchsorted(s.ends, start, side="right")
    return Words(start, end, doc, h, np.bincount(doc, minlength=docs))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive hashes, also across texts; the caller masks those."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out, width = None, 0
        part, size = h, 1
        left = n
        while left:
            if left & 1:
                m = len(h) - (width + size) + 1
                piece = part[:m] if out is None else out[:m] * powers_of(size) + part[width : width + m]
                out, width = piece, width + size
            left >>= 1
            if left:
                m = len(part) - size
                part = part[:m] * powers_of(size) + part[size : size + m]
                size *= 2
        return mix(out)


def powers_of(k: int) -> np.uint64:
    return np.uint64(pow(int(BASE), k, 2**64))
