"""Token ids in wavelet-matrix shards.

A shard file holds the ids of a run of documents as segments.  Each segment is a
wavelet matrix: plane l has bit (top - l) of every id, after the ids were
partitioned stably by the bits before it.  The planes are succinct (bits per
id = bits of the vocabulary) and, with a directory of ones before every
512th bit, give access, rank (counting) and select (occurrence lookup) in a
number of steps that depends on the bits of an id only.

File: magic, zstd frame per segment, zstd frame of the document index, a JSON
directory, its length (8 bytes, little-endian), magic.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as T
from .common import cut, map_arrow, partitions, put_file, shared_dir, texts

MAGIC = b"GQWM0001"
#: Ids of a segment and of a file, at most, unless one document is longer than a file.
SEGMENT_IDS = 1 << 18
SHARD_IDS = 1 << 23
#: Words that a worker remembers with their ids; further ones are encoded each time they come.
CACHED_WORDS = 1 << 20
ENCODED_AT_ONCE = 10_000
RANK_BITS = 512
END_ID = 1


class WaveletMatrix:
    """Bit-planes over n ids below 2**bits."""

    def __init__(self, n: int, bits: int, planes: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.bits, self.planes, self.zeros = n, bits, planes, zeros
        self._ranks: np.ndarray | None = None

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        x = ids.astype(kind)
        planes = np.zeros((bits, (len(x) + 7) // 8), dtype=np.uint8)
        zeros = np.zeros(bits, dtype=np.int64)
        for level in range(bits):
            one = (x & kind(1 << (bits - 1 - level))) != 0
            planes[level] = np.packbits(one, bitorder="little")
            low = np.flatnonzero(~one)
            zeros[level] = len(low)
            x = np.concatenate([x.take(low), x.take(np.flatnonzero(one))])
        return cls(len(ids), bits, planes, zeros)

    def decode(self) -> np.ndarray:
        """All ids in order: the partitions are undone from the last plane to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        x = np.zeros(self.n, dtype=kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            low, high = np.flatnonzero(~one), np.flatnonzero(one)
            before = np.empty_like(x)
            before[low] = x[: len(low)]
            before[high] = x[len(low) :] | kind(1 << (self.bits - 1 - level))
            x = before
        return x

    def _directory(self) -> np.ndarray:
        """Ones before every RANK_BITS-th bit of each plane."""
        if self._ranks is None:
            step = RANK_BITS // 8
            width = -(-self.planes.shape[1] // step) * step
            padded = np.zeros((self.bits, width), dtype=np.uint8)
            padded[:, : self.planes.shape[1]] = self.planes
            per = np.bitwise_count(padded).reshape(self.bits, -1, step).sum(axis=2, dtype=np.int64)
            self._ranks = np.zeros((self.bits, per.shape[1] + 1), dtype=np.int64)
            np.cumsum(per, axis=1, out=self._ranks[:, 1:])
        return self._ranks

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // RANK_BITS
        at = block * (RANK_BITS // 8)
        count = int(self._directory()[level, block])
        whole = i // 8
        count += int(np.bitwise_count(self.planes[level, at:whole]).sum())
        if i % 8:
            count += int(self.planes[level, whole] & ((1 << (i % 8)) - 1)).bit_count()
        return count

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit = int(self.planes[level, i // 8]) >> (i % 8) & 1
            ones = self._ones(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if symbol >> (self.bits - 1 - level) & 1:
                lo, hi = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in [lo, hi)."""
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id; -1 if there are not so many."""
        a, b = self._range(symbol, 0, self.n)
        if k < 0 or a + k >= b:
            return -1
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            want_ones = bool(symbol >> (self.bits - 1 - level) & 1)
            k_th = i - int(self.zeros[level]) if want_ones else i
            i = self._place(level, k_th, want_ones)
        return i

    def _place(self, level: int, k: int, ones: bool) -> int:
        ranks = self._directory()[level]
        if not ones:
            ranks = np.arange(len(ranks), dtype=np.int64) * RANK_BITS - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        at = block * RANK_BITS
        piece = np.unpackbits(self.planes[level, at // 8 : at // 8 + RANK_BITS // 8], bitorder="little")
        hits = np.flatnonzero(piece == (1 if ones else 0))
        return at + int(hits[k - int(ranks[block])])

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.bits], dtype="<i8").tobytes() + self.zeros.astype("<i8").tobytes() + self.planes.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        n, bits = (int(x) for x in np.frombuffer(raw, dtype="<i8", count=2))
        zeros = np.frombuffer(raw, dtype="<i8", count=bits, offset=16)
        planes = np.frombuffer(raw, dtype=np.uint8, offset=16 + 8 * bits).reshape(bits, (n + 7) // 8)
        return cls(n, bits, planes, zeros)


def pack_shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """A shard file of documents that follow each other, with counts[i] ids each."""
    squeeze = zstandard.ZstdCompressor(level=1)
    out, segments, at = [MAGIC], [], len(MAGIC)
    for lo in range(0, len(ids), SEGMENT_IDS):
        part = ids[lo : lo + SEGMENT_IDS]
        frame = squeeze.compress(WaveletMatrix.build(part, bits).to_bytes())
        segments.append([at, len(frame), len(part)])
        out.append(frame)
        at += len(frame)
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    index = np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes() + np.asarray(counts, dtype="<i8").tobytes() + known.tobytes()
    frame = squeeze.compress(index)
    head = json.dumps({"docs": len(doc_ids), "ids": len(ids), "bits": bits, "segments": segments, "index": [at, len(frame)]}).encode()
    return b"".join([*out, frame, head, len(head).to_bytes(8, "little"), MAGIC])


class Shard:
    """Reads a shard file; raises ValueError if it is damaged."""

    def __init__(self, raw: bytes) -> None:
        if raw[: len(MAGIC)] != MAGIC or raw[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a whole wavelet shard")
        end = len(raw) - len(MAGIC) - 8
        size = int.from_bytes(raw[end : end + 8], "little")
        self.head = json.loads(raw[end - size : end])
        self.raw, self._unpack = raw, zstandard.ZstdDecompressor()
        at, size = self.head["index"]
        index, n = self._unpack.decompress(raw[at : at + size]), self.head["docs"]
        known = np.frombuffer(index, dtype=np.uint8, offset=16 * n)
        self.doc_ids = [int(x) if k else None for x, k in zip(np.frombuffer(index, dtype="<i8", count=n), known)]
        self.counts = np.frombuffer(index, dtype="<i8", count=n, offset=8 * n)
        if int(self.counts.sum()) != self.head["ids"] or sum(s[2] for s in self.head["segments"]) != self.head["ids"]:
            raise ValueError("a wavelet shard's counts disagree")

    def segments(self) -> Iterator[WaveletMatrix]:
        for at, size, n in self.head["segments"]:
            found = WaveletMatrix.from_bytes(self._unpack.decompress(self.raw[at : at + size]))
            if found.n != n:
                raise ValueError("a wavelet segment has another length than its entry")
            yield found

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in file order; decodes one segment at a time."""
        segments, have = self.segments(), np.zeros(0, dtype=np.uint32)
        for doc, n in zip(self.doc_ids, self.counts):
            parts, need = [], int(n)
            while need > len(have):
                parts.append(have)
                need -= len(have)
                have = next(segments).decode()
            parts.append(have[:need])
            have = have[need:]
            yield doc, np.concatenate(parts)

    def count(self, symbol: int) -> int:
        return sum(s.count(symbol) for s in self.segments())

    def access(self, i: int) -> int:
        for (_, _, n), s in zip(self.head["segments"], self.segments()):
            if i < n:
                return s.access(i)
            i -= n
        raise IndexError(i)

    def occurrences(self, symbol: int) -> Iterator[int]:
        base = 0
        for s in self.segments():
            yield from (base + s.select(symbol, k) for k in range(s.count(symbol)))
            base += s.n


class WordEncoder:
    """Ids of white-space separated words, encoded once and looked up by hash and length afterwards.

    The tokenizer lower-cases, drops white space and never joins what white space parts, so
    the ids of a text are those of its words in turn.  A text with the literal of a special token is encoded
    whole: the literal counts in its exact case, which the words' keys don't have."""

    def __init__(self, tokenizer_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.literals = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.bits = max(1, int(self.tokenizer.get_vocab_size() - 1).bit_length())
        self.kind = np.uint16 if self.bits <= 16 else np.uint32
        self.keys = np.zeros(0, dtype=np.uint64)
        self.refs = np.zeros((0, 2), dtype=np.int64)
        self.pool = np.array([END_ID], dtype=self.kind)
        self.powers = T.Powers()

    def with_literals(self, s: T.Slice) -> list[int]:
        """Texts of the slice that have a special token's literal."""
        raw, found = s.data.tobytes(), set()
        for literal in self.literals:
            at = raw.find(literal)
            while at >= 0:
                i = int(np.searchsorted(s.ends, at, side="right"))
                inside = at + len(literal) <= s.ends[i]
                if inside:
                    found.add(i)
                at = raw.find(literal, int(s.ends[i]) if inside else at + 1)
        return sorted(found)

    def encode(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids per text with the end id, all ids of the slice)."""
        special = self.with_literals(s)
        if not special:
            return self.encode_words(s)
        data = s.data.copy()
        for i in special:
            data[s.starts[i] : s.ends[i]] = 0x20
        counts, ids = self.encode_words(T.Slice(s.first, data, s.starts, s.ends))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in special:
            text = s.data[s.starts[i] : s.ends[i]].tobytes().decode("utf-8", "replace")
            parts[i] = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END_ID], dtype=self.kind)
            counts[i] = len(parts[i])
        return counts, np.concatenate(parts)

    def encode_words(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
        """As encode, of texts without special tokens."""
        w = T.words(s, T.WHITE, T.LOWER, self.powers)
        key = T.mix(w.hash + (w.end - w.start).astype(np.uint64))
        distinct, first, place = np.unique(key, return_index=True, return_inverse=True)
        refs = np.zeros((len(distinct), 2), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), dtype=bool)
        refs[known] = self.refs[at[known]]
        pool = self.pool
        if not known.all():
            new = np.flatnonzero(~known)
            strings = [s.data[w.start[i] : w.end[i]].tobytes().decode("utf-8", "replace") for i in first[new]]
            found = [x.ids for lo in range(0, len(strings), ENCODED_AT_ONCE) for x in self.tokenizer.encode_batch_fast(strings[lo : lo + ENCODED_AT_ONCE], add_special_tokens=False)]
            sizes = np.array([len(x) for x in found], dtype=np.int64)
            refs[new, 0] = len(pool) + np.cumsum(sizes) - sizes
            refs[new, 1] = sizes
            pool = np.concatenate([pool, np.array([i for x in found for i in x], dtype=self.kind)])
            if len(self.keys) + len(new) <= CACHED_WORDS:
                self.pool = pool
                keys = np.concatenate([self.keys, distinct[new]])
                order = np.argsort(keys, kind="stable")
                self.keys, self.refs = keys[order], np.concatenate([self.refs, refs[new]])[order]
        ref = refs[place.reshape(-1)]
        ref = np.insert(ref, np.cumsum(w.counts), [0, 1], axis=0)
        before = np.cumsum(ref[:, 1]) - ref[:, 1]
        total = int(ref[:, 1].sum())
        ids = pool[np.repeat(ref[:, 0] - before, ref[:, 1]) + np.arange(total)]
        ends = np.cumsum(w.counts + 1) - 1
        upto = before[ends] + 1
        return np.diff(upto, prepend=0), ids


@functools.cache
def word_encoder(tokenizer_path: str) -> WordEncoder:
    """One for a worker process: what a task has looked up serves the next."""
    return WordEncoder(tokenizer_path)


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, an end id after each, into wavelet shards below folder.

    Documents are range-partitioned and sorted by (id, text), so shards follow each other in
    ascending id; a null text is empty, a null id comes first, repeated ids stay apart.  Returns
    the manifest (shard, first_doc, part, n_docs, n_ids, n_bytes): a file it doesn't name, as a lost
    attempt may leave, counts for nothing."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made = word_encoder(tokenizer_path), 0
        docs_in: list[int | None] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal docs_in, counts, ids, made
            n, flat = np.concatenate(counts), np.concatenate(ids)
            name = f"{uuid.uuid4().hex}.wm"
            raw = pack_shard(docs_in, n, flat, encoder.bits)
            put_file(folder, name, raw)
            row = {"shard": [name], "first_doc": pa.array([docs_in[0]], pa.int64()), "part": pa.array([made], pa.int32()), "n_docs": [len(docs_in)], "n_ids": [len(flat)], "n_bytes": [len(raw)]}
            docs_in, counts, ids, made = [], [], [], made + 1
            return pa.RecordBatch.from_pydict(row)

        held = 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for s in T.slices(batch.column(1)):
                n, flat = encoder.encode(s)
                docs_in += doc_ids[s.first : s.first + len(n)]
                counts.append(n)
                ids.append(flat)
                held += len(flat)
                if held >= SHARD_IDS:
                    yield flush()
                    held = 0
        if docs_in:
            yield flush()

    rows = texts(docs, id_col, text_col)
    n = partitions(docs.sparkSession)
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return map_arrow(ordered, task, "shard string, first_doc long, part int, n_docs long, n_ids long, n_bytes long")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the listed shards: doc_id, start (ids in front of it), n_tokens, ids_crc32, shard."""
    spark = manifest.sparkSession

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(raw.as_py())
                found = [(d, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, x in shard.documents()]
                n = np.array([x[1] for x in found], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.rsplit("/", 1)[1]] * len(found)), pa.array([x[0] for x in found], pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array([x[2] for x in found], pa.int64())],
                    names=["shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("path", "content")
    found = map_arrow(files, task, "shard string, doc_id long, inside long, n_tokens long, ids_crc32 long")
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = manifest.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return found.join(offsets, "shard").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "shard")


def token_id_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and reads them back; see write_shards and read_shards.  An empty table gives no rows."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-shards")
    manifest = cut(write_shards(docs, tokenizer_path, folder, id_col, text_col), "token-manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")
    return read_shards(manifest, folder)
