"""Documents packed as slices, one row for a few megabytes of text, and what tasks send back to them.

A job that looks up every place of every text would drown in rows.  Here a row is a slice:
ids, text ends and compressed bytes of neighbouring documents, named by a hash of these.  Slices are written
once and read for each step, so every step sees the same ones whatever order the input's rows come in.  Tasks on
slices deal packed arrays out by bucket; answers come back by slice and meet it in a cogroup, which fails on an answer without a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .common import cut, map_arrow, partitions

SCHEMA = "slice long, n_bytes long, ids binary, known binary, ends binary, data binary"
#: Bytes of text for each bucket of what slices deal out, where that makes more buckets than the session has partitions.
BUCKET_BYTES = 64 << 20


class Held:
    """A slice with the ids of its documents; known is false where an id is null."""

    def __init__(self, name: int, ids: np.ndarray, known: np.ndarray, s: T.Slice) -> None:
        self.name, self.ids, self.known, self.text = name, ids, known, s


def slice_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as written slices; a null text is empty."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            numbers = ids.fill_null(0).to_numpy()
            for s in T.slices(batch.column(1)):
                k = len(s.starts)
                parts = [numbers[s.first : s.first + k].astype("<i8").tobytes(), known[s.first : s.first + k].tobytes(), s.ends.astype("<i8").tobytes(), s.data.tobytes()]
                name = xxhash.xxh3_64()
                for p in parts:
                    name.update(p)
                parts[3] = squeeze.compress(parts[3])
                numbered = [pa.array(np.array([name.intdigest()], dtype=np.uint64).view(np.int64)), pa.array([len(s.data)], pa.int64())]
                yield pa.RecordBatch.from_arrays([*numbered, *(pa.array([p], pa.binary()) for p in parts)], names=["slice", "n_bytes", "ids", "known", "ends", "data"])

    return cut(map_arrow(docs, task, SCHEMA), "slices")


def buckets(slices: DataFrame) -> int:
    """How many buckets to deal to: by the size of the text, and no fewer than the session's partitions."""
    total = slices.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return max(partitions(slices.sparkSession), -(-total // BUCKET_BYTES))


def held(table: pa.Table | pa.RecordBatch) -> Iterator[Held]:
    """The slices in rows of slice_rows."""
    unpack = zstandard.ZstdDecompressor()
    for i in range(table.num_rows):
        raw = [memoryview(table.column(c)[i].as_buffer()) for c in ("ids", "known", "ends")]
        raw.append(unpack.decompress(table.column("data")[i].as_buffer()))
        ids, known, ends = np.frombuffer(raw[0], "<i8"), np.frombuffer(raw[1], bool), np.frombuffer(raw[2], "<i8")
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        yield Held(table.column("slice")[i].as_py(), ids, known, T.Slice(0, np.frombuffer(raw[3], np.uint8), starts, ends))


def dealt(name: int, bucket: np.ndarray, count: int, arrays: list[np.ndarray], kind: int = 0) -> pa.RecordBatch | None:
    """A row (bucket, kind, slice, a binary column for each array) for each bucket that has entries."""
    if not len(bucket):
        return None
    order = np.argsort(bucket.astype(np.uint16 if count <= 1 << 16 else np.uint32), kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(count + 1))
    some = np.flatnonzero(np.diff(cuts))
    sorted_ = [np.ascontiguousarray(a[order]) for a in arrays]
    columns = [pa.array([a[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()) for a in sorted_]
    return pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), kind, dtype=np.int32)), pa.array(np.full(len(some), name, dtype=np.int64)), *columns],
        names=["bucket", "kind", "slice", *(f"c{i}" for i in range(len(arrays)))],
    )


def dealt_schema(arrays: int) -> str:
    return "bucket int, kind int, slice long" + "".join(f", c{i} binary" for i in range(arrays))


def by_bucket(packed: DataFrame, count: int) -> DataFrame:
    """Rows of dealt to count buckets, each bucket in one task and together."""
    return packed.repartition(count, "bucket").sortWithinPartitions("bucket", "kind")


def answers(name: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch | None:
    """Entries by slice: a row (slice, a binary column for each array) for each slice."""
    if not len(name):
        return None
    order = np.argsort(name, kind="stable")
    found, first = np.unique(name[order], return_index=True)
    cuts = [*first, len(name)]
    sorted_ = [np.ascontiguousarray(a[order]) for a in arrays]
    columns = [pa.array([a[cuts[i] : cuts[i + 1]].tobytes() for i in range(len(found))], pa.binary()) for a in sorted_]
    return pa.RecordBatch.from_arrays([pa.array(found), *columns], names=["slice", *(f"c{i}" for i in range(len(arrays)))])


def answers_schema(arrays: int) -> str:
    return "slice long" + "".join(f", c{i} binary" for i in range(arrays))


def column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    """All entries of a packed column, end to end."""
    parts = [np.frombuffer(x.as_buffer(), dtype=kind) for x in table.column(name)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def entry_counts(table: pa.Table, name: str, width: int) -> np.ndarray:
    return np.array([len(x.as_buffer()) // width for x in table.column(name)], dtype=np.int64)


def with_answers(slices: DataFrame, replies: DataFrame, task: Callable[[Held, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Gives every slice, with all answers to it, to task; answers to no slice fail the job."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows and not left.num_rows:
            raise ValueError("answers to a slice that is not there")
        out = [batch for h in held(left) for batch in task(h, right) if batch is not None]
        return pa.Table.from_batches(out) if out else empty.empty_table()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema))
    return slices.groupBy("slice").cogroup(replies.groupBy("slice")).applyInArrow(both, schema)
