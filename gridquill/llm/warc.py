"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

The file layout is that of the public WARC-Zstandard convention: a skippable
frame with magic number 0x184D2A5D holds the dictionary, plain or as a frame of
its own; every record after it is one frame, so a record can be decoded alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, filesystem, map_arrow, shared_dir

#: Fixed values of the Zstandard format and of the WARC-Zstandard convention.
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICT_MAGIC = b"\x5d\x2a\x4d\x18"

#: Compressed bytes after which a writer closes a shard and starts the next.
SHARD_BYTES = 32 << 20
#: A shard's dictionary is trained on its first records only.
DICT_BYTES, DICT_RECORDS, DICT_SAMPLE_BYTES = 32 << 10, 256, 4 << 20
DATE = "2024-01-01T00:00:00Z"
ID_PREFIX = "urn:page:"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def digest(raw: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def clean(value: str) -> str:
    """A header value on one line: control characters as their percent codes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or with refers_to a revisit record, whose block keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{ID_PREFIX}{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if url is not None:
        head["WARC-Target-URI"] = clean(url)
    if refers_to is not None:
        head["WARC-Refers-To"] = f"<{ID_PREFIX}{refers_to}>"
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> Record:
    """The headers and block of one record; ValueError unless version, headers, length and digests are right."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("a record without an end of its headers")
    first, *lines = raw[:end].decode("utf-8").split("\r\n")
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC version: {first[:40]}")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"not a header: {line[:40]}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"a record without {name}")
    if not headers["content-length"].isdecimal():
        raise ValueError("Content-Length is no number")
    size = int(headers["content-length"])
    block = raw[end + 4 : end + 4 + size]
    if len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("Content-Length disagrees with the record")
    if (want := headers.get("warc-block-digest")) and want != f"sha1:{digest(block)}":
        raise ValueError("the block digest disagrees")
    return Record(headers, block)


def frame_size(raw: bytes | memoryview, at: int) -> int:
    """Bytes of the Zstandard frame that begins at a place, by its block headers."""
    if raw[at : at + 4] != FRAME_MAGIC:
        raise ValueError("no Zstandard frame here")
    flags = raw[at + 4]
    single = flags >> 5 & 1
    sizes = (1 if single else 0, 2, 4, 8)
    i = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + sizes[flags >> 6]
    while True:
        head = int.from_bytes(raw[i : i + 3], "little")
        if i + 3 > len(raw):
            raise ValueError("a frame that is cut off")
        i += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    i += 4 * (flags >> 2 & 1)
    if i > len(raw):
        raise ValueError("a frame that is cut off")
    return i - at


def read_archive(raw: bytes | memoryview) -> Iterator[Record]:
    """The records of an archive, one frame decoded at a time."""
    at, loaded = 0, None
    if raw[:4] == DICT_MAGIC:
        size = int.from_bytes(raw[4:8], "little")
        content = bytes(raw[8 : 8 + size])
        if len(content) != size:
            raise ValueError("a dictionary that is cut off")
        if content[:4] == FRAME_MAGIC:
            content = zstandard.ZstdDecompressor().decompress(content)
        loaded, at = zstandard.ZstdCompressionDict(content), 8 + size
    unpack = zstandard.ZstdDecompressor(dict_data=loaded) if loaded else zstandard.ZstdDecompressor()
    while at < len(raw):
        if raw[at] & 0xF0 == 0x50 and raw[at + 1 : at + 4] == b"\x2a\x4d\x18":
            at += 8 + int.from_bytes(raw[at + 4 : at + 8], "little")
            continue
        size = frame_size(raw, at)
        yield parse_record(unpack.decompress(bytes(raw[at : at + size])))
        at += size


def train(sample: list[bytes]) -> bytes:
    """A dictionary for records like these; of too few, the start of the first serves as it is."""
    held = sum(map(len, sample))
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, held // 8)), sample).as_bytes()
    except zstandard.ZstdError:
        return sample[0][:1024]


class ArchiveWriter:
    """Writes one archive as its records come; only the first ones are held, to train the dictionary on."""

    def __init__(self, sink: BinaryIO) -> None:
        self.sink, self.waiting, self.held = sink, [], 0
        self.squeeze: zstandard.ZstdCompressor | None = None
        self.records = self.bytes = 0

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.bytes += len(raw)

    def _begin(self) -> None:
        content = train([r[: 64 << 10] for r in self.waiting])
        packed = zstandard.ZstdCompressor(level=3).compress(content)
        self.squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=True, write_checksum=True)
        self._put(DICT_MAGIC + len(packed).to_bytes(4, "little") + packed)
        for r in self.waiting:
            self._put(self.squeeze.compress(r))
        self.waiting = []

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.squeeze:
            self._put(self.squeeze.compress(record))
            return
        self.waiting.append(record)
        self.held += len(record)
        if len(self.waiting) >= DICT_RECORDS or self.held >= DICT_SAMPLE_BYTES:
            self._begin()

    def end(self) -> None:
        if self.waiting:
            self._begin()


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_payload: int) -> DataFrame:
    """(page_id, url, payload, refers_to): of pages with equal payloads of min_payload bytes or more,
    all but that with the largest id refer to it.  Only (digest, largest id) goes through the shuffle
    of the aggregate, one row per digest and task.  It is made by the reversed digest, so the join on the digest has an
    exchange on both sides and Spark splits the payloads' side where a payload that many pages share makes it skewed."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload")
    ).withColumn("key", F.sha1("payload"))
    heads = rows.where(F.length("payload") >= min_payload).groupBy(F.reverse("key").alias("turned")).agg(F.max("page_id").alias("head"), F.count("*").alias("copies")).where((F.col("copies") > 1) & F.col("head").isNotNull())
    found = rows.join(heads.select(F.reverse("turned").alias("key"), "head"), "key", "left")
    own = F.col("head").isNull() | (F.col("head").eqNullSafe(F.col("page_id")))
    return found.select("page_id", "url", "payload", F.when(~own, F.col("head")).alias("refers_to"))


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Writes (page_id, url, payload, refers_to) into archives below folder; returns the manifest (shard, n_records, n_bytes)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        writer = name = None

        def close() -> pa.RecordBatch:
            writer.end()
            writer.sink.close()
            store.move(f"{path}/.{name}", f"{path}/{name}")
            return pa.RecordBatch.from_pydict({"shard": [name], "n_records": [writer.records], "n_bytes": [writer.bytes]})

        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(i) for i in range(4))):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(store.open_output_stream(f"{path}/.{name}", compression=None))
                writer.add(build_record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py()))
                if writer.bytes >= SHARD_BYTES:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return map_arrow(records.select("page_id", "url", "payload", "refers_to"), task, "shard string, n_records long, n_bytes long")


def page_number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix(f"<{ID_PREFIX}").removesuffix(">")
    return int(text) if text.lstrip("-").isdecimal() else None


def read_warc(spark, folder: str) -> DataFrame:
    """Every record below folder, headers, lengths and digests checked: shard, page_id, url, record_type,
    payload_bytes, payload_digest, refers_to, payload (null for revisits).  A damaged archive fails the job."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                held = 0
                for r in read_archive(memoryview(raw.as_buffer()).cast("B")):
                    http, _, payload = r.block.partition(b"\r\n\r\n")
                    fields = dict(x.lower().split(b": ", 1) for x in http.split(b"\r\n")[1:])
                    size, kind = int(fields[b"content-length"]), r.headers["warc-type"]
                    sha = r.headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or digest(payload) != sha):
                        raise ValueError("a payload disagrees with its length or digest")
                    rows.append((path.rsplit("/", 1)[1], page_number(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), kind, size, sha, page_number(r.headers.get("warc-refers-to")), payload if kind == "response" else None))
                    held += len(r.block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return map_arrow(files, task, "shard string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def warc_round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 0) -> DataFrame:
    """Archives every page and reads the archives back: the columns of read_warc.

    A null payload is empty, a null url is left out, a null id stays null and nothing refers to it;
    rows that repeat the largest id of their payload are responses; an empty table gives no rows."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    manifest = cut(write_warc(mark_revisits(pages, id_col, url_col, payload_col, min_payload), folder), "warc-manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "shard string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
    return read_warc(spark, folder).join(manifest.select("shard"), "shard", "left_semi")
