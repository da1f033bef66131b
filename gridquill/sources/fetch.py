"""Bytes from HTTP addresses: bounded, from public hosts only, and many of them as a DataFrame whose failures are rows.

A redirect is followed by hand, three times at most, and each address is checked anew.  Bodies are read up to a cap, whatever
their headers say.  Raster sources are written to shared storage once, under their name only when they are whole.
"""

from __future__ import annotations

import ipaddress
import logging
import re
import socket
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridquill.functions import text as tx
from gridquill.sources import files, staging

#: Redirects that are followed, bytes of a document at most, seconds of waiting, bytes of a read.
REDIRECTS, MOST_BYTES, TIMEOUT_S, CHUNK = 3, 50 << 20, 60, 1 << 20
LOG = logging.getLogger(__name__)


class NotFetched(ValueError):
    """An address that is refused, doesn't answer, leads on too often or holds too much."""


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def require_public(url: str) -> None:
    """NotFetched unless the address is http(s) and all that its host's name stands for is public."""
    parts = urlparse(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise NotFetched(f"no http address: {url[:200]}")
    try:
        found = {info[4][0] for info in socket.getaddrinfo(parts.hostname, parts.port or (443 if parts.scheme == "https" else 80))}
    except OSError as e:
        raise NotFetched(f"unknown host {parts.hostname}: {e}") from None
    if any(not ipaddress.ip_address(a.split("%")[0]).is_global for a in found):
        raise NotFetched(f"{parts.hostname} is no public host")


def pieces(url: str, most: int | None = MOST_BYTES, check: Callable[[str], None] = require_public) -> Iterator[bytes]:
    """The body in pieces; NotFetched as soon as there is more than `most`."""
    opener = urllib.request.build_opener(_Stay)
    for _ in range(REDIRECTS + 1):
        check(url)
        try:
            reply = opener.open(url, timeout=TIMEOUT_S)
        except urllib.error.HTTPError as e:
            if e.code in (301, 302, 303, 307, 308) and e.headers.get("Location"):
                url = urljoin(url, e.headers["Location"])
                continue
            raise NotFetched(f"HTTP {e.code}") from None
        except (urllib.error.URLError, OSError, ValueError) as e:
            raise NotFetched(f"{url[:200]} can't be reached: {e}") from None
        with reply:
            size = 0
            try:
                while piece := reply.read(CHUNK):
                    size += len(piece)
                    if most is not None and size > most:
                        raise NotFetched(f"more than {most} bytes")
                    yield piece
            except OSError as e:
                raise NotFetched(f"{url[:200]} broke off: {e}") from None
            declared = reply.headers.get("Content-Length")
            if declared and declared.isdecimal() and size < int(declared):
                raise NotFetched(f"{url[:200]} broke off after {size} bytes")
        return
    raise NotFetched(f"more than {REDIRECTS} redirects")


def fetched(seeds: DataFrame, most: int = MOST_BYTES, check: Callable[[str], None] = require_public, tasks: int = 8) -> DataFrame:
    """seeds (url, ...) with content and error: each address is asked for once a row, in `tasks` tasks; what fails is logged, has an error
    and doesn't stop the others.  A task holds one body at a time."""
    names = seeds.columns
    schema = seeds.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                url = batch.column(names.index("url"))[i].as_py()
                content = error = None
                try:
                    content = b"".join(pieces(url or "", most, check))
                except NotFetched as e:
                    error = str(e)
                    LOG.warning("%s: %s", url, error)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], names=[*names, "content", "error"])

    return seeds.repartition(tasks).mapInArrow(task, f"{schema}, content binary, error string")


def documents_of(found: DataFrame) -> DataFrame:
    """Of fetched rows (url, content, error, ...): text and error as files.load_documents has them, by the ending of the address's path, and doc_id,
    the id of the text."""
    names = found.columns
    schema = found.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = dict(zip(names, (c[i].as_py() for c in batch.columns)))
                text, error = (None, row["error"]) if row["error"] else files.document_text(urlparse(row["url"]).path, row["content"])
                columns = [pa.array([error], pa.string()) if n == "error" else c for n, c in zip(names, batch.slice(i, 1).columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([text], pa.string())], names=[*names, "text"])

    return found.mapInArrow(task, f"{schema}, text string").withColumn("doc_id", tx.content_id(F.col("text")))


def ingest_list(seeds: DataFrame, root: str, most: int = MOST_BYTES, check: Callable[[str], None] = require_public) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text, url, ...), (url, error)) of a list of addresses: what could be read, equal texts once, and what could not, with the reason.

    Bodies are written below root/fetched once, so neither result asks again; those of documents are archived below root/archive."""
    spark = seeds.sparkSession
    raw = staging.staged(spark, f"{root}/fetched", lambda: fetched(seeds, most, check))
    read = staging.staged(spark, f"{root}/read", lambda: documents_of(raw))
    good = read.where("error is null").withColumn("__row", F.row_number().over(Window.partitionBy("doc_id").orderBy("url"))).where("__row = 1").drop("__row", "error")
    if not staging.exists(spark, f"{root}/archive"):
        staging.archive(good.select("doc_id", F.substring_index("url", "/", -1).alias("filename"), "content"), f"{root}/archive")
    return good.drop("content"), read.where("error is not null").select("url", "error")


def source_raster(root: str, layer: str, address: Callable[[str], str | None], check: Callable[[str], None] = require_public, most: int | None = None) -> str:
    """The path of a layer's source raster below root, fetched first if it isn't there.  address gives the layer's URL, by file name or stem.

    The file gets its name when it is whole, so a broken fetch leaves none, and of two that fetch it at once the last one's stays."""
    name = layer if layer.endswith(".tif") else f"{layer}.tif"
    if not re.fullmatch(staging.IDENTIFIER, name.removesuffix(".tif")):
        raise ValueError(f"no identifier: {layer!r}")
    store, folder = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
    path = f"{folder}/{name}"
    if store.get_file_info(path).type == fs.FileType.File:
        return f"{root}/{name}"
    url = address(name) or address(name.removesuffix(".tif"))
    if not url:
        raise ValueError(f"no address for {layer!r}")
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(part, compression=None) as out:
            for piece in pieces(url, most, check):
                out.write(piece)
        store.move(part, path)
    except BaseException:
        if store.get_file_info(part).type == fs.FileType.File:
            store.delete_file(part)
        raise
    return f"{root}/{name}"
