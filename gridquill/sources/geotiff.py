"""GeoTIFF rasters as tables of cells: spark.read.format("geotiff") and df.write.format("geotiff").

A raster is a file, or a folder of files on one grid, as the sink writes it.  The reader reads directories only while it
plans: a partition is some tiles (or strips) of a file, and of a file no other tile is read.  Windows come as options rows and
cols ("first:last") or, with the option push and spark.sql.python.filterPushdown.enabled, as filters on row and col; both leave
out files and tiles before anything is decoded.  Uncompressed, LZW and Deflate data with either predictor are decoded in numpy.

Options of reading: path, level (0, or the number of an overview), zeros (true: cells of 0 too), rows, cols, origin
("x0,y0", where row 0 and column 0 are; by default the files' upper left corner), push, partition_cells.
Options of writing: path, x0, y0, px, py, epsg, tile, block (cells of a tile's and a file's side), dtype, nodata, compression
(deflate, lzw, none).  Files and their metadata are opened with pyarrow, by the file system that the path's URI names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from gridquill.operators import raster
from gridquill.sources.tables import Grid

SCHEMA = "row int, col int, value double"
#: Cells that a partition decodes, about.
PARTITION_CELLS = 4_000_000
#: Bytes that the first read of a file takes; directories mostly lie within.
HEAD_BYTES = 1 << 16
#: Fixed values of the format: sizes and struct codes of field types, tags, kinds of compression.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS, PLANAR, PREDICTOR = 254, 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT, PIXEL_SCALE, TIEPOINT, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
COMPRESSIONS = {"none": NONE, "lzw": LZW, "deflate": DEFLATE}
GEOGRAPHIC_KEY, PROJECTED_KEY = 2048, 3072
KINDS = {1: "u", 2: "i", 3: "f"}
CLEAR, END, FIRST_ENTRY = 256, 257, 258


class Malformed(ValueError):
    """What is no TIFF, or one that this reader does not know."""


# LZW ------------------------------------------------------------------------------------------------------------------


def code_widths(n: int) -> np.ndarray:
    """Bits of the first n codes behind a clear code: one more whenever the table, which each code but the first lengthens, is one short of full."""
    size = FIRST_ENTRY + np.maximum(np.arange(n) - 1, -1) + 1
    return np.clip(np.ceil(np.log2(size + 1)).astype(np.int64), 9, 12)


#: Codes between two clear codes at most, and where in bits each begins.
MOST_CODES = 4096 - FIRST_ENTRY + 2
WIDTHS = code_widths(MOST_CODES)
STARTS = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])


def lzw_decode(raw: bytes, size: int) -> np.ndarray:
    """The first size bytes of an LZW stream.

    Behind a clear code the width of every code is known from its number alone, so all are cut out at once.  A code
    of the table is a copy of what the code that made it wrote, and one byte more, which is the next that was written: each
    output byte so has a source further left, and following sources in doubling steps ends at the literals."""
    data = np.frombuffer(raw + b"\0\0\0\0", dtype=np.uint8).astype(np.int64)
    out, at, done = [], 0, 0
    while done < size:
        begin = at + STARTS[at + STARTS + WIDTHS <= 8 * len(raw)]
        width = WIDTHS[: len(begin)]
        byte = begin >> 3
        word = (data[byte] << 16) | (data[byte + 1] << 8) | data[byte + 2]
        codes = (word >> (24 - (begin & 7) - width)) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(stop[0]) if len(stop) else len(codes)
        if n:
            part = _copied(codes[:n])
            out.append(part)
            done += len(part)
        if not len(stop) or codes[n] == END:
            break
        at = int(begin[n] + width[n])
    whole = np.concatenate(out) if out else np.zeros(0, dtype=np.uint8)
    if len(whole) < size:
        raise Malformed("an LZW stream ends early")
    return whole[:size]


def _copied(codes: np.ndarray) -> np.ndarray:
    n = len(codes)
    literal = codes < 256
    made = np.where(literal, np.arange(n), codes - FIRST_ENTRY)  # the number of the code that wrote what this one copies
    if (made[~literal] >= np.flatnonzero(~literal)).any():
        raise Malformed("an LZW code comes before its entry")
    length, jump = np.where(literal, 0, 1), made.copy()  # a copy is one longer than what it copies
    while True:
        further = length[jump]
        if not further.any():
            break
        length, jump = length + further, jump[jump]
    length = length + 1
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    total = int(length.sum())
    within = np.arange(total) - np.repeat(begin, length)
    source = np.repeat(np.where(literal, begin, begin[made]), length) + within
    while True:
        onward = source[source]
        if (onward == source).all():
            break
        source = onward
    value = np.zeros(total, dtype=np.uint8)
    value[begin[literal]] = codes[literal]
    return value[source]


def lzw_encode(raw: bytes) -> bytes:
    """An LZW stream that starts with a clear code and ends with an end code."""
    bits = n_bits = 0
    out = bytearray()
    table: dict[bytes, int] = {}
    width, held = 9, b""

    def put(code: int) -> None:
        nonlocal bits, n_bits
        bits, n_bits = (bits << width) | code, n_bits + width
        while n_bits >= 8:
            n_bits -= 8
            out.append((bits >> n_bits) & 255)
        bits &= (1 << n_bits) - 1

    def code_of(s: bytes) -> int:
        return s[0] if len(s) == 1 else table[s]

    put(CLEAR)
    for i in range(len(raw)):
        longer = held + raw[i : i + 1]
        if len(longer) == 1 or longer in table:
            held = longer
            continue
        put(code_of(held))
        table[longer] = FIRST_ENTRY + len(table)
        held = longer[-1:]
        size = FIRST_ENTRY + len(table)
        if size >= 4094:
            put(CLEAR)
            table.clear()
            width = 9
        elif size + 1 > 1 << width:
            width += 1
    if held:
        put(code_of(held))
        if FIRST_ENTRY + len(table) + 2 > 1 << width and width < 12:
            width += 1
    put(END)
    if n_bits:
        out.append((bits << (8 - n_bits)) & 255)
    return bytes(out)


# directories -----------------------------------------------------------------------------------------------------------


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class Tile(NamedTuple):
    """A tile of a level: its row and column among tiles, and where its bytes are."""

    row: int
    col: int
    offset: int
    size: int


@dataclass
class Level:
    """A raster as a directory of a file describes it: of full size, or an overview."""

    width: int
    height: int
    tile_width: int
    tile_height: int
    dtype: str
    compression: int
    predictor: int
    samples: int
    offsets: np.ndarray = field(repr=False)
    counts: np.ndarray = field(repr=False)
    x0: float = 0.0
    y0: float = 0.0
    px: float = 1.0
    py: float = 1.0
    epsg: int | None = None
    nodata: float | None = None
    overview: bool = False

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    def tiles(self, rows: tuple[int, int], cols: tuple[int, int]) -> list[Tile]:
        """Tiles that meet a window of the level's own cells and that the file holds; absent ones have no bytes."""
        r1, r2 = max(rows[0], 0) // self.tile_height, min(rows[1], self.height - 1) // self.tile_height
        c1, c2 = max(cols[0], 0) // self.tile_width, min(cols[1], self.width - 1) // self.tile_width
        out = []
        for r in range(r1, r2 + 1):
            for c in range(c1, c2 + 1):
                i = r * self.across + c
                if self.counts[i]:
                    out.append(Tile(r, c, int(self.offsets[i]), int(self.counts[i])))
        return out

    def decode(self, raw: bytes, tile: Tile) -> np.ndarray:
        """The tile's first band, without what hangs over the raster's edge."""
        height = self.tile_height
        dtype = np.dtype(self.dtype)
        if self.tile_width == self.width:  # the last strip may be shorter
            height = min(height, self.height - tile.row * height)
        size = height * self.tile_width * self.samples * dtype.itemsize
        if self.compression == NONE:
            flat = np.frombuffer(raw, dtype=np.uint8)
        elif self.compression == LZW:
            flat = lzw_decode(raw, size)
        elif self.compression in (DEFLATE, OLD_DEFLATE):
            flat = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
        else:
            raise Malformed(f"compression {self.compression} is not known")
        if len(flat) < size:
            raise Malformed("a tile has fewer bytes than cells")
        shape = (height, self.tile_width, self.samples)
        if self.predictor == 3:
            planes = np.add.accumulate(flat[:size].reshape(height, -1, self.samples), axis=1, dtype=np.uint8).reshape(height, dtype.itemsize, -1)
            cells = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(shape)
        else:
            cells = flat[:size].view(dtype).reshape(shape)
            if self.predictor == 2:
                cells = np.add.accumulate(cells, axis=1, dtype=dtype.newbyteorder("="))
        keep_rows, keep_cols = self.height - tile.row * self.tile_height, self.width - tile.col * self.tile_width
        return cells[:keep_rows, :keep_cols, 0]


class _Bytes:
    """Ranges of an open file; the head is read once."""

    def __init__(self, handle) -> None:
        self.handle, self.head = handle, handle.read_at(min(HEAD_BYTES, handle.size()), 0)

    def at(self, offset: int, size: int) -> bytes:
        if offset + size <= len(self.head):
            return self.head[offset : offset + size]
        got = self.handle.read_at(size, offset)
        if len(got) < size:
            raise Malformed("the file ends early")
        return got


def _fields(read: _Bytes, order: str, big: bool, at: int) -> tuple[dict[int, tuple], int]:
    """(values by tag, where the next directory is)."""
    n = struct.unpack(order + ("Q" if big else "H"), read.at(at, 8 if big else 2))[0]
    size, inline = (20, 8) if big else (12, 4)
    at += 8 if big else 2
    out = {}
    raw = read.at(at, n * size)
    for i in range(n):
        entry = raw[i * size : (i + 1) * size]
        tag, kind = struct.unpack(order + "HH", entry[:4])
        count = struct.unpack(order + ("Q" if big else "I"), entry[4 : 4 + inline])[0]
        code = TYPES.get(kind)
        if code is None:
            continue
        length = struct.calcsize("=" + code) * count
        value = entry[-inline:]
        if length > inline:
            value = read.at(struct.unpack(order + ("Q" if big else "I"), value)[0], length)
        out[tag] = (value[:length],) if code == "s" else struct.unpack(order + code[0] * (count * len(code)), value[:length])
    return out, struct.unpack(order + ("Q" if big else "I"), read.at(at + n * size, inline))[0]


def _level(tags: dict[int, tuple], order: str) -> Level:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    bits, kind = one(BITS, 1), KINDS.get(one(SAMPLE_FORMAT, 1))
    if bits % 8 or kind is None or (one(PLANAR, 1) != 1 and one(SAMPLES, 1) != 1):
        raise Malformed(f"{bits} bits a sample of kind {one(SAMPLE_FORMAT, 1)} are not known")
    width, height = one(WIDTH), one(HEIGHT)
    tiled = TILE_WIDTH in tags
    tile_width, tile_height = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    px, py = tags.get(PIXEL_SCALE, (1.0, 1.0))[:2]
    tie = tags.get(TIEPOINT, (0.0,) * 6)
    keys = tags.get(GEO_KEYS, ())
    known = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    text = one(NODATA, b"").rstrip(b"\0 ").decode("ascii", "replace")
    dtype = f"{order if bits > 8 else '|'}{kind}{bits // 8}"
    return Level(
        width, height, tile_width, tile_height, dtype, one(COMPRESSION, NONE), one(PREDICTOR, 1), one(SAMPLES, 1), np.array(offsets, dtype=np.int64), np.array(counts, dtype=np.int64),
        tie[3] - tie[0] * px, tie[4] + tie[1] * py, px, py, known.get(PROJECTED_KEY, known.get(GEOGRAPHIC_KEY)), float(text) if text else None, bool(one(SUBFILE, 0) & 1),
    )


def levels(uri: str) -> list[Level]:
    """The file's raster and its overviews, the largest first; an overview has the raster's corner and contract, and its own cell size."""
    store, path = opened(uri)
    with store.open_input_file(path) as handle:
        read = _Bytes(handle)
        order = {b"II": "<", b"MM": ">"}.get(read.at(0, 2))
        version = struct.unpack(order + "H", read.at(2, 2))[0] if order else 0
        if version not in (42, 43):
            raise Malformed(f"{uri} is no TIFF")
        big, out = version == 43, []
        at = struct.unpack(order + ("Q" if big else "I"), read.at(8 if big else 4, 8 if big else 4))[0]
        seen = set()
        while at and at not in seen:
            seen.add(at)
            tags, at = _fields(read, order, big, at)
            if not out or tags.get(SUBFILE, (0,))[0] & 1:
                out.append(_level(tags, order))
    full = out[0]
    for x in out[1:]:
        x.x0, x.y0, x.px, x.py, x.epsg, x.nodata = full.x0, full.y0, full.px * full.width / x.width, full.py * full.height / x.height, full.epsg, full.nodata
    return [full, *sorted(out[1:], key=lambda x: -x.width)]


def files(uri: str) -> list[str]:
    """The file itself, or the committed files of a folder."""
    store, path = opened(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [uri]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(path)) if x.is_file and x.base_name.endswith((".tif", ".tiff")) and x.base_name[0] not in "._")
    return [f"{uri.rstrip('/')}/{n}" for n in names]


# reading ---------------------------------------------------------------------------------------------------------------


class Piece(InputPartition):
    """Some tiles of one file; row0, col0 are its corner on the raster's grid."""

    def __init__(self, uri: str, level: Level, row0: int, col0: int, tiles: list[Tile]) -> None:
        self.uri, self.level, self.row0, self.col0, self.tiles = uri, level, row0, col0, tiles


class TiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        whole = (-(2**31), 2**31 - 1)
        span = lambda x: tuple(map(int, x.split(":"))) if x else whole
        self.window = {"row": span(self.options.get("rows")), "col": span(self.options.get("cols"))}

    def partitions(self) -> list[Piece]:
        o = self.options
        number, most = int(o.get("level", 0)), int(o.get("partition_cells", PARTITION_CELLS))
        found = []
        for uri in files(o["path"]):
            every = levels(uri)
            if number >= len(every):
                raise Malformed(f"{uri} has {len(every) - 1} overviews")
            found.append((uri, every[number]))
        if not found:
            return []
        x0, y0 = map(float, o["origin"].split(",")) if "origin" in o else (min(x.x0 for _, x in found), max(x.y0 for _, x in found))
        (r1, r2), (c1, c2) = self.window["row"], self.window["col"]
        out = []
        for uri, level in found:
            row0, col0 = round((y0 - level.y0) / level.py), round((level.x0 - x0) / level.px)
            tiles = level.tiles((r1 - row0, r2 - row0), (c1 - col0, c2 - col0)) if r1 <= r2 and c1 <= c2 else []
            each = max(1, most // (level.tile_width * level.tile_height))
            out += [Piece(uri, level, row0, col0, tiles[i : i + each]) for i in range(0, len(tiles), each)]
        return out

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark hands out where none is planned
            return
        level, zeros = partition.level, self.options.get("zeros", "false") == "true"
        (r1, r2), (c1, c2) = self.window["row"], self.window["col"]
        store, path = opened(partition.uri)
        with store.open_input_file(path) as handle:
            for tile in partition.tiles:
                cells = level.decode(handle.read_at(tile.size, tile.offset), tile).astype(np.float64)
                top, left = partition.row0 + tile.row * level.tile_height, partition.col0 + tile.col * level.tile_width
                a, b = max(r1 - top, 0), max(c1 - left, 0)
                cells = cells[a : max(r2 - top + 1, 0), b : max(c2 - left + 1, 0)]
                keep = ~np.isnan(cells)
                if level.nodata is not None:
                    keep &= cells != level.nodata
                if not zeros:
                    keep &= cells != 0
                rows, cols = np.nonzero(keep)
                if len(rows):
                    arrays = [pa.array((rows + top + a).astype(np.int32)), pa.array((cols + left + b).astype(np.int32)), pa.array(cells[rows, cols])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["row", "col", "value"])


class PushingReader(TiffReader):
    """A reader that takes filters on row and col as its window; Spark allows it where the session has the pushdown switched on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in self.window or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            low, high = self.window[name]
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                low = max(low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                high = min(high, f.value - isinstance(f, LessThan))
            self.window[name] = (low, high)


# writing ---------------------------------------------------------------------------------------------------------------


def encode(cells: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        cells = np.diff(cells, axis=1, prepend=cells.dtype.type(0))
    raw = cells.tobytes()
    return raw if compression == NONE else lzw_encode(raw) if compression == LZW else zlib.compress(raw, 6)


def directory(entries: dict[int, tuple[int, object]], at: int) -> bytes:
    """A little-endian BigTIFF directory that begins at byte at, and its longer values behind it."""
    body, behind = bytearray(struct.pack("<Q", len(entries))), bytearray()
    base = at + 8 + 20 * len(entries) + 8
    for tag in sorted(entries):
        kind, values = entries[tag]
        raw = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
        count = len(raw) if isinstance(values, bytes) else len(values)
        body += struct.pack("<HHQ", tag, kind, count)
        if len(raw) <= 8:
            body += raw.ljust(8, b"\0")
        else:
            body += struct.pack("<Q", base + len(behind))
            behind += raw + b"\0" * (-len(raw) % 8)
    return bytes(body + struct.pack("<Q", 0) + behind)


class Written(WriterCommitMessage):
    def __init__(self, names: list[tuple[str, str]]) -> None:
        self.names = names


class TiffWriter(DataSourceWriter):
    """A file for each block of the grid that has cells.  Rows of a task must come by block and by tile within it, as write_geotiff sends
    them; a task holds one tile as cells and a block's others compressed.  Files get their names when the job commits; what a
    failed task or job leaves behind is never read."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        o = self.options = dict(options)
        self.overwrite = overwrite
        self.tile, self.block = int(o.get("tile", 256)), int(o.get("block", 4096))
        if self.tile % 16 or self.block % self.tile:
            raise ValueError("a tile has a multiple of 16 cells a side, a block a multiple of a tile's")
        self.grid = Grid(float(o.get("x0", 0)), float(o.get("y0", 0)), float(o.get("px", 1)), float(o.get("py", 1)), epsg=int(o.get("epsg", 4326)))
        self.dtype = np.dtype(o.get("dtype", "float32")).newbyteorder("<")
        self.compression = COMPRESSIONS[o.get("compression", "deflate")]
        self.predictor = 2 if self.dtype.kind in "iu" and self.compression != NONE else 1
        self.nodata = float(o["nodata"]) if "nodata" in o else None
        self.path = o["path"].rstrip("/")
        self.staging = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        """One task's rows."""
        done: list[tuple[str, str]] = []
        block = tile = cells = None
        tiles: dict[tuple[int, int], bytes] = {}
        for row, col, value in iterator:
            where = (row // self.block, col // self.block)
            place = (row // self.tile, col // self.tile)
            if place != tile:
                if tile is not None:
                    tiles[tile] = encode(cells, self.compression, self.predictor)
                if where != block:
                    if block is not None:
                        done.append(self.file_of(block, tiles))
                    block, tiles = where, {}
                if place in tiles or f"r{where[0]}_c{where[1]}.tif" in (name for _, name in done):
                    raise ValueError("the rows of a tile or block are not together; write with write_geotiff")
                tile, cells = place, np.full((self.tile, self.tile), 0 if self.nodata is None else self.nodata, dtype=self.dtype)
            if value is not None:
                cells[row % self.tile, col % self.tile] = value
        if block is not None:
            tiles[tile] = encode(cells, self.compression, self.predictor)
            done.append(self.file_of(block, tiles))
        return Written(done)

    def file_of(self, block: tuple[int, int], tiles: dict[tuple[int, int], bytes]) -> tuple[str, str]:
        """Writes a block's tiles as a file under a name of its own: (that name, the name it gets)."""
        rows, cols = zip(*tiles)
        top, left, down, across = min(rows), min(cols), max(rows) - min(rows) + 1, max(cols) - min(cols) + 1
        order = [(top + r, left + c) for r in range(down) for c in range(across)]
        counts = [len(tiles.get(x, b"")) for x in order]
        head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16)
        at = len(head) + len(directory(self.entries(top, left, down, across, counts, counts), len(head)))
        offsets = [int(x) if n else 0 for x, n in zip(at + np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)]
        store, staging = opened(self.staging)
        store.create_dir(staging, recursive=True)
        part = f"{uuid.uuid4().hex}.part"
        with store.open_output_stream(f"{staging}/{part}", compression=None) as out:
            out.write(head + directory(self.entries(top, left, down, across, offsets, counts), len(head)))
            for x in order:
                out.write(tiles.get(x, b""))
        return part, f"r{block[0]}_c{block[1]}.tif"

    def entries(self, top: int, left: int, down: int, across: int, offsets: list[int], counts: list[int]) -> dict[int, tuple[int, object]]:
        g, code = self.grid, {"u": 1, "i": 2, "f": 3}[self.dtype.kind]
        geographic = g.epsg == 4326
        keys = (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, GEOGRAPHIC_KEY if geographic else PROJECTED_KEY, 0, 1, g.epsg)
        out = {
            WIDTH: (4, [across * self.tile]), HEIGHT: (4, [down * self.tile]), BITS: (3, [self.dtype.itemsize * 8]), COMPRESSION: (3, [self.compression]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), PREDICTOR: (3, [self.predictor]),
            TILE_WIDTH: (4, [self.tile]), TILE_HEIGHT: (4, [self.tile]), TILE_OFFSETS: (16, offsets), TILE_COUNTS: (16, counts), SAMPLE_FORMAT: (3, [code]),
            PIXEL_SCALE: (12, [g.px, g.py, 0.0]), TIEPOINT: (12, [0.0, 0.0, 0.0, g.x0 + left * self.tile * g.px, g.y0 - top * self.tile * g.py, 0.0]), GEO_KEYS: (3, list(keys)),
        }
        if self.nodata is not None:
            out[NODATA] = (2, f"{self.nodata:g}".encode() + b"\0")
        return out

    def commit(self, messages: list[Written | None]) -> None:
        """Names the files of the tasks that were accepted, and of no other attempt."""
        store, path = opened(self.path)
        _, staging = opened(self.staging)
        store.create_dir(path, recursive=True)
        names = [x for m in messages if m for x in m.names]
        if len({name for _, name in names}) < len(names):
            raise ValueError("several tasks have rows of one block; write with write_geotiff")
        there = {x.base_name for x in store.get_file_info(fs.FileSelector(path)) if x.is_file}
        if self.overwrite:
            for name in there:
                if name == "_SUCCESS" or name.endswith(".tif"):
                    store.delete_file(f"{path}/{name}")
        elif there & {name for _, name in names}:
            raise FileExistsError(f"{self.path} has files of these blocks")
        for part, name in names:
            store.move(f"{staging}/{part}", f"{path}/{name}")
        store.open_output_stream(f"{path}/_SUCCESS", compression=None).close()
        self._drop()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        store, staging = opened(self.staging)
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TiffReader:
        return (PushingReader if self.options.get("push") == "true" else TiffReader)(self.options)

    def writer(self, schema, overwrite: bool) -> TiffWriter:
        if [f.name for f in schema.fields] != ["row", "col", "value"]:
            raise ValueError("cells have the columns row, col and value")
        return TiffWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiff)


def write_geotiff(cells: DataFrame, path: str, grid: Grid, tile: int = 256, block: int = 4096, dtype: str = "float32", nodata: float | None = None, compression: str = "deflate", mode: str = "overwrite") -> None:
    """(row, col, value) as a folder of files, one for each block of cells; cells without a row are 0, or nodata if that is given.  A
    block's cells meet in one task, in the order of its tiles; there are as many tasks as partitions, however large the raster is."""
    register(cells.sparkSession)
    side = lambda c, n: F.floor(F.col(c) / n)
    rows = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))
    dealt = rows.repartition(side("row", block), side("col", block)).sortWithinPartitions(side("row", block), side("col", block), side("row", tile), side("col", tile), "row", "col")
    options = {"path": path, "x0": grid.x0, "y0": grid.y0, "px": grid.px, "py": grid.py, "epsg": grid.epsg, "tile": tile, "block": block, "dtype": dtype, "compression": compression}
    if nodata is not None:
        options["nodata"] = nodata
    dealt.write.format("geotiff").options(**options).mode(mode).save()


def read_geotiff(spark: SparkSession, path: str, grid: Grid | None = None, box: tuple[float, float, float, float] | None = None, level: int = 0, zeros: bool = False) -> DataFrame:
    """(row, col, value) on the grid, by default the raster's own; with a box only the tiles around it are opened."""
    register(spark)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("geotiff").option("path", path).option("level", level).option("zeros", str(zeros).lower()).option("push", push)
    if grid is not None:
        reader = reader.option("origin", f"{grid.x0!r},{grid.y0!r}")
    if box is not None:
        r1, r2, c1, c2 = raster.window_range(grid or grid_of(path, level), box)
        reader = reader.option("rows", f"{r1}:{r2}").option("cols", f"{c1}:{c2}")
    return reader.load()


def grid_of(path: str, level: int = 0) -> Grid:
    """The grid of a file or folder: its upper left corner, cell size, width and projection; ValueError if files differ in cell size."""
    found = [levels(x)[level] for x in files(path)]
    if not found:
        raise FileNotFoundError(path)
    x0, y0, px, py = min(x.x0 for x in found), max(x.y0 for x in found), found[0].px, found[0].py
    if any(abs(x.px - px) > 1e-9 * px or abs(x.py - py) > 1e-9 * py for x in found):
        raise ValueError(f"the files of {path} differ in cell size")
    return Grid(x0, y0, px, py, max(round((x.x0 - x0) / px) + x.width for x in found), found[0].epsg or 4326)


def profile(path: str) -> dict[str, object]:
    """What a raster's directories state, without its cells: dtype, nodata, epsg, pixel, overviews, bounds and cells."""
    found = [levels(x) for x in files(path)]
    full = [x[0] for x in found]
    first = full[0]
    return {
        "dtype": np.dtype(first.dtype).name, "nodata": first.nodata, "epsg": first.epsg, "pixel": first.px, "overviews": min(len(x) for x in found) - 1, "cells": sum(x.width * x.height for x in full),
        "bounds": (min(x.x0 for x in full), min(x.y0 - x.py * x.height for x in full), max(x.x0 + x.px * x.width for x in full), max(x.y0 for x in full)),
    }


def observed(spark: SparkSession, path: str, layer: str, level: int = 0) -> DataFrame:
    """One row for contracts.check_contracts: what the directories state, and the extremes of the cells of a level."""
    p = profile(path)
    span = read_geotiff(spark, path, level=level, zeros=True).agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    typed = lambda v, kind: F.lit(v).cast(kind)
    return span.select(typed(layer, "string").alias("layer"), typed(p["dtype"], "string").alias("dtype"), "vmin", "vmax", typed(p["nodata"], "double").alias("nodata"), typed(p["epsg"], "int").alias("epsg"), typed(p["pixel"], "double").alias("pixel"))
