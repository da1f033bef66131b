"""GeoTIFF files: round trips, windows that open their tiles alone, foreign files, damaged files, commits."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

from gridquill.operators import contracts, raster
from gridquill.plans import exposure
from gridquill.sources import geotiff, staging
from gridquill.sources.tables import Grid
from tests.conftest import DATA, assert_same

GRID = Grid(x0=103.0, y0=14.0, px=0.01, py=0.01)


def cells_of(array, row0=0, col0=0, zeros=False):
    return {(r + row0, c + col0, float(v)) for (r, c), v in np.ndenumerate(array) if zeros or v != 0}


def table(spark, array, row0=0, col0=0):
    return spark.createDataFrame([(r + row0, c + col0, float(v)) for (r, c), v in np.ndenumerate(array) if v != 0], "row int, col int, value double")


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("raw", [b"", b"a", b"aaaaaaaaaaaaaaaaaa", bytes(range(256)) * 40, np.random.default_rng(1).integers(0, 256, 50_000, dtype=np.uint8).tobytes(), np.random.default_rng(2).integers(0, 3, 300_000, dtype=np.uint8).tobytes(), b"\0" * 500_000])
def test_lzw_there_and_back(raw):
    assert geotiff.lzw_decode(geotiff.lzw_encode(raw), len(raw)).tobytes() == raw


def test_lzw_of_every_length():
    raw = np.random.default_rng(3).integers(0, 7, 6000, dtype=np.uint8).tobytes()
    for n in [*range(700), *range(3800, 3860)]:
        assert geotiff.lzw_decode(geotiff.lzw_encode(raw[:n]), n).tobytes() == raw[:n]


def test_lzw_known_stream_and_damage():
    # The example of the format's specification: 7 7 7 8 8 7 7 6 6.
    codes = (256, 7, 258, 8, 8, 258, 6, 6, 257)
    bits = int("".join(f"{c:09b}" for c in codes) + "0" * (-9 * len(codes) % 8), 2)
    raw = bits.to_bytes(-(-9 * len(codes) // 8), "big")
    assert geotiff.lzw_decode(raw, 9).tolist() == [7, 7, 7, 8, 8, 7, 7, 6, 6]
    assert geotiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw
    with pytest.raises(geotiff.Malformed, match="ends early"):
        geotiff.lzw_decode(raw[:5], 9)
    early = int("".join(f"{c:09b}" for c in (256, 7, 300, 257)) + "0" * 4, 2).to_bytes(5, "big")
    with pytest.raises(geotiff.Malformed, match="before its entry"):
        geotiff.lzw_decode(early, 9)


@pytest.mark.parametrize("compression", ["none", "lzw", "deflate"])
@pytest.mark.parametrize("dtype", ["uint8", "int16", "float32"])
def test_round_trip(spark, tmp_path, compression, dtype):
    array = np.random.default_rng(5).integers(0, 6, (70, 90)) * (np.random.default_rng(6).random((70, 90)) < 0.3)
    path = str(tmp_path / "tiff")
    geotiff.write_geotiff(table(spark, array), path, GRID, tile=16, block=32, dtype=dtype, compression=compression)
    assert rows(geotiff.read_geotiff(spark, path)) == cells_of(array)
    assert len(geotiff.files(path)) == 9
    grid = geotiff.grid_of(path)
    assert (round(grid.x0, 9), round(grid.y0, 9), grid.px, grid.epsg) == (103.0, 14.0, 0.01, 4326)
    again = geotiff.read_geotiff(spark, geotiff.files(path)[0], GRID)
    assert rows(again) == {(r, c, v) for r, c, v in cells_of(array) if r < 32 and c < 32}


def test_corners_off_the_origin_absent_tiles_and_negative_places(spark, tmp_path):
    array = np.zeros((40, 40), dtype=int)
    array[0, 0] = array[39, 39] = 3
    path = str(tmp_path / "tiff")
    geotiff.write_geotiff(table(spark, array, -5, 1000), path, GRID, tile=16, block=64)
    assert rows(geotiff.read_geotiff(spark, path, GRID)) == cells_of(array, -5, 1000)
    held = sum(int((x.counts > 0).sum()) for f in geotiff.files(path) for x in geotiff.levels(f))
    assert held == 2


def test_nodata_nulls_and_zeros(spark, tmp_path):
    path = str(tmp_path / "tiff")
    cells = spark.createDataFrame([(0, 0, 0.0), (0, 1, None), (1, 1, 2.5), (1, 2, float("nan"))], "row int, col int, value double")
    geotiff.write_geotiff(cells, path, GRID, tile=16, block=16, nodata=-1.0)
    assert rows(geotiff.read_geotiff(spark, path)) == {(1, 1, 2.5)}
    assert rows(geotiff.read_geotiff(spark, path, zeros=True)) == {(0, 0, 0.0), (1, 1, 2.5)}
    assert geotiff.profile(path)["nodata"] == -1.0
    geotiff.write_geotiff(cells.limit(0), path, GRID)
    assert geotiff.files(path) == [] and rows(geotiff.read_geotiff(spark, path)) == set()


def test_a_window_opens_its_tiles_alone(spark, tmp_path):
    array = np.random.default_rng(7).integers(1, 6, (128, 128))
    path = str(tmp_path / "tiff")
    geotiff.write_geotiff(table(spark, array), path, GRID, tile=16, block=64, dtype="uint8")
    box = (103.20, 13.60, 103.30, 13.70)
    expected = rows(raster.clip_window(table(spark, array), GRID, box))
    r1, r2, c1, c2 = raster.window_range(GRID, box)
    pieces = geotiff.TiffReader({"path": path, "rows": f"{r1}:{r2}", "cols": f"{c1}:{c2}"}).partitions()
    planned = {((p.row0 // 16) + t.row, (p.col0 // 16) + t.col) for p in pieces for t in p.tiles}
    assert planned == {(r, c) for r in range(r1 // 16, r2 // 16 + 1) for c in range(c1 // 16, c2 // 16 + 1)}
    # What is no part of the window may be damaged: it is not looked at.
    wanted = {(p.uri, t.offset) for p in pieces for t in p.tiles}
    for f in geotiff.files(path):
        (level,) = geotiff.levels(f)
        with open(f, "r+b") as handle:
            for offset, count in zip(level.offsets, level.counts):
                if (f, int(offset)) not in wanted:
                    handle.seek(offset)
                    handle.write(b"\xff" * int(count))
    assert rows(geotiff.read_geotiff(spark, path, GRID, box)) == expected
    with pytest.raises(Exception, match="zlib|incorrect header|decompress"):
        geotiff.read_geotiff(spark, path).collect()


def test_filters_become_a_window(spark, tmp_path):
    reader = geotiff.PushingReader({"path": "nowhere"})
    kept = [EqualTo(("value",), 1.0), EqualTo(("row", "x"), 1)]
    assert list(reader.pushFilters([GreaterThan(("row",), 4), LessThanOrEqual(("row",), 9), GreaterThanOrEqual(("col",), 2), LessThan(("col",), 7), *kept])) == kept
    assert reader.window == {"row": (5, 9), "col": (2, 6)}
    array = np.random.default_rng(8).integers(1, 6, (40, 40))
    path = str(tmp_path / "tiff")
    geotiff.write_geotiff(table(spark, array), path, GRID, tile=16, block=32)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = geotiff.read_geotiff(spark, path).where("row between 10 and 20 and col = 33 and value > 2")
        assert rows(found) == {(r, c, v) for r, c, v in cells_of(array) if 10 <= r <= 20 and c == 33 and v > 2}
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def classic(path, arrays, order="<", strips=None, compression=1, predictor=1, extra=()):
    """A classic TIFF with a directory for each array, written by hand as another program might."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for n, a in enumerate(arrays):
        a = np.asarray(a)
        height = strips or a.shape[0]
        kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
        offsets, counts = [], []
        for top in range(0, a.shape[0], height):
            part = np.ascontiguousarray(a[top : top + height]).astype(a.dtype.newbyteorder(order))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=part.dtype.type(0)).astype(part.dtype)
            raw = part.tobytes()
            if predictor == 3:
                planes = part.astype(part.dtype.newbyteorder(">")).view(np.uint8).reshape(part.shape[0], part.shape[1], -1).transpose(0, 2, 1).reshape(part.shape[0], -1)
                raw = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
            raw = geotiff.lzw_encode(raw) if compression == 5 else zlib.compress(raw) if compression in (8, 32946) else raw
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw
        tags = {254: (4, [1 if n else 0]), 256: (3, [a.shape[1]]), 257: (3, [a.shape[0]]), 258: (3, [a.dtype.itemsize * 8]), 259: (3, [compression]), 273: (4, offsets), 277: (3, [1]), 278: (3, [height]), 279: (4, counts), 317: (3, [predictor]), 339: (3, [kind])}
        if not n:
            tags |= {33550: (12, [0.5, 0.25, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 10.0, 20.0, 0.0])} | dict(extra)
        values = {}
        for tag, (code, v) in tags.items():
            raw = v if isinstance(v, bytes) else struct.pack(f"{order}{len(v)}{geotiff.TYPES[code]}", *v)
            values[tag] = (code, len(raw) if isinstance(v, bytes) else len(v), raw)
        for tag, (code, count, raw) in values.items():
            if len(raw) > 4:
                values[tag] = (code, count, struct.pack(order + "I", len(out)))
                out += raw
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(values))
        for tag in sorted(values):
            code, count, raw = values[tag]
            out += struct.pack(order + "HHI", tag, code, count) + raw.ljust(4, b"\0")
        link = len(out)
        out += struct.pack(order + "I", 0)
    path.write_bytes(bytes(out))
    return str(path)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("compression", "predictor", "dtype"), [(1, 1, "int16"), (5, 2, "uint16"), (8, 3, "float32"), (32946, 1, "float64"), (5, 1, "int8"), (8, 2, "int32"), (8, 3, "float64")])
def test_files_of_other_programs(spark, tmp_path, order, compression, predictor, dtype):
    array = np.random.default_rng(9).integers(-3, 6, (37, 23)).clip(0 if dtype[0] == "u" else -3).astype(dtype)
    path = classic(tmp_path / "a.tif", [array, array[::2, ::2]], order, strips=10, compression=compression, predictor=predictor, extra={42113: (2, b"-3\0"), 34735: (3, [1, 1, 0, 1, 2048, 0, 1, 4326])})
    assert rows(geotiff.read_geotiff(spark, path)) == {(r, c, v) for r, c, v in cells_of(array) if v != -3}
    assert rows(geotiff.read_geotiff(spark, path, level=1)) == {(r, c, v) for r, c, v in cells_of(array[::2, ::2]) if v != -3}
    stated = geotiff.profile(path)
    assert (stated["dtype"], stated["nodata"], stated["epsg"], stated["pixel"], stated["overviews"]) == (dtype, -3.0, 4326, 0.5, 1)
    assert stated["bounds"] == (10.0, 20.0 - 37 * 0.25, 10.0 + 23 * 0.5, 20.0)
    grid = geotiff.grid_of(path, 1)
    assert abs(grid.px - 0.5 * 23 / 12) < 1e-12 and grid.width == 12
    with pytest.raises(Exception, match="1 overviews"):
        geotiff.read_geotiff(spark, path, level=2).collect()


def test_what_is_no_tiff(spark, tmp_path):
    (tmp_path / "x.tif").write_bytes(b"not a raster at all")
    with pytest.raises(geotiff.Malformed, match="no TIFF"):
        geotiff.levels(str(tmp_path / "x.tif"))
    whole = classic(tmp_path / "b.tif", [np.ones((40, 40), dtype="uint8")], strips=8)
    raw = (tmp_path / "b.tif").read_bytes()
    (tmp_path / "cut.tif").write_bytes(raw[: len(raw) - 20])
    with pytest.raises((geotiff.Malformed, struct.error)):
        geotiff.levels(str(tmp_path / "cut.tif"))
    odd = classic(tmp_path / "c.tif", [np.ones((4, 4), dtype="uint8")], compression=7)
    with pytest.raises(Exception, match="compression 7"):
        geotiff.read_geotiff(spark, odd).collect()
    with pytest.raises(Exception):
        geotiff.read_geotiff(spark, str(tmp_path / "absent")).collect()
    assert rows(geotiff.read_geotiff(spark, whole)) == cells_of(np.ones((40, 40)))


def test_commits(spark, tmp_path):
    path = str(tmp_path / "tiff")
    one, two = np.full((20, 20), 1), np.full((20, 20), 2)
    geotiff.write_geotiff(table(spark, one), path, GRID, tile=16, block=16)
    with pytest.raises(Exception, match="of these blocks"):
        geotiff.write_geotiff(table(spark, two), path, GRID, tile=16, block=16, mode="append")
    assert rows(geotiff.read_geotiff(spark, path)) == cells_of(one)
    geotiff.write_geotiff(table(spark, two, 320, 320), path, GRID, tile=16, block=16, mode="append")
    assert rows(geotiff.read_geotiff(spark, path, GRID)) == cells_of(one) | cells_of(two, 320, 320)
    geotiff.write_geotiff(table(spark, two[:5]), path, GRID, tile=16, block=16)
    assert rows(geotiff.read_geotiff(spark, path)) == cells_of(two[:5])
    bad = table(spark, one).selectExpr("row", "col", "if(row = 19 and col = 19, raise_error('broken'), value) as value")
    with pytest.raises(Exception, match="broken"):
        geotiff.write_geotiff(bad, path, GRID, tile=16, block=16)
    assert rows(geotiff.read_geotiff(spark, path)) == cells_of(two[:5])
    assert sorted(x.name for x in (tmp_path / "tiff").iterdir()) == ["_SUCCESS", "r0_c0.tif", "r0_c1.tif"]
    geotiff.register(spark)
    loose = table(spark, np.ones((40, 40))).orderBy("col", "row").coalesce(1)
    with pytest.raises(Exception, match="not together"):
        loose.write.format("geotiff").options(path=path, tile=16, block=32).mode("overwrite").save()


def test_clips_are_kept_and_contracts_checked(spark, tmp_path):
    array = np.random.default_rng(10).integers(0, 6, (60, 60))
    source, box = str(tmp_path / "source"), (103.2, 13.7, 103.3, 13.8)
    geotiff.write_geotiff(table(spark, array), source, GRID, tile=16, block=32, dtype="int8")
    expected = {x for x in rows(raster.clip_window(table(spark, array), GRID, box))}
    for _ in range(2):
        assert rows(staging.geotiff_clip(spark, str(tmp_path), "area", "hazard_flood", source, GRID, box)) == expected
        for f in tmp_path.joinpath("source").glob("*.tif"):
            f.write_bytes(b"")  # the second request doesn't need it
    with pytest.raises(ValueError, match="identifier"):
        staging.geotiff_clip(spark, str(tmp_path), "../x", "hazard_flood", source, GRID, box)
    kept = str(tmp_path / "clip/area/hazard_flood")
    seen = geotiff.observed(spark, kept, "hazard_flood")
    assert seen.columns == [x.split(" ")[0] for x in contracts.OBSERVED.split(", ")]
    r = seen.first()
    assert (r["dtype"], r["vmin"], r["vmax"], r["epsg"]) == ("float32", 0.0, 5.0, 4326)


def test_query(spark):
    assert_same(exposure.QUERIES["geotiff_window"](spark, DATA), exposure.ORACLE_SQL["geotiff_window"])
