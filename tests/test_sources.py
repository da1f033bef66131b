"""Files, staged tables and paged services, each written and read back."""

from __future__ import annotations

import io
import json
import re
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from gridquill.operators import overlay
from gridquill.sources import files, rest, staging
from gridquill.sources.tables import Grid


def feature(kind, coordinates, **props):
    return {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": coordinates}}


def test_geojson(spark, tmp_path):
    rows = [feature("Point", [0.5, 0.25], name="a"), feature("LineString", [[0, 0], [1, 1], [2, 1]], highway="x"), feature("LineString", [[0, 0]]), feature("Point", [9, 9])]
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": rows}, indent=1))
    found = files.read_geojson(spark, str(tmp_path / "f.geojson"))
    assert [(r["name"], r["lon"], r["lat"]) for r in files.points(found).orderBy("fid").collect()] == [("a", 0.5, 0.25), (None, 9.0, 9.0)]
    assert overlay.segments(files.line_vertices(found)).count() == 2
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    for kind, shape in (("Polygon", [ring]), ("MultiPolygon", [[ring], [ring]])):
        (tmp_path / f"{kind}.geojson").write_text(json.dumps({"features": [feature(kind, shape)]}))
        rings = files.boundary(files.read_geojson(spark, str(tmp_path / f"{kind}.geojson")))
        assert len(rings) == (1 if kind == "Polygon" else 2) and rings[0][1] == (4.0, 0.0)
    with pytest.raises(ValueError):
        files.boundary(found)
    lines = files.points(found).select(files.feature_json("Point", F.array("lon", "lat"), F.create_map(F.lit("name"), "name")).alias("feature"))
    files.write_geojson_lines(lines, str(tmp_path / "out"))
    back = files.read_geojson_lines(spark, str(tmp_path / "out"))
    assert {(r["lon"], r["lat"]) for r in files.points(back.withColumn("file", F.lit(""))).collect()} == {(0.5, 0.25), (9.0, 9.0)}


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("twenty characters and more é".encode())
    (tmp_path / "b.md").write_text("short")
    (tmp_path / "c.docx").write_bytes(docx("a paragraph of some length", "another"))
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.exe").write_bytes(b"x" * 30)
    (tmp_path / "f.pdf").write_bytes(b"%PDF-1.4 nothing much in here")
    found = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in files.load_documents(spark, str(tmp_path)).collect()}
    assert found["a.txt"] == ("twenty characters and more é", None) and found["b.md"] == (None, "no text in it") and found["e.exe"] == (None, "unsupported file type")
    assert found["c.docx"] == ("a paragraph of some length\n\nanother\n\nc1 | c2", None) and found["d.docx"][1].startswith("unreadable") and found["f.pdf"][1].startswith("unreadable")


def test_cells_by_tile(spark, tmp_path):
    path = str(tmp_path / "cells")
    cells = spark.range(40 * 40).selectExpr("cast(id div 40 as int) as row", "cast(id % 40 as int) as col", "cast(id % 3 as double) as value")
    staging.write_cells(cells, path, "hazard", tile=10)
    staging.write_cells(cells.limit(5), path, "other", tile=10)
    staging.write_cells(cells, path, "odd/na me", tile=10)
    staging.write_cells(cells.limit(3), path, "odd/na me", tile=10)  # replaces all of it
    assert staging.read_cells(spark, path, "odd/na me").count() == 2
    staging.write_cells(cells, path, "hazard", tile=10)
    assert staging.read_cells(spark, path, "hazard").count() == cells.where("value <> 0").count()
    g = Grid(x0=0.0, y0=0.0, px=1.0, py=1.0, width=40)
    part = staging.read_cells(spark, path, "hazard", g, (12.5, -8.5, 14.5, -6.5), tile=10)
    assert {(r["row"], r["col"]) for r in part.collect()} == {(r, c) for r in range(6, 9) for c in range(12, 15) if (r * 40 + c) % 3}
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "tile_row" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(row,6)" in plan


def test_staging(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert staging.staged(spark, str(tmp_path / "x"), make).count() == 3
    assert len(calls) == 1
    a = staging.recomputed_risk(spark, str(tmp_path), "area", "flood", {"a": 0.5}, lambda: spark.range(1))
    b = staging.recomputed_risk(spark, str(tmp_path), "area", "flood", {"a": 0.6}, lambda: spark.range(2))
    assert (a.count(), b.count()) == (1, 2)
    raw = spark.createDataFrame([("ab1", "f.txt", bytearray(b"x")), ("cd2", "g.txt", bytearray(b"y"))], "doc_id string, filename string, content binary")
    staging.archive(raw, str(tmp_path / "raw"))
    assert [r["filename"] for r in staging.archived(spark, str(tmp_path / "raw"), "cd2").collect()] == ["g.txt"]


def test_library_checks(spark, tmp_path):
    save = lambda rows, name: (staging.save_library(spark.createDataFrame(rows, "chunk_id string, embedding array<float>, model string"), str(tmp_path / name)), str(tmp_path / name))[1]
    good = save([("a", [1.0, 2.0], "m"), ("b", [1.0, 2.0], "m")], "good")
    assert staging.load_library(spark, good, "m").count() == 2
    for i, rows in enumerate(([("a", [1.0], "m"), ("a", [1.0], "m")], [("a", None, "m")], [("a", [1.0], "m"), ("b", [1.0, 2.0], "m")])):
        with pytest.raises(ValueError):
            staging.load_library(spark, save(rows, f"bad{i}"))
    with pytest.raises(ValueError):
        staging.load_library(spark, good, "other")


def test_library_writers(spark, tmp_path):
    """Of writers that have read the same version one commits; a lost writer's claim is passed over."""
    path, rows = str(tmp_path / "library"), lambda n: spark.range(n).selectExpr("cast(id as string) as chunk_id")
    assert staging.library_version(spark, path) == 0
    seen = staging.save_library(rows(1), path)
    assert staging.save_library(rows(2), path, seen) == seen + 1
    with pytest.raises(staging.Conflict):
        staging.save_library(rows(3), path, seen)
    assert staging.load_library(spark, path).count() == 2 and staging.library_version(spark, path) == 2
    (tmp_path / "library" / "claims" / "3").touch()  # a writer that is at work, or lost
    with pytest.raises(staging.Conflict):
        staging.save_library(rows(3), path, 2)
    assert staging.save_library(rows(3), path, 2, lease_s=-1) == 4 and staging.load_library(spark, path).count() == 3


def test_ensure_area(spark, tmp_path):
    calls = []

    def fetch(layer, boundary):
        calls.append((layer, boundary.first()["name"]))
        return spark.range(len(calls))

    area = lambda how, km2: lambda: spark.createDataFrame([("somewhere", km2, how)], "name string, km2 double, how string")
    ask = lambda *layers, area_id="place-1", made=area("nominatim", 9e9): staging.ensure_area(spark, str(tmp_path), area_id, made, layers, fetch)
    assert set(ask("roads")) == {"area", "roads"} and ask("roads", "schools")["schools"].count() == 2
    assert ask("roads", "schools")["roads"].count() == 1 and calls == [("roads", "somewhere"), ("schools", "somewhere")]
    for odd in ({"area_id": "../x"}, {"area_id": "drawn-1", "made": area("drawn", 1500.5)}):
        with pytest.raises(ValueError):
            ask("roads", **odd)
    assert ask(area_id="drawn-2", made=area("drawn", 1500.0))["area"].count() == 1
    with pytest.raises(ValueError):
        staging.hazard_clip(spark, str(tmp_path), "a/b", "flood", spark.range(1), None, None)


def test_cache(spark, tmp_path):
    path, ok = str(tmp_path / "cache"), lambda t: t.count() > 0

    def fail():
        raise ConnectionError("down")

    with pytest.raises(ConnectionError):
        staging.cached(spark, path, fail, ok, 0, 10)
    table, stale = staging.cached(spark, path, lambda: spark.range(2), ok, 100, 10)
    assert (table.count(), stale) == (2, None)
    assert staging.cached(spark, path, fail, ok, 105, 10)[1] is None
    table, stale = staging.cached(spark, path, fail, ok, 200, 10)
    assert (table.count(), stale) == (2, 100.0)
    assert staging.cached(spark, path, lambda: spark.range(0), ok, 200, 10)[1] == 100.0
    assert staging.cached(spark, path, lambda: spark.range(5), ok, 300, 10)[0].count() == 5


class Service(BaseHTTPRequestHandler):
    """Seven features in pages; every third request is busy."""

    count = 0

    def do_GET(self):
        Service.count += 1
        q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
        busy, refused = Service.count % 3 == 0, self.path.startswith("/refused")
        at, size = q["resultOffset"], q["resultRecordCount"]
        body = {"error": {"message": "no such layer"}} if refused else {"features": [{"id": i} for i in range(at, min(7, at + size))], "properties": {"exceededTransferLimit": at + size < 7}}
        self.send_response(503 if busy and not refused else 200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_paged_json(spark, service):
    rest.register(spark)
    read = lambda path, **o: spark.read.format("paged_json").options(url=service + path, page_size=3, backoff_s=0.01, attempts=4, **o).load()
    for options in ({}, {"pages": 3}):
        assert sorted((r["offset"], json.loads(r["item"])["id"]) for r in read("/layer", **options).collect()) == [(i, i) for i in range(7)]
    with pytest.raises(Exception, match="no such layer"):
        read("/refused").collect()


class Mirror(BaseHTTPRequestHandler):
    """Busy below /a; below /b it answers with a way, a point and a centre, and keeps what it was asked."""

    asked: list[str] = []

    def do_GET(self):
        self.send_response(429 if self.path.startswith("/a") else 200)
        self.end_headers()
        if self.path.startswith("/b"):
            Mirror.asked.append(parse_qs(urlparse(self.path).query)["data"][0])
            line = [{"lon": 1.5, "lat": 2.0}, {"lon": 3.0, "lat": 2.5}]
            elements = [{"id": 1, "geometry": line}, {"id": 2, "lat": 2.25, "lon": 1.75, "tags": {"name": "x"}}, {"id": 3, "center": {"lat": 9.0, "lon": 1.6}}, {"id": 4, "geometry": line[:1]}, {"id": 5}]
            self.wfile.write(json.dumps({"elements": elements}).encode())

    def log_message(self, *args):
        pass


def test_map_features(spark):
    """The busy mirror is passed over; layer and box reach the service, and hold for what it answers."""
    server = HTTPServer(("127.0.0.1", 0), Mirror)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    rest.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = spark.read.format("map_features").options(url=f"{at}/a {at}/b", backoff_s=0.01).load()
        found = read.where("layer = 'hospitals' and lon >= 1.0 and lon <= 2.0 and lat >= 2.0 and lat <= 3.0")
        assert sorted((r["layer"], r["fid"], r["name"], r["line"] and len(r["line"])) for r in found.collect()) == [("hospitals", 1, None, 2), ("hospitals", 2, "x", None)]
        assert set(Mirror.asked) == {'[out:json][timeout:55];(node["amenity"="hospital"](2.0,1.0,3.0,2.0);way["amenity"="hospital"](2.0,1.0,3.0,2.0););out center;'}
        Mirror.asked.clear()
        assert {r["layer"] for r in read.where("layer in ('roads', 'buildings')").collect()} == {"roads", "buildings"} and len(set(Mirror.asked)) == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
        server.shutdown()


def test_gazetteer(spark):
    square = [[[0, 0], [0.1, 0], [0.1, 0.1], [0, 0.1], [0, 0]]]
    answers = [{"display_name": "Town, Land", "class": "place", "type": "town", "lon": "1.5", "lat": "2"}, {"display_name": "A, B", "class": "boundary", "type": "administrative", "lon": "0", "lat": "0", "geojson": {"type": "Polygon", "coordinates": square}}, {"display_name": "C", "class": "boundary", "type": "administrative", "geojson": {"type": "MultiPolygon", "coordinates": [square, square]}}]
    items = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(answers)], "offset long, item string")
    rows = rest.gazetteer(items, "town")
    found = {r["ord"]: (r["gtype"], r["km2"] and round(r["km2"], 2), r["lon"]) for r in rows.collect()}
    assert found == {0: (None, None, 1.5), 1: ("Polygon", 119.88, 0.0), 2: ("MultiPolygon", 239.76, None)}
    hole = [[[0.02, 0.02], [0.04, 0.02], [0.04, 0.07], [0.02, 0.07]]]
    more = [{"geojson": {"type": "Polygon", "coordinates": square + hole}}, {"geojson": {"type": "MultiPolygon", "coordinates": [square + hole, hole]}}, {"geojson": {"type": "MultiPolygon", "coordinates": []}}]
    again = rest.gazetteer(spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(more)], "offset long, item string"), "x")
    assert [round(r["km2"], 2) for r in again.orderBy("ord").collect()] == [107.89, 119.88, 0.0]
    from gridquill.operators import planning

    area = planning.areas(rows).first()
    assert (area["name"], area["how"]) == ("C", "nominatim")  # both parts of it count


class Small(BaseHTTPRequestHandler):
    """Refuses boxes that are wider than 1, half of them by a remark; has a road through each of them and one that crosses the middle."""

    sizes: list[float] = []

    def do_GET(self):
        asked = parse_qs(urlparse(self.path).query)["data"][0]
        south, west, north, east = map(float, re.search(r"\(([-\d.]+),([-\d.]+),([-\d.]+),([-\d.]+)\)", asked).groups())
        Small.sizes.append(east - west)
        refused = east - west > 1
        self.send_response(413 if refused and south < 2 else 200)
        self.end_headers()
        if refused:
            self.wfile.write(json.dumps({"remark": "runtime error: Query timed out", "elements": [{"type": "way", "id": 99, "geometry": [{"lon": 1, "lat": 1}, {"lon": 2, "lat": 2}]}]}).encode())
            return
        lines = {1: [(-1.0, 2.0), (5.0, 2.0)], 2: [(0.2, 0.2), (0.3, 0.3)], 3: [(3.7, 3.7), (9.0, 9.0)], 4: [(8.0, 8.0), (9.0, 9.0)]}
        met = {i: v for i, v in lines.items() if min(x for x, _ in v) <= east and max(x for x, _ in v) >= west and min(y for _, y in v) <= north and max(y for _, y in v) >= south}
        self.wfile.write(json.dumps({"elements": [{"type": "way", "id": i, "geometry": [{"lon": x, "lat": y} for x, y in v]} for i, v in met.items()]}).encode())

    def log_message(self, *args):
        pass


def test_large_areas_are_asked_for_in_parts(spark):
    """Roads that start outside and run into the box are kept; refused boxes are quartered; each feature comes once."""
    server = HTTPServer(("127.0.0.1", 0), Small)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rest.register(spark)
    options = {"url": f"http://127.0.0.1:{server.server_port}/x", "backoff_s": 0.01}
    with pytest.raises(ValueError, match="filterPushdown"):
        rest.map_layer(spark, layer="roads", box=(0.0, 0.0, 4.0, 4.0), **options)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for parts in (1, 3):
            Small.sizes.clear()
            found = rest.map_layer(spark, layer="roads", box=(0.0, 0.0, 4.0, 4.0), parts=parts, **options)
            assert sorted((r["fid"], r["min_lon"], r["max_lat"], len(r["line"])) for r in found.collect()) == [(1, -1.0, 2.0, 2), (2, 0.2, 0.3, 2), (3, 3.7, 9.0, 2)]
            assert max(Small.sizes) == pytest.approx(4.0 / parts) and min(Small.sizes) <= 1
        with pytest.raises(Exception, match="413|remark|timed out"):
            rest.map_layer(spark, layer="roads", box=(0.0, 0.0, 4.0, 4.0), splits=1, **options).collect()
        assert rest.map_layer(spark, layer="parks", box=(0.0, 0.0, 4.0, 4.0), **options).count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
        server.shutdown()
