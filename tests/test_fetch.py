"""Fetching: bounds, redirects, private hosts, lists that go on after failures, rasters that are fetched once."""

from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from gridquill.sources import fetch, geotiff, staging
from gridquill.sources.tables import Grid
from tests.test_geotiff import cells_of, rows, table

PROSE = b"A document with quite enough words to be kept as text."


class Site(BaseHTTPRequestHandler):
    asked: list[str] = []
    bodies: dict[str, bytes] = {}

    def do_GET(self):
        Site.asked.append(self.path)
        if self.path.startswith("/hop"):
            left = int(self.path.removeprefix("/hop"))
            self.send_response(302)
            self.send_header("Location", f"/hop{left - 1}" if left > 1 else "/a.txt")
            self.end_headers()
        elif self.path == "/inside":
            self.send_response(302)
            self.send_header("Location", "http://10.0.0.1/secret")
            self.end_headers()
        elif self.path == "/cut.txt":
            self.send_response(200)
            self.send_header("Content-Length", "1000")
            self.end_headers()
            self.wfile.write(PROSE)
        elif self.path in Site.bodies:
            self.send_response(200)
            self.end_headers()
            self.wfile.write(Site.bodies[self.path])
        else:
            self.send_response(404)
            self.end_headers()

    def log_message(self, *args):
        pass


@pytest.fixture
def site():
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Site.asked.clear()
    Site.bodies = {"/a.txt": PROSE, "/b.md": PROSE, "/big.txt": b"x" * 5000, "/short.txt": b"x", "/odd.exe": PROSE, "/c.txt": PROSE + b" Other."}
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def local(url):
    """The tests' own site is let through, nothing else that is private."""
    if not url.startswith("http://127.0.0.1:"):
        fetch.require_public(url)


def test_bounds_and_redirects(site):
    get = lambda path, **k: b"".join(fetch.pieces(site + path, check=local, **k))
    assert get("/a.txt") == get("/hop1") == get("/hop3") == PROSE
    for path, why in (("/hop4", "redirects"), ("/none", "HTTP 404"), ("/inside", "no public host"), ("/cut.txt", "broke off")):
        with pytest.raises(fetch.NotFetched, match=why):
            get(path)
    assert len(get("/big.txt", most=5000)) == 5000
    with pytest.raises(fetch.NotFetched, match="more than 4999"):
        get("/big.txt", most=4999)
    for url in (site + "/a.txt", "http://localhost/x", "http://[::1]/x", "http://169.254.169.254/x", "file:///etc/passwd", "ftp://x/y", "http://no-such-host.invalid/"):
        with pytest.raises(fetch.NotFetched):
            list(fetch.pieces(url))


def test_a_list_goes_on_after_failures(spark, tmp_path, site):
    paths = ["/a.txt", "/b.md", "/none.txt", "/big.txt", "/short.txt", "/odd.exe", "/c.txt", "/cut.txt"]
    seeds = spark.createDataFrame([(site + p, f"source {i}", "forecast") for i, p in enumerate(paths)] + [(None, "none", "x")], "url string, source string, temporal string")
    good, bad = fetch.ingest_list(seeds, str(tmp_path), most=4000, check=local)
    found = {r["url"].removeprefix(site): (r["text"], r["source"]) for r in good.collect()}
    assert found == {"/a.txt": (PROSE.decode(), "source 0"), "/c.txt": (PROSE.decode() + " Other.", "source 6")}
    said = {(r["url"] or "").removeprefix(site): r["error"] for r in bad.collect()}
    assert set(said) == {"/none.txt", "/big.txt", "/short.txt", "/odd.exe", "/cut.txt", ""}
    assert said["/short.txt"] == "no text in it" and said["/odd.exe"] == "unsupported file type" and "4000" in said["/big.txt"]
    asked = len(Site.asked)
    assert asked == len(paths)
    fetch.ingest_list(seeds, str(tmp_path), most=4000, check=local)[0].count()
    assert len(Site.asked) == asked
    doc = good.where("source = 'source 0'").first()["doc_id"]
    assert bytes(staging.archived(spark, f"{tmp_path}/archive", doc).first()["content"]) == PROSE


def test_a_source_raster_is_fetched_once(spark, tmp_path, site):
    array = np.random.default_rng(1).integers(1, 6, (20, 20))
    geotiff.write_geotiff(table(spark, array), str(tmp_path / "made"), Grid(x0=0.0, y0=0.0, px=1.0, py=1.0), tile=16, block=32, dtype="uint8")
    with open(geotiff.files(str(tmp_path / "made"))[0], "rb") as f:
        Site.bodies["/flood.tif"] = f.read()
    links = {"hazard_flood.tif": f"{site}/flood.tif", "hazard_none": f"{site}/nothing.tif"}
    root = f"file://{tmp_path}/sources"
    for _ in range(2):
        path = fetch.source_raster(root, "hazard_flood", links.get, local)
        assert rows(geotiff.read_geotiff(spark, path)) == cells_of(array)
    assert Site.asked == ["/flood.tif"]
    with pytest.raises(fetch.NotFetched, match="404"):
        fetch.source_raster(root, "hazard_none", links.get, local)
    with pytest.raises(ValueError, match="no address"):
        fetch.source_raster(root, "hazard_other", links.get, local)
    with pytest.raises(ValueError, match="identifier"):
        fetch.source_raster(root, "../x", links.get, local)
    assert sorted(p.name for p in (tmp_path / "sources").iterdir()) == ["hazard_flood.tif"]
