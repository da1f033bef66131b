"""The index of monthly layers as a stream: each month once, also across restarts."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from gridquill.sources import months


class Index(BaseHTTPRequestHandler):
    layers: list[dict] = []
    busy = 0

    def do_GET(self):
        status = 503 if Index.busy > 0 else 200
        Index.busy -= 1
        self.send_response(status)
        self.end_headers()
        if status == 200:
            self.wfile.write(json.dumps({"layers": Index.layers}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def url():
    server = HTTPServer(("127.0.0.1", 0), Index)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/index"
    server.shutdown()


def layer(i, month):
    return {"id": i, "name": f"Global_Synthesis_{month}"}


def run(spark, url, out, marks):
    query = spark.readStream.format("month_layers").options(url=url, backoff_s=0.01).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted(tuple(r) for r in spark.read.schema(months.SCHEMA).parquet(out).collect())


def test_each_month_once_across_restarts(spark, tmp_path, url):
    months.register(spark)
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    Index.layers = [layer(1, "202402"), layer(0, "202401"), {"id": 7, "name": "Rivers"}, {"id": 8, "name": "Global_Synthesis_202413"}, {"name": "Global_Synthesis_202403"}]
    Index.busy = 1
    first = [("2024-01", 0, "Global_Synthesis_202401"), ("2024-02", 1, "Global_Synthesis_202402")]
    assert run(spark, url, out, marks) == first
    assert run(spark, url, out, marks) == first  # nothing new
    Index.layers += [layer(3, "202404"), layer(2, "202403"), layer(4, "202404")]
    assert run(spark, url, out, marks) == [*first, ("2024-03", 2, "Global_Synthesis_202403"), ("2024-04", 4, "Global_Synthesis_202404")]
    Index.layers = []
    assert len(run(spark, url, out, marks)) == 4
    assert spark.read.format("month_layers").option("url", url).load().count() == 0


def test_a_batch_that_runs_again_has_the_same_months(url):
    Index.layers, Index.busy = [layer(0, "202401"), layer(1, "202402"), layer(2, "202403")], 0
    reader = months.MonthStream({"url": url})
    assert reader.initialOffset() == {"month": ""}
    rows, end = reader.read({"month": "2024-01"})
    assert [r[0] for r in rows] == ["2024-02", "2024-03"] and end == {"month": "2024-03"}
    Index.layers.append(layer(3, "202404"))
    assert [r[0] for r in reader.readBetweenOffsets({"month": "2024-01"}, end)] == ["2024-02", "2024-03"]
    assert reader.read({"month": "2024-04"}) and reader.read({"month": "2024-04"})[1] == {"month": "2024-04"}
