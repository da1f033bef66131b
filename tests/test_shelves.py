"""The stored library of the ingest stream: once each, only its own buckets read, the same after repeated batches."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquill.plans import session
from gridquill.streaming import jobs, shelves
from tests.conftest import DATA, assert_same

FEW = shelves.Shelves(8, 1 << 12, 5)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, extra string").coalesce(1)


def held(spark, path):
    return sorted((r["row_id"], r["text"]) for r in shelves.library(spark, path).collect())


def test_each_text_once_whatever_the_batches(spark, tmp_path):
    r = random.Random(1)
    batches = [[(100 * b + i, r.choice(["x", "y", None, "", f"text {r.randrange(120)}"]), "e") for i in range(40)] for b in range(5)]
    path = str(tmp_path / "library")
    seen, expected = set(), []
    for n, rows in enumerate(batches):
        shelves.add_batch(docs(spark, rows), n, path, shelves=FEW)
        for doc, text, _ in rows:
            if text not in seen:
                seen.add(text)
                expected.append((doc, text))
    assert held(spark, path) == sorted(expected)
    shelves.add_batch(docs(spark, batches[4]), 4, path, shelves=FEW)  # a batch that comes again, as after a restart
    assert held(spark, path) == sorted(expected)
    shelves.drop_old_filters(spark, path)
    assert sorted(x.name for x in (tmp_path / "library.filters").iterdir()) == ["batch=3", "batch=4"]
    shelves.add_batch(docs(spark, batches[0]), 5, path, shelves=FEW)
    assert held(spark, path) == sorted(expected)


def test_row_ids_are_the_smallest_in_whatever_order_batches_come(spark, tmp_path):
    path = str(tmp_path / "library")
    for n, rows in enumerate(([(7, "x", "e"), (8, None, "e")], [(5, "x", "e"), (9, "y", "e")], [(3, None, "e"), (4, "y", "e")], [(6, "x", "e")], [(2, "x", "e")])):
        shelves.add_batch(docs(spark, rows), n, path, shelves=FEW)
    assert held(spark, path) == sorted([(2, "x"), (3, None), (4, "y")])


def test_only_buckets_that_may_have_an_id_are_read(spark, tmp_path):
    path = str(tmp_path / "library")
    shelves.add_batch(docs(spark, [(i, f"text {i}", "e") for i in range(200)]), 0, path, shelves=shelves.Shelves(16, 1 << 16, 7))
    content = spark.createDataFrame([("text 7",)], "text string").select(shelves.tx.content_id(F.col("text")).alias("content_id"))
    (mine,) = content.select(shelves.bucket_of(F.col("content_id"), 16)).first()
    for f in (tmp_path / "library" / "batch=0").glob("bucket=*/*.parquet"):
        if f.parent.name != f"bucket={mine}":
            f.write_bytes(b"not to be read")
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    shelves.add_batch(docs(spark, [(1000, "text 7", "e"), (1001, "quite new", "e"), (1002, "text 7", "e")]), 1, path, shelves=shelves.Shelves(16, 1 << 16, 7))
    added = spark.read.parquet(f"{path}/batch=1").collect()
    assert [(r["row_id"], r["text"]) for r in added] == [(1001, "quite new")]


def test_filters_have_no_false_negatives_and_few_false_positives():
    s = shelves.Shelves(1, 1 << 16, 7)
    r = np.random.default_rng(2)
    known, others = r.integers(-(2**63), 2**63 - 1, 6000), r.integers(-(2**63), 2**63 - 1, 20_000)
    bits = np.zeros(s.bits, dtype=bool)
    bits[shelves.places(known, s).ravel()] = True
    assert bits[shelves.places(known, s)].all()
    assert bits[shelves.places(others, s)].all(axis=1).mean() < 0.02


def test_empty_batches_and_libraries(spark, tmp_path):
    path = str(tmp_path / "library")
    assert shelves.library(spark, path).count() == 0
    shelves.add_batch(docs(spark, []), 0, path, shelves=FEW)
    shelves.add_batch(docs(spark, [(1, None, "e"), (2, None, "e")]), 1, path, shelves=FEW)
    assert held(spark, path) == [(1, None)]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, path, marks = tmp_path / "in", str(tmp_path / "library"), str(tmp_path / "marks")
    for n, rows in enumerate(([(1, "a", "e"), (2, "b", "e")], [(3, "b", "e"), (4, "c", "e")], [(5, "a", "e"), (6, "d", "e")])):
        docs(spark, rows).write.mode("append").parquet(str(source))
        stream = jobs.stream_of(spark, str(source), "doc_id long, text string, extra string")
        jobs.dedupe_ingest(stream, path, marks, shelves=FEW).awaitTermination()
        assert len(held(spark, path)) == n + 2
    assert [x[1] for x in held(spark, path)] == ["a", "b", "c", "d"]


@pytest.mark.parametrize("name", ["stream_dedupe_ingest"])
def test_query(spark, name):
    assert_same(session.QUERIES[name](spark, DATA), session.ORACLE_SQL[name])
