"""Functions on small rows with results worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridquill.functions import geo, season, vectors
from gridquill.functions import text as tx


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
HOLE = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]


@pytest.mark.parametrize("limit", [64, 0])
@pytest.mark.parametrize("point, rings, inside", [((2, 2), [SQUARE], True), ((2, 2), [SQUARE, HOLE], False), ((0.5, 2), [SQUARE, HOLE], True), ((0, 2), [SQUARE], False), ((4, 4), [SQUARE], False), ((2, 4), [SQUARE], False), ((5, 2), [SQUARE], False), ((1, 2), [SQUARE, HOLE], False), ((2.5, 0.5), [SQUARE, [(10.0, 0.0), (11.0, 0.0), (11.0, 1.0)]], True), ((10.9, 0.5), [SQUARE, [(10.0, 0.0), (11.0, 0.0), (11.0, 1.0)]], True)])
def test_polygons(spark, monkeypatch, limit, point, rings, inside):
    monkeypatch.setattr(geo, "UNROLLED_EDGES", limit)
    assert one(spark, geo.in_polygon(F.lit(float(point[0])), F.lit(float(point[1])), rings)) is inside


def test_distances_and_areas(spark):
    n = geo.number
    assert round(one(spark, geo.haversine_km(n(0), n(0), n(0), n(1))), 4) == 111.1951
    assert one(spark, geo.haversine_km(n(5), n(5), n(5), n(5))) == 0
    ring = F.array(*(F.struct(n(x).alias("x"), n(y).alias("y")) for x, y in SQUARE))
    assert one(spark, geo.area_km2(ring)) == 16 * 111.0 * 108.0
    box = one(spark, geo.radius_box(n(10), n(60)))
    assert round(box["max_lat"] - 60, 6) == round(12 / 111, 6) and round(box["max_lon"] - 10, 6) == round(12 / 55.5, 6)
    m = one(spark, geo.mercator(n(180), n(0)))
    assert round(m["x"], 2) == 20037508.34 and abs(m["y"]) < 1e-6


def test_classes(spark):
    assert [one(spark, geo.severity(F.lit(v).cast("double"))) for v in (None, float("nan"), -3.0, 2.9, 255.0)] == [0, 0, 0, 2, 255]
    assert [one(spark, geo.risk_class(F.lit(v))) for v in (2.5, 3.5, 0.2, 9.0)] == [2, 4, 1, 5]


def test_clipping(spark):
    n = geo.number
    cut = lambda *p: one(spark, geo.clip_to_convex(*map(n, p), SQUARE))
    assert tuple(cut(-1, 2, 5, 2)) == (0.0, 2.0, 4.0, 2.0) and tuple(cut(1, 1, 2, 2)) == (1.0, 1.0, 2.0, 2.0)
    assert cut(-1, -1, -1, 5) is None and cut(5, 5, 9, 9) is None and cut(2, 2, 2, 2) is None
    turned = one(spark, geo.clip_to_convex(n(-1), n(2), n(5), n(2), SQUARE[::-1]))
    assert tuple(turned) == (0.0, 2.0, 4.0, 2.0)


def test_months(spark):
    keys = ["2024-5", "2024-05", "202405", "2024-13", "20245", "24-05", "x", "2024-00", " 2024-05"]
    assert [one(spark, tx.month_key(F.lit(k))) for k in keys] == ["2024-05"] * 3 + [None] * 6
    assert one(spark, tx.month_number(F.lit("2024-05"))) == 2024 * 12 + 5
    assert [one(spark, tx.layer_month(F.lit(k))) for k in ("Global_Synthesis_202405", "Global_Synthesis_2024", "x")] == ["2024-05", None, None]
    assert [one(spark, tx.month_of_title(F.lit(k))) for k in ("May", "december", "anf")] == ["05", "12", None]


def test_names(spark):
    assert one(spark, tx.slug(F.lit("  Siem Reap, KH! "))) == "siem-reap-kh" and one(spark, tx.slug(F.lit("!!"))) == "_"
    assert one(spark, tx.canonical_name(F.lit("Siem Reap, Cambodia"))) == "Siem Reap"
    assert [one(spark, tx.share_file_id(F.lit(u))) for u in ("https://f/d/abc/view", "https://f/uc?id=xyz&a=1", "https://f/")] == ["abc", "xyz", None]
    assert one(spark, tx.full_match(F.lit("ab1"), "[a-z]+")) is False
    assert one(spark, tx.content_id(F.lit("abc"))) == "a9993e364706816a"


def test_citations(spark):
    cited = lambda s: one(spark, tx.cited_numbers(F.lit(s)))
    assert cited("a [3] b [1, 2] c [4–6]") == [1, 2, 3, 4, 5, 6]
    assert cited("[2015-16] [0] [1999] [x] none") == [0] and len(cited("[1-900]")) == 51 and cited("") == []
    assert one(spark, tx.number_tokens(tx.without_citations(F.lit("1,200 tonnes [3] and 4.5 of 1200")))) == ["1200", "4.5"]


def test_chunks(spark):
    made = lambda s, n: one(spark, tx.chunks(F.lit(s), n))
    assert made("one\n\ntwo\n \nthree", 100) == ["one\n\ntwo\n\nthree"] and made("one\n\ntwo", 5) == ["one", "two"] and made("  ", 10) == []
    text = "\n\n".join(f"Sentence {i} of some length. " * 40 for i in range(6))
    found = made(text, 500)
    assert all(len(c) <= 500 for c in found) and "".join(found).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
    assert made("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert made("aaaaaaaa. bbbbbbbbbb", 12) == ["aaaaaaaa.", "bbbbbbbbbb"] and made("aa. bbbbbbbbbbbbbbbb", 12) == ["aa. bbbbbbbb", "bbbbbbbb"]


def test_seasons(spark):
    kinds = [one(spark, season.phase(F.lit(m), F.array(F.lit(11), F.lit(12)), F.array(F.lit(4), F.lit(6)))) for m in (11, 2, 5, 8)]
    assert kinds == ["planting", "growing", "harvest", "off-season"]
    assert [one(spark, season.in_window(F.lit(m), F.lit(11), F.lit(2))) for m in (11, 1, 2, 3)] == [True, True, True, False]
    assert [one(spark, season.valid_window(F.array(*map(F.lit, w)))) for w in ([1, 12], [0, 3], [1, 2, 3])] == [True, False, False]
    assert one(spark, season.window_label(F.array(F.lit(3), F.lit(5)))) == "Mar–May"


def test_vectors(spark):
    a, b, zero = (F.array(*map(F.lit, v)) for v in ([3.0, 4.0], [4.0, -3.0], [0.0, 0.0]))
    assert one(spark, vectors.dot(a, b)) == 0 and one(spark, vectors.norm(a)) == 5 and one(spark, vectors.normalised(a)) == [0.6, 0.8] and one(spark, vectors.cosine(a, zero)) == 0
