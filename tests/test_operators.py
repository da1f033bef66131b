"""Operators on small tables with results worked out by hand."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gridquill.operators import conditions, contracts, evidence, overlay, planning, raster, retrieval, session
from gridquill.sources import catalog
from gridquill.sources.tables import Grid

GRID = Grid(x0=0.0, y0=0.01, px=0.001, py=0.001, width=10)
AREA = [[(0.0, 0.0), (0.01, 0.0), (0.01, 0.01), (0.0, 0.01)]]


def flood(spark):
    """Ten by ten cells, 3 in the left half."""
    return spark.createDataFrame([(r, c, 3.0 if c < 5 else 0.0) for r in range(10) for c in range(10)], "row int, col int, value double")


def places(spark):
    rows = [("hospitals", 0.002, 0.005), ("hospitals", 0.008, 0.005), ("schools", 0.001, 0.001), ("schools", 0.006, 0.002), ("schools", 0.007, 0.009), ("buildings", 0.003, 0.003), ("buildings", 0.5, 0.5), ("buildings", None, 0.003)]
    return spark.createDataFrame([(la, i, f"n{i}", x, y) for i, (la, x, y) in enumerate(rows)], "layer string, fid long, name string, lon double, lat double")


def grid(spark, rows):
    return spark.createDataFrame([(r, c, float(v)) for r, line in enumerate(rows) for c, v in enumerate(line)], "row int, col int, value double")


def values(df):
    return {(r["row"], r["col"]): r["value"] for r in df.collect()}


def test_counts(spark):
    counts = {r["layer"]: r["n"] for r in overlay.count_features(places(spark), AREA, catalog.COUNTABLE).collect()}
    assert counts == {"hospitals": 2, "schools": 3, "buildings": 1}
    found = overlay.count_in_hazard(places(spark), flood(spark), GRID, AREA, catalog.COUNTABLE).collect()
    assert len(found) == 15 and {r["layer"]: r["n"] for r in found if r["severity"] == 3} == {"hospitals": 1, "schools": 1, "buildings": 1}
    assert {r["n_exposed"] for r in overlay.count_in_hazard(places(spark), flood(spark), GRID, AREA, catalog.COUNTABLE, 4).collect()} == {0}
    with pytest.raises(Exception, match="a class above 5"):
        overlay.count_in_hazard(places(spark), flood(spark).withColumn("value", F.lit(6.0)), GRID, AREA, catalog.COUNTABLE).collect()
    with pytest.raises(ValueError):
        overlay.require_countable(["roads"], catalog.COUNTABLE)


def test_roads(spark):
    road = spark.createDataFrame([(1, i, x, 0.005) for i, x in enumerate((0.001, 0.003, 0.0049, 0.007, 0.009))] + [(2, 0, 0.001, 0.001)], "fid long, idx int, lon double, lat double")
    found = {r["severity"]: r for r in overlay.roads_in_hazard(road, flood(spark), GRID, AREA).collect()}
    assert set(found) == {1, 2, 3, 4, 5} and round(found[3]["km"], 3) == 0.434 and found[3]["length_km"] == 0.4 and found[3]["total_km"] == 0.9 and found[1]["km"] == 0
    assert overlay.road_max_severity(road, flood(spark), GRID).collect() == [(1, 3)]
    clipped = overlay.clip_roads(road, [(0.002, 0.0), (0.008, 0.0), (0.008, 0.01), (0.002, 0.01)]).agg(F.count("*"), F.round(F.sum(F.col("x2") - F.col("x1")), 9)).first()
    assert tuple(clipped) == (4, 0.006)


def test_combining(spark):
    vulns = lambda a, b: {"a": grid(spark, [[a]]), "b": grid(spark, [[b]])}
    half = {"a": 0.5, "b": 0.5}
    risk = lambda h, a, b, w=half: values(raster.combine_risk(grid(spark, [[h]]), vulns(a, b), w))[(0, 0)]
    assert risk(4, 3, 5) == 3 and risk(4, 0, 5) == 4 and risk(0, 3, 5) == 0 and risk(4, 0, 0) == 0 and risk(4, 3, 5, {"a": 0.0, "b": 0.0}) == 0
    assert risk(5, 1, 5, {"a": 0.1, "b": 0.9}) > risk(5, 1, 5, {"a": 0.9, "b": 0.1})
    with pytest.raises(ValueError):
        raster.combine_risk(grid(spark, [[1]]), vulns(1, 1), {"a": 1.0})


def test_agreement(spark):
    a, b = grid(spark, [[1, 2, 3], [0, 4, 5]]), grid(spark, [[5, 0, 0], [0, 0, 0]])
    assert tuple(raster.agreement(raster.compare(a, a)).first()) == (5, 100.0, 100.0, 0.0)
    assert tuple(raster.agreement(raster.compare(grid(spark, [[5]]), grid(spark, [[1]]))).first()) == (1, 0.0, 0.0, 4.0)
    assert raster.confusion(raster.compare(a, b)).agg(F.sum("n")).first()[0] == 5
    assert tuple(raster.agreement(raster.compare(a.limit(0), a.limit(0))).first()) == (0, None, None, None)
    assert raster.weight_candidates(1) == [[1.0]] and raster.weight_candidates(3)[0] == [0.333] * 3 and raster.weight_candidates(3)[2] == [0.1, 0.8, 0.1]


def test_best_weights(spark):
    hazard, a, b = grid(spark, [[5, 5, 5, 5]]), grid(spark, [[1, 2, 3, 4]]), grid(spark, [[5, 5, 1, 1]])
    found = raster.best_weights(hazard, {"a": a, "b": b}, a).collect()
    best = [r for r in found if r["best"]]
    assert len(found) == 3 and [(r["candidate"], r["exact_pct"], r["within1_pct"]) for r in best] == [(1, 25.0, 100.0)]


def test_stats_and_regrid(spark):
    cells = grid(spark, [[0, 1, float("nan")], [2, 2, 9]])
    assert tuple(raster.stats(cells, nodata=9).first()) == (4, 0.0, 2.0, 3) and tuple(raster.stats(cells.limit(0)).first()) == (0, None, None, 0)
    fine, coarse = Grid(x0=0.0, y0=0.0, px=1.0, py=1.0, width=4), Grid(x0=0.0, y0=0.0, px=2.0, py=2.0, width=2)
    found = values(raster.regrid_nearest(grid(spark, [[0] * 4] * 4), fine, grid(spark, [[1, 2]]), coarse))
    assert [found[(r, c)] for r, c in ((0, 0), (1, 1), (0, 2), (1, 3), (2, 0))] == [1, 1, 2, 2, 0]


def test_dissolving(spark):
    cells = grid(spark, [[1, 1, 2], [1, 1, 0], [0, 2, 2]])
    assert sorted(map(tuple, raster.dissolve(cells).collect())) == [(1, 0, 1, 0, 1), (2, 0, 0, 2, 2), (2, 2, 2, 1, 2)]
    areas = {r["value"]: (r["n_parts"], round(r["km2"] / (111 * 108), 9)) for r in raster.dissolved_area(cells, Grid(px=1.0, py=1.0)).collect()}
    assert areas == {1: (1, 4.0), 2: (2, 3.0)}


def test_contracts(spark):
    seen = [("hazard_flood", "int8", 0.0, 5.0, None, 4326, 0.00089831528412), ("hazard_storm", "x", 0.0, 6.0, 7.0, 3857, 1.0), ("risk_flood", "uint8", None, None, 0.0, 4326, 1.0), ("global_pc_h100glob", "uint32", 0.0, 20000.0, 0.0, 4326, 1.0), ("new", "int8", 0.0, 1.0, None, 4326, 1.0)]
    found = {r["layer"]: r["mismatches"] for r in contracts.check_contracts(spark.createDataFrame(seen, contracts.OBSERVED), catalog.contracts(spark)).collect()}
    assert found["hazard_flood"] == [] and found["global_pc_h100glob"] == [] and found["new"] == ["no contract for new"]
    assert found["hazard_storm"] == ["max 6 > declared valid_max 5 (declared units=class)", "crs EPSG:3857 != declared EPSG:4326"]
    assert found["risk_flood"] == ["nodata 0 != declared none"]


def test_gate(spark):
    good = ("g", "1-5", 10, 1, 4326, 100.0, 10.0, 101.0, 11.0, 6, 6, 1.0, 5.0, 5)
    rows = [good, ("zero", *good[1:11], 0.0, 5.0, 5), ("two", "1-5", 10, 2, *good[4:]), ("crs", "1-5", 10, 1, None, *good[5:]), ("far", "0-5", 10, 1, 3857, 10.0, 10.0, 11.0, 11.0, 6, 6, 0.0, 5.0, 200), ("flat", "1-5", 10, 1, 4326, 100.0, 10.0, 100.0, 11.0, 6, 6, 1.0, 5.0, 5), ("nan", "1-5", 10, 1, 4326, float("nan"), *good[6:])]
    found = {r["layer"]: r for r in contracts.gate_uploads(spark.createDataFrame(rows, contracts.UPLOADED)).collect()}
    assert found["g"]["ok"] and found["g"]["warns"] == [] and found["zero"]["fails"] == ["min 0 < 1"] and found["two"]["fails"] == ["2 bands; a single-band raster is needed"]
    assert found["crs"]["fails"] == ["no CRS"] and found["far"]["ok"] and len(found["far"]["warns"]) == 3 and found["flat"]["fails"] == ["degenerate bounds"] and found["nan"]["fails"] == ["non-finite bounds"]


def test_plans(spark):
    every = [x for h in catalog.HAZARDS for x in h[1:3]] + list(catalog.WEIGHT_LAYERS)

    def plan(asked, level=None, lacking=()):
        requests = spark.createDataFrame([(1, asked, level)], "request_id int, asked string, wanted_level int")
        available = spark.createDataFrame([(x,) for x in every if x not in lacking], "layer string")
        r = planning.layer_plans(requests, catalog.hazards(spark), catalog.recipes(spark), available).first()
        return r["level"], r["layer"], r["oracle"], r["missing"]

    assert plan("flood") == (1, "risk_flood", None, []) and plan("flood", 2) == (2, "risk_flood_l2", "risk_flood", [])
    assert plan("landslides", 2) == (2, "risk_landslide_l2", "risk_landslide", []) and plan("risk_landslide_l2", 2)[0] == 2
    assert plan("flood", None, ("risk_flood",)) == (2, "risk_flood_l2", None, []) and plan("flood", 1, ("risk_flood",)) == (None, None, None, ["no risk_flood"])
    assert plan("volcano") == (None, None, None, ["unknown hazard 'volcano'"])
    assert plan("fire", None, ("risk_fire", "hazard_fire", "vulnerability_reclass_road")) == (None, None, None, ["hazard_fire", "vulnerability_reclass_road"])
    assert planning.needed_layers("roads_in_hazard") == ["roads"] and planning.needed_layers("count_features", "schools") == ["schools"]
    with pytest.raises(ValueError):
        planning.needed_layers("nothing")


CONDITIONS = [("2024-05", "Kenya", "East", "Maize 1", "Watch", "Dry"), ("2024-05", "Kenya", "West", "Maize 1", "Favourable", ""), ("2024-05", "Zambia", "South", "Winter Wheat", " ", "Wet"), ("2024-03", "Kenya", "East", "Rice 1", "Poor", "Dry")]


def test_conditions(spark):
    table = spark.createDataFrame(CONDITIONS, "month string, country string, region string, crop string, conditions string, drivers string")
    may = conditions.records(table, "2024-05")
    assert {(r["conditions"], r["n"]) for r in conditions.summary(may).collect()} == {("Watch", 1), ("Favourable", 1), ("Out of season", 1)}
    assert conditions.records(table, "2024-05", place=" kenya ").count() == 2 and conditions.records(table, place="SOUTH").count() == 1 and conditions.records(table, place=" ").count() == 4
    assert conditions.receipt(["Maize 1"], "O'Brien") == "Crop IN ('Maize 1') AND (UPPER(Country) = UPPER('O''Brien') OR UPPER(Region) = UPPER('O''Brien'))" and conditions.receipt() == "1=1"
    words = spark.createDataFrame([("maize",), ("WINTER WHEAT",), ("1",), ("soy",)], "asked string")
    crops = {}
    for r in conditions.resolve_crops(words, conditions.distinct_crops(table)).collect():
        crops.setdefault(r["asked"], []).append(r["crop"])
    assert crops == {"maize": ["Maize 1"], "WINTER WHEAT": ["Winter Wheat"], "1": ["Maize 1", "Rice 1"], "soy": [None]}
    months = spark.createDataFrame([("2024-04",), (None,), ("202405",), ("nope",)], "asked string")
    found = {r["asked"]: (r["month"], r["nearest"], r["status"]) for r in conditions.resolve_months(months, conditions.months(table)).collect()}
    assert found == {"2024-04": (None, "2024-03", "missing"), None: ("2024-05", None, "latest"), "202405": ("2024-05", None, "published"), "nope": (None, None, "invalid")}
    assert conditions.driver_rollup(may, "month").first()["drivers"] == "Dry, Wet"
    many = spark.range(14).select(F.lit("m").alias("month"), F.lit("c").alias("country"), F.format_string("r%02d", "id").alias("region"), F.lit("k").alias("crop"), F.lit("Watch").alias("conditions"), F.lit("").alias("drivers"))
    listed = conditions.region_listing(many, "month").first()["regions"]
    assert listed.startswith("r00: Watch; r01") and listed.endswith("r11: Watch (first 12 of 14 rows)") and conditions.driver_rollup(many, "month").first()["drivers"] == "none stated"


def test_search(spark):
    rows = [("a:0", "a", "near", [1.0, 0.0], "forecast", ["Kenya"]), ("b:0", "b", "nearer", [0.9, 0.1], "retrospective", ["Kenya", "Chad"]), ("c:0", "c", "far", [0.0, 1.0], "forecast", ["Mali"]), ("d:0", "d", "null", [0.7, 0.7], None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, embedding array<double>, temporal string, countries array<string>")
    ids = lambda **k: [r["chunk_id"] for r in retrieval.search(chunks, [1.0, 0.0], **k).collect()]
    assert ids(k=2) == ["a:0", "b:0"] and ids(k=1, temporal="Retrospective") == ["b:0"] and ids(k=0) == [] and ids(k=9, floor=0.9) == ["a:0", "b:0"]
    assert ids(k=9, countries=["CHAD", "mali"]) == ["b:0", "c:0"] and ids(k=9, temporal=["", None]) == ids(k=9)
    report = lambda floor, **f: retrieval.search_report(chunks, [1.0, 0.0], floor=floor, **f).first()["note"]
    assert report(0.5) is None and report(2.0) == "no document is relevant enough (floor 2)" and report(0.5, temporal="x") == "no document matches the filters"
    assert retrieval.search_report(chunks.limit(0), [1.0, 0.0]).first()["note"] == "the library is empty"
    assert retrieval.count(chunks, temporal="forecast").first()["n"] == 2


def test_ingest(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "row_id long, doc_id string, text string, source string, temporal string")
    stored = retrieval.ingest(rows((1, "x", "X", "s", "f"), (2, "y", "Y", "s", "f"), (3, "x", "X", "t", "f")))
    assert {r["doc_id"]: (r["first_row"], r["rows"], r["source"], r["status"]) for r in stored.collect()} == {"x": (1, 2, "t", "new"), "y": (2, 1, "s", "new")}
    found = retrieval.ingest(rows((4, "x", "X", "t", "f"), (5, "y", "Y", "u", "f"), (6, "z", "Z", "s", "f")), stored)
    assert {r["doc_id"]: (r["source"], r["status"]) for r in found.collect()} == {"x": ("t", "unchanged"), "y": ("u", "updated"), "z": ("s", "new")}
    assert retrieval.ingest(rows((7, "z", "Z", "s", "f")), stored).where("status = 'kept'").count() == 2


def test_grounding(spark):
    body = "\n\n".join(f"{s}\nSome 12 words [1]." for s in catalog.SECTIONS)
    drafts = [(1, body), (2, body + " And [9]."), (3, body + "\n\nno citation here"), (4, "plain 77"), (5, body + "\n\n## Sources\nx [1]"), (6, None)]
    table = spark.createDataFrame(drafts, "draft_id int, draft string").withColumns({"valid": F.array(F.lit(1), F.lit(2)), "numbers": F.array(F.lit("12"))})
    found = {r["draft_id"]: r for r in evidence.check_drafts(table).collect()}
    assert [found[i]["passed"] for i in range(1, 7)] == [True, False, False, False, False, False]
    assert found[2]["phantom"] == [9] and found[3]["uncited"] == ["no citation here"] and found[4]["unverified"] == ["77"] and found[5]["own_sources"] and len(found[6]["missing_sections"]) == 4


def test_claims_and_graph(spark):
    text = "before [1]\n\n## One\nfirst [2]\n\nsecond [2, 3]\n\n## Two\n\n## Sources\nx [9]"
    claimed = evidence.claims(spark.createDataFrame([(1, text), (2, None)], "draft_id int, draft string"))
    assert [(r["claim"], r["section"], r["text"], r["cites"]) for r in claimed.orderBy("claim").collect()] == [(0, "Preamble", "before", [1]), (1, "One", "first", [2]), (2, "One", "second", [2, 3])]
    edges = evidence.claim_edges(claimed).select("src", "dst").unionByName(spark.createDataFrame([("section-One", "cite-3")], "src string, dst string"))
    reach = lambda start, forward=True: {r["node"] for r in evidence.reachable(edges, spark.createDataFrame([(start,)], "start string"), forward, 9).collect()}
    assert reach("cite-3") == {"cite-3", "claim-2", "section-One"} and "cite-2" in reach("section-One", False)


def test_reachable_beyond_toys(spark):
    """A ladder with very many paths, a long chain, a cycle and a null."""
    ladder = [(f"{a}{i}", f"{b}{i + 1}") for i in range(14) for a in "xy" for b in "xy"]
    chain = [(f"c{i}", f"c{i + 1}") for i in range(1000)]
    cycle = [("p", "q"), ("q", "r"), ("r", "p"), ("r", None)]
    edges = spark.createDataFrame(ladder + chain + cycle, "src string, dst string")
    starts = spark.createDataFrame([("x0",), ("c0",), ("q",), ("nowhere",), (None,)], "start string")
    found = evidence.reachable(edges, starts)
    want = {("x0", "x0"), *(("x0", f"{a}{i}") for i in range(1, 15) for a in "xy"), *(("c0", f"c{i}") for i in range(1001)), *(("q", n) for n in "pqr"), ("nowhere", "nowhere")}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want
    back = {r["node"] for r in evidence.reachable(edges, spark.createDataFrame([("x14",)], "start string"), False, 2).collect()}
    assert back == {"x14", "x13", "y13", "x12", "y12"}


def test_search_many_in_blocks(spark):
    vectors = spark.range(60).selectExpr("id as chunk_id", "transform(sequence(1, 4), i -> cast(sin(id * i) as float)) as embedding")
    queries = vectors.where("chunk_id % 4 = 0").selectExpr("chunk_id as query_id", "embedding as vector")
    one, many = (sorted(map(tuple, retrieval.search_many(vectors, queries, 3, block=b).collect())) for b in (512, 4))
    assert one == many and len(one) == 45


def test_clip_to_any_polygon(spark):
    area = [[(0, 0), (10, 0), (10, 10), (5, 2), (0, 10)], [(1, 0.5), (2, 0.5), (1.5, 1)]]
    rows = [(1, 0, -5.0, 5.0), (1, 1, 15.0, 5.0), (2, 0, 0.5, 0.75), (2, 1, 4.0, 0.75), (3, 0, 20.0, 20.0), (3, 1, 21.0, 21.0), (4, 0, 5.0, 1.0), (4, 1, 5.0, 1.0)]
    vertices = spark.createDataFrame(rows, "fid int, idx int, lon double, lat double")
    found = sorted((r["fid"], *(round(r[c], 6) for c in ("x1", "x2"))) for r in overlay.clip_roads_to_area(vertices, area).collect())
    assert found == [(1, 0.0, 3.125), (1, 6.875, 10.0), (2, 0.5, 1.25), (2, 1.75, 4.0)]


def test_dispatch(spark):
    operations = {"three": lambda n: spark.range(n), "broken": lambda: spark.range(1).selectExpr("raise_error('no cells') as x")}
    found, why = planning.dispatch(operations, "three", n=3)
    assert found.count() == 3 and why is None
    for name, arguments, said in (("four", {}, "unknown operation four"), ("broken", {}, "no cells"), ("three", {"m": 1}, "unexpected|missing")):
        found, why = planning.dispatch(operations, name, **arguments)
        assert found is None and why.startswith("No data for that request: ") and re.search(said, why)
    found, why = planning.dispatch(operations, "three", most=2, n=3)
    assert found is None and "more than 2 rows" in why
    with pytest.raises(ZeroDivisionError):  # a bug is no refusal
        planning.dispatch({"bug": lambda: 1 // 0}, "bug")


def test_near_features(spark):
    r = random.Random(3)
    points = [(i, 1, f"p{i}", r.uniform(-1, 1), r.uniform(-1, 1), None) for i in range(200)]
    lines = [(1000 + i, 2, f"l{i}", 0.0, 0.0, [(r.uniform(-1, 1), r.uniform(-1, 1)) for _ in range(r.randint(2, 4))]) for i in range(30)]
    features = spark.createDataFrame([(o, "x", f, n, 1, x, y, line) for f, o, n, x, y, line in points + lines], "ord int, layer string, fid long, name string, severity int, lon double, lat double, line array<struct<lon: double, lat: double>>")
    cursors = [(i, r.uniform(-1, 1), r.uniform(-1, 1)) for i in range(80)]

    def distance(px, py, line):
        best = 9e9
        for (x1, y1), (x2, y2) in zip(line, line[1:]) if len(line) > 1 else [(line[0], line[0])]:
            d2 = (x2 - x1) ** 2 + (y2 - y1) ** 2
            t = min(max(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / d2, 0), 1) if d2 else 0
            best = min(best, math.hypot(px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1)))
        return best

    for reach in (0.03, 0.2):
        found = overlay.near_features(spark.createDataFrame(cursors, "cursor_id long, lon double, lat double"), features, reach)
        want = sorted((c, f) for c, px, py in cursors for f, _, _, x, y, line in points + lines if distance(px, py, line or [(x, y)]) <= reach)
        assert sorted((q["cursor_id"], q["fid"]) for q in found.collect()) == want


def test_a_second_search_by_the_name_that_was_recognised(spark):
    schema = "query string, ord long, name string, class string, type string, gtype string, km2 double, lon double, lat double"
    rows = [("Batambang", 0, "Battambang, X", "place", "city", "Point", None, 103.0, 13.0), ("Town", 0, "town, X", "place", "town", "Point", None, 1.0, 2.0), ("Big", 0, "Big, X", "boundary", "administrative", "Polygon", 9000.0, 5.0, 5.0), ("Big", 1, "Bigger place", "place", "city", "Point", None, 6.0, 6.0), ("Lost", 0, "Elsewhere, X", "place", "village", "Point", None, 7.0, 7.0)]
    second = [("Battambang", 0, "Battambang, Y", "boundary", "administrative", "Polygon", 120.0, 103.0, 13.0), ("Bigger place", 0, "Bigger place, Y", "place", "city", "Point", None, 60.0, 6.0)]
    asked = []

    def search(names):
        asked.extend(sorted(r["query"] for r in names.collect()))
        return spark.createDataFrame(second, schema).join(names, "query", "left_semi")

    found = {r["query"]: r for r in planning.areas_with_retry(spark.createDataFrame(rows, schema), search).collect()}
    assert asked == ["Battambang", "Bigger place", "Elsewhere"]
    assert (found["Batambang"]["name"], found["Batambang"]["km2"], found["Batambang"]["corrected"]) == ("Battambang", 120.0, "Battambang")
    assert (found["Big"]["how"], found["Big"]["corrected"], round(found["Big"]["min_lon"])) == ("radius_box", "Bigger place", 60)
    assert (found["Town"]["corrected"], found["Lost"]["corrected"], found["Lost"]["name"]) == (None, None, "Elsewhere")


def test_evidence(spark):
    docs = spark.createDataFrame([(2, "document", "forecast", "b"), (1, "document", "retrospective", "a")], "rank int, kind string, temporal string, doc_id string")
    cal = spark.createDataFrame([(1, "calendar")], "rank int, kind string")
    rows = evidence.union([docs, cal])
    assert [(r["n"], r["kind"], r["doc_id"]) for r in rows.orderBy("n").collect()] == [(1, "document", "a"), (2, "document", "b"), (3, "calendar", None)]
    assert tuple(evidence.stats(rows).first()) == (1, 1, False, True, True) and evidence.stats(evidence.union([cal])).first()["is_evidence"] is False
    assert [(r["feed"], r["cites"], r["empty"]) for r in evidence.feeds(rows).orderBy("ord").collect()] == [("forecast", [2], False), ("retrospective", [1], False), ("conditions", [], True), ("calendar", [3], False)]
    assert [r["gap"] for r in evidence.gaps(rows, {"conditions": "no conditions"}).collect()] == ["no conditions"]


def test_sessions(spark):
    rows = spark.createDataFrame([("a", 0, "user", "q1"), ("a", 1, "assistant", "r1"), ("a", 2, "user", "q2"), ("b", 0, "assistant", "hi")], "thread_id string, turn long, role string, content string")
    assert session.last_user_message(rows).collect() == [("a", 2, "q2")]
    assert {r["thread_id"]: (r["answer"], r["question"]) for r in session.latest_answer(rows).collect()} == {"a": ("r1", "q1"), "b": ("hi", None)}
    sent = spark.createDataFrame([("a", 0, None), ("a", 1, "x"), ("a", 2, None), ("b", 0, None)], "thread_id string, turn long, area string")
    assert [r["effective"] for r in session.persisted(sent, "area").orderBy("thread_id", "turn").collect()] == [None, "x", "x", None]
    calls = spark.createDataFrame([(10, None), (None, 5)], "tokens_in int, tokens_out int")
    assert tuple(session.usage(calls, 0.1, 0.2).first()) == (2, 10, 5, 2.0)
    says = spark.createDataFrame([("it is 1,500 now", 1500), ("15", 5), (None, 5), ("x", 5)], "answer string, n int")
    assert [r[0] for r in says.select(session.grounded(F.col("answer"), F.col("n"))).collect()] == [True, True, False, False]


def test_requests(spark):
    from gridquill.operators import menus

    assert menus.area_rings([0, 1, 2, 3]) == [[(0.0, 1.0), (2.0, 1.0), (2.0, 3.0), (0.0, 3.0)]]
    assert menus.area_rings({"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6]]]]})[1][0] == (5.0, 5.0)
    for wrong in ([1, 2], {"type": "Point", "coordinates": [1, 2]}):
        with pytest.raises(ValueError):
            menus.area_rings(wrong)
    rows = spark.createDataFrame([('{"crop": null, "focus": " "}',), ("[]",), ('{"crop',), ("5",), (None,)], "raw string")
    found = [r[0] for r in rows.select(menus.parsed_arguments(F.col("raw"), F.lit(" why "))).collect()]
    assert tuple(found[0]) == ("", "", "why") and found[1:] == [None] * 4
    kinds = spark.createDataFrame([("MultiPolygon",), ("Polygon",)], "geom_type string")
    assert menus.layer_kinds(kinds).first()["kind"] == "Polygon" and menus.layer_kinds(kinds.unionByName(kinds.limit(1).withColumn("geom_type", F.lit("Point")))).first()["kind"] == "Vector"
    listed = spark.createDataFrame([(0, "a", " x ", None), (1, "b", None, True)], "ord int, layer string, description string, internal boolean")
    assert menus.menu(menus.visible_catalogue(listed)).first()["menu"] == "- a: x" and menus.menu(menus.visible_catalogue(listed.limit(0))).first()["menu"] == menus.NO_LAYERS
