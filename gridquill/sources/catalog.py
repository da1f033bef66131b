"""Layers, names, weights, legends, contracts and the crop calendar as small literal tables.

These are a few dozen rows that describe layers; data of layers is never here.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Hazard name, hazard layer, risk layer, key of the weights, weights of
# population, building density and road distance.
HAZARDS = [
    ("flood", "hazard_flood", "risk_flood", "flood", 0.40, 0.35, 0.25),
    ("flashflood", "hazard_flashflood", "risk_flashflood", "flashflood", 0.40, 0.35, 0.25),
    ("cyclone", "hazard_cyclone", "risk_cyclone", "cyclone", 0.40, 0.35, 0.25),
    ("storm", "hazard_storm", "risk_storm", "storm", 0.40, 0.35, 0.25),
    ("tsunami", "hazard_tsunami", "risk_tsunami", "tsunami", 0.40, 0.35, 0.25),
    ("earthquake", "hazard_earthquake", "risk_earthquake", "earthquake", 0.35, 0.40, 0.25),
    ("landslide", "hazard_landslides", "risk_landslide", "landslides", 0.25, 0.40, 0.35),
    ("drought", "hazard_drought", "risk_drought", "drought", 0.50, 0.20, 0.30),
    ("fire", "hazard_fire", "risk_fire", "fire", 0.30, 0.40, 0.30),
]
WEIGHT_LAYERS = ("vulnerability_pop_all_total", "vulnerability_reclass_blddensity", "vulnerability_reclass_road")
CLASS_MAX = 5

# Labels and colours of the classes 1 to 5.
DEFAULT_LABELS = ("Very low", "Low", "Moderate", "High", "Very high")
DEFAULT_COLOURS = ("#ffffb2", "#fecc5c", "#fd8d3c", "#f03b20", "#bd0026")
LEGENDS = {
    "hazard_flood": ("0–0.5 m", "0.5–1 m", "1–1.5 m", "1.5–2 m", ">2 m"),
    "hazard_cyclone": ("≤61 km/h", "62–88 km/h", "89–117 km/h", "118–156 km/h", "≥157 km/h"),
    "hazard_earthquake": ("<25 PGA", "25–50 PGA", "50–150 PGA", "150–300 PGA", ">300 PGA"),
}
COUNTABLE = ("hospitals", "schools", "buildings")

# Required sections of a brief, and what may stand in two fields of a source.
SECTIONS = ("## What history says", "## The current signal", "## What's missing and how to weigh it", "## Season timing caveat")
TEMPORAL = ("forecast", "retrospective")
VALIDATION = ("multi-agency-consensus", "single-agency", "model-output", "peer-reviewed")

# Crop calendar, planting and harvest windows in months.
CALENDAR = [
    ("Kenya", "maize", "Long rains", [3, 5], [8, 10]),
    ("Kenya", "maize", "Short rains", [10, 11], [1, 2]),
    ("Zambia", "maize", "Main season", [11, 12], [4, 6]),
]

#: Fields of a raster contract; a layer may declare any of them, and what it doesn't declare isn't checked.
CONTRACT_SCHEMA = "layer string, dtype string, valid_min double, valid_max double, units string, nodata double, epsg int, pixel double, float_tol double, declared array<string>"
DEFAULTS: dict[str, Any] = {"epsg": 4326, "float_tol": 1e-4}
# What layers declare; a declared null of nodata means that there must be none.
_CLASS = {"valid_min": 0.0, "valid_max": 5.0, "units": "class"}
CONTRACTS: dict[str, dict[str, Any]] = {
    "hazard_flood": {**_CLASS, "dtype": "int8", "nodata": None, "pixel": 0.00089831528412},
    "vulnerability_pop_all_total": {**_CLASS, "dtype": "uint8", "nodata": None},
    "vulnerability_reclass_blddensity": {**_CLASS, "dtype": "int8", "nodata": None},
    "vulnerability_reclass_road": {**_CLASS, "dtype": "int8", "nodata": None},
    "risk_flood": {**_CLASS, "dtype": "uint8", "nodata": None},
    "global_pc_h100glob": {"dtype": "uint32", "valid_min": 0.0, "valid_max": 20000.0, "units": "mm", "nodata": 0.0},
    **{h: _CLASS for _, h, *_ in HAZARDS[1:]},
    **{r: _CLASS for _, _, r, *_ in HAZARDS[1:]},
}


def hazards(spark: SparkSession) -> DataFrame:
    """(ord, logical, hazard, risk, weight_key)."""
    return spark.createDataFrame([(i, *h[:4]) for i, h in enumerate(HAZARDS)], "ord int, logical string, hazard string, risk string, weight_key string")


def recipes(spark: SparkSession) -> DataFrame:
    """(weight_key, layer, weight), a row for each ingredient."""
    return spark.createDataFrame([(h[3], layer, w) for h in HAZARDS for layer, w in zip(WEIGHT_LAYERS, h[4:])], "weight_key string, layer string, weight double")


def legend(spark: SparkSession, layer: str) -> DataFrame:
    """(severity, label, colour) of a layer's classes; layers without a legend get the default one."""
    labels = LEGENDS.get(layer, DEFAULT_LABELS)
    return spark.createDataFrame([(i + 1, a, c) for i, (a, c) in enumerate(zip(labels, DEFAULT_COLOURS))], "severity int, label string, colour string")


def contract_row(layer: str, declared: dict[str, Any]) -> tuple:
    """A row of CONTRACT_SCHEMA: the defaults under what is declared, and which fields those are."""
    whole = {**DEFAULTS, **declared}
    fields = ("dtype", "valid_min", "valid_max", "units", "nodata", "epsg", "pixel", "float_tol")
    return (layer, *(whole.get(f) for f in fields), sorted(whole))


def contracts(spark: SparkSession, declared: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    return spark.createDataFrame([contract_row(k, v) for k, v in (declared or CONTRACTS).items()], CONTRACT_SCHEMA)


def calendar(spark: SparkSession) -> DataFrame:
    """(ord, country, crop, season, planting, harvest)."""
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CALENDAR)], "ord int, country string, crop string, season string, planting array<int>, harvest array<int>")
