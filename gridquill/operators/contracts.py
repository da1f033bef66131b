"""Checks of rasters against what they declare, and the gate for rasters that users bring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL_TOL = 1e-6
#: Fixed values of the upload gate: cells and distinct values at most, and the region that is usual.
MAX_PIXELS, MAX_DISTINCT, MAX_BYTES = 3_000_000_000, 32, 200 << 20
REGION = (92.0, -11.0, 141.0, 29.0)

OBSERVED = "layer string, dtype string, vmin double, vmax double, nodata double, epsg int, pixel double"
UPLOADED = "layer string, scale string, n_bytes long, bands int, epsg int, min_lon double, min_lat double, max_lon double, max_lat double, width long, height long, vmin double, vmax double, n_distinct long"


def shown(value: Column) -> Column:
    """A number without a tail of zeros; none for null."""
    whole = F.coalesce(value == F.floor(value), F.lit(False)) & (F.abs(value) < 1e15)
    return F.when(value.isNull(), F.lit("none")).when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def messages(*checks: tuple[Column, Column]) -> Column:
    """The messages whose condition holds, in order."""
    return F.filter(F.array(*(F.when(cond, message) for cond, message in checks)), lambda m: m.isNotNull())


def check_contracts(observed: DataFrame, contracts: DataFrame) -> DataFrame:
    """(layer, ok, mismatches): observed rasters (OBSERVED) against the contracts of their names.

    A field is checked only if it is declared; null observed statistics skip the range; a layer without a
    contract has one mismatch that says so."""
    want = contracts.select(*(F.col(c).alias(f"want_{c}") for c in contracts.columns))
    both = observed.join(want, F.col("layer") == F.col("want_layer"), "left")
    declares = lambda f: F.array_contains("want_declared", f)
    w, o = (lambda f: F.col(f"want_{f}")), F.col
    tol = F.coalesce(w("float_tol"), F.lit(0.0))
    units = F.concat(F.lit(" (declared units="), F.coalesce(w("units"), F.lit("none")), F.lit(")"))
    apart = F.when(w("nodata").isNull() | o("nodata").isNull(), ~w("nodata").eqNullSafe(o("nodata"))).otherwise(F.abs(o("nodata") - w("nodata")) > tol)
    found = messages(
        (w("layer").isNull(), F.concat(F.lit("no contract for "), o("layer"))),
        (declares("dtype") & ~o("dtype").eqNullSafe(w("dtype")), F.concat(F.lit("dtype "), F.coalesce(o("dtype"), F.lit("none")), F.lit(" != declared "), w("dtype"))),
        (declares("valid_max") & (o("vmax") > w("valid_max") + tol), F.concat(F.lit("max "), shown(o("vmax")), F.lit(" > declared valid_max "), shown(w("valid_max")), units)),
        (declares("valid_min") & (o("vmin") < w("valid_min") - tol), F.concat(F.lit("min "), shown(o("vmin")), F.lit(" < declared valid_min "), shown(w("valid_min")))),
        (declares("nodata") & apart, F.concat(F.lit("nodata "), shown(o("nodata")), F.lit(" != declared "), shown(w("nodata")))),
        (declares("epsg") & ~o("epsg").eqNullSafe(w("epsg")), F.concat(F.lit("crs EPSG:"), F.coalesce(o("epsg").cast("string"), F.lit("none")), F.lit(" != declared EPSG:"), w("epsg").cast("string"))),
        (declares("pixel") & F.coalesce(F.abs(o("pixel") - w("pixel")) > PIXEL_TOL, F.lit(True)), F.concat(F.lit("pixel_size "), shown(o("pixel")), F.lit(" != declared "), shown(w("pixel")))),
    )
    return both.select("layer", found.alias("mismatches")).select("layer", (F.size("mismatches") == 0).alias("ok"), "mismatches")


def roll_up(checked: DataFrame) -> DataFrame:
    """One row: n, n_ok, ok (all of them)."""
    return checked.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"))


def gate_uploads(uploaded: DataFrame, region: tuple[float, float, float, float] = REGION) -> DataFrame:
    """(layer, ok, fails, warns): rasters that users bring (UPLOADED), of scale 0-5 or 1-5."""
    c = F.col
    low = F.when(c("scale") == "1-5", F.lit(1.0)).when(c("scale") == "0-5", F.lit(0.0))
    corners = [c(x) for x in ("min_lon", "min_lat", "max_lon", "max_lat")]
    finite = F.lit(True)
    for x in corners:
        finite = finite & F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    degenerate = finite & ((c("max_lon") <= c("min_lon")) | (c("max_lat") <= c("min_lat")))
    away = finite & ((c("max_lon") < region[0]) | (c("min_lon") > region[2]) | (c("max_lat") < region[1]) | (c("min_lat") > region[3]))
    pixels = c("width") * c("height")
    fails = messages(
        (c("n_bytes") == 0, F.lit("the file is empty")),
        (c("n_bytes") > MAX_BYTES, F.lit("the file is too large")),
        (low.isNull(), F.concat(F.lit("unknown scale "), F.coalesce("scale", F.lit("none")))),
        (c("bands") != 1, F.concat(c("bands").cast("string"), F.lit(" bands; a single-band raster is needed"))),
        (c("epsg").isNull(), F.lit("no CRS")),
        (~finite, F.lit("non-finite bounds")),
        (degenerate, F.lit("degenerate bounds")),
        (pixels > MAX_PIXELS, F.concat(pixels.cast("string"), F.lit(" pixels; too many"))),
        (c("vmax") > 5, F.concat(F.lit("max "), shown(c("vmax")), F.lit(" > 5"))),
        (c("vmin") < low, F.concat(F.lit("min "), shown(c("vmin")), F.lit(" < "), shown(low))),
    )
    warns = messages(
        (c("epsg") != 4326, F.concat(F.lit("EPSG:"), c("epsg").cast("string"), F.lit(" will need reprojection"))),
        (away, F.lit("outside the region window")),
        (c("n_distinct") > MAX_DISTINCT, F.concat(c("n_distinct").cast("string"), F.lit(" distinct values; looks continuous"))),
    )
    return uploaded.select("layer", fails.alias("fails"), warns.alias("warns")).select("layer", (F.size("fails") == 0).alias("ok"), "fails", "warns")
