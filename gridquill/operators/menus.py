"""What a request may choose from and what it asked for: menus of layers, kinds of geometry, parsed arguments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquill.functions import geo
from gridquill.functions import text as tx

# What is asked for at times and was never taken in.
UNAVAILABLE = {"homeless": "no homeless-population layer", "population": "WorldPop not wired in", "evacuation_plan": "no evacuation layer", "ews": "no early-warning layer"}
NO_LAYERS = "No hazard layers are available."


def visible_catalogue(catalogue: DataFrame) -> DataFrame:
    """(ord, layer, description) of a catalogue (ord, layer, description, internal) without what is internal."""
    return catalogue.where(~F.coalesce("internal", F.lit(False))).select("ord", "layer", F.trim(F.coalesce("description", F.lit(""))).alias("description"))


def overlay_catalogue(catalogue: DataFrame, own: DataFrame) -> DataFrame:
    """(thread_id, ord, layer, description): the visible catalogue with a thread's own layers (thread_id, ord, layer,
    description) over it; an own layer takes the place of one of the same name.  The catalogue has a few dozen rows."""
    threads = own.select("thread_id").distinct()
    shared = threads.join(F.broadcast(visible_catalogue(catalogue)), how="cross").withColumn("mine", F.lit(0))
    both = shared.unionByName(own.select("thread_id", "ord", "layer", "description").withColumn("mine", F.lit(1)))
    best = F.max_by(F.struct("ord", "description"), "mine")
    return both.groupBy("thread_id", "layer").agg(best.alias("b")).select("thread_id", "b.ord", "layer", "b.description")


def menu(listed: DataFrame, *by: str) -> DataFrame:
    """(by, menu): a line for each layer in order; a note where there is none.  A menu is a few dozen lines."""
    line = F.concat(F.lit("- "), "layer", F.lit(": "), "description")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "layer", line.alias("line")))), lambda x: x["line"])
    return listed.groupBy(*by).agg(F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit(NO_LAYERS)).alias("menu"))


def refusal(asked: Column) -> Column:
    """Why what is asked for can't be answered; null if it isn't known to be missing."""
    out = F.lit(None).cast("string")
    for name, reason in UNAVAILABLE.items():
        out = F.when(F.lower(F.trim(asked)) == name, F.lit(reason)).otherwise(out)
    return out


def geometry_kind(name: Column) -> Column:
    """Point, LineString or Polygon, several of a kind folded into it; Vector for anything else."""
    single = F.regexp_replace(name, "^Multi(?=Point$|LineString$|Polygon$)", "")
    return F.when(single.isin("Point", "LineString", "Polygon"), single).otherwise(F.lit("Vector"))


def layer_kinds(features: DataFrame, *by: str) -> DataFrame:
    """(by, kind): the one kind of all features (geom_type), Vector where kinds differ."""
    kind = geometry_kind(F.col("geom_type"))
    return features.groupBy(*by).agg(F.when(F.min(kind) == F.max(kind), F.min(kind)).otherwise(F.lit("Vector")).alias("kind"))


def area_rings(area: Sequence[float] | dict) -> list[list[tuple[float, float]]]:
    """Rings of four bounds or of a GeoJSON polygon, as a request sends them."""
    if isinstance(area, dict):
        kind, shape = area.get("type"), area.get("coordinates")
        if kind not in ("Polygon", "MultiPolygon"):
            raise ValueError(f"not an area: {kind}")
        parts = [shape] if kind == "Polygon" else shape
        return [[(float(x), float(y)) for x, y, *_ in ring] for part in parts for ring in part]
    if len(area) != 4:
        raise ValueError("bounds are four numbers")
    return [geo.box_ring(*map(float, area))]


def parsed_arguments(raw: Column, question: Column) -> Column:
    """struct<crop,country,focus> of a JSON object of arguments, the question where no focus is given; null if it is no object."""
    fields = F.from_json(raw, "crop string, country string, focus string", {"mode": "PERMISSIVE"})
    is_object = F.coalesce(F.trim(raw).startswith("{") & F.json_object_keys(raw).isNotNull(), F.lit(False))
    clean = lambda f: F.trim(F.coalesce(fields[f], F.lit("")))
    return F.when(is_object, F.struct(clean("crop").alias("crop"), clean("country").alias("country"), F.trim(F.coalesce(tx.blank_to_null(fields["focus"]), question)).alias("focus")))


def query_texts(crop: Column, country: Column, focus: Column) -> Column:
    """struct<forecast,retrospective>: the two texts that a question is searched by."""
    # The wording of both.
    ahead = F.trim(F.concat_ws(" ", F.lit("El Nino seasonal rainfall forecast outlook"), country, crop, focus))
    back = F.trim(F.concat(F.lit("impact of past El Nino events on "), F.coalesce(tx.blank_to_null(crop), F.lit("crop")), F.lit(" production and food security in "), country))
    return F.struct(ahead.alias("forecast"), back.alias("retrospective"))


def override_applies(target_country: Column, target_crop: Column, country: Column, crop: Column) -> Column:
    """Whether a changed calendar is meant for this question: what it names must be the same in any case."""
    same = lambda a, b: F.coalesce(F.lower(a) == F.lower(F.coalesce(b, F.lit(""))), F.lit(True))
    return same(tx.blank_to_null(target_country), country) & same(tx.blank_to_null(target_crop), crop)
