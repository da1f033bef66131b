"""Which layer answers a request: names of hazards, levels of risk, places in a gazetteer.

Catalogues are small tables, so these are joins of literals that Spark broadcasts by itself; level 1 is a
precomputed risk raster, level 2 one recomputed from a hazard and weighted vulnerability layers.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquill.functions import geo
from gridquill.functions import text as tx

AREA_CAP_KM2 = 1500.0
# Kinds of settlements, the best first, and the names of how an area was found.
HOW = ("nominatim", "radius_box")
KINDS = ("city", "town", "municipality", "village", "suburb")


def bare_name(name: Column) -> Column:
    """A layer's or hazard's name in lower case without a leading hazard_ or risk_ and a trailing _l2."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "^(hazard_|risk_)+", ""), "_l2$", "")


def match_hazards(requests: DataFrame, hazards: DataFrame, name: str = "asked") -> DataFrame:
    """requests with the hazard that each names: by its logical name, else by a layer's name (landslide and
    landslides alike), nulls if none does."""
    bare = hazards.select(F.explode(F.array_distinct(F.array("logical", bare_name(F.col("hazard")), bare_name(F.col("risk"))))).alias("__bare"), "logical", "hazard", "risk", "weight_key")
    return requests.withColumn("__bare", bare_name(F.col(name))).join(bare, "__bare", "left").drop("__bare")


def layer_plans(requests: DataFrame, hazards: DataFrame, recipes: DataFrame, available: DataFrame) -> DataFrame:
    """(request_id, asked, wanted_level, logical, level, layer, oracle, missing) for requests (request_id, asked, wanted_level).

    Level 1 is taken if its raster is available and it is not overruled, else level 2 if its recipe and all
    ingredients are; missing lists what is lacking; available: (layer)."""
    listed = available.select(F.col("layer").alias("__layer")).distinct()
    matched = match_hazards(requests, hazards)
    ingredients = recipes.select("weight_key", F.col("layer").alias("__layer"))
    needs = hazards.select("weight_key", F.col("hazard").alias("__layer"), F.lit(0).alias("ord")).unionByName(
        ingredients.select("weight_key", "__layer", F.lit(1).alias("ord"))
    )
    lacking = needs.join(listed, "__layer", "left_anti").groupBy("weight_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "__layer"))), lambda s: s["__layer"]).alias("lacking"))
    known = ingredients.select("weight_key").distinct().withColumn("has_recipe", F.lit(True))
    l1 = listed.select(F.col("__layer").alias("risk"), F.lit(True).alias("l1"))
    joined = matched.join(lacking, "weight_key", "left").join(known, "weight_key", "left").join(l1, "risk", "left")
    l1_ok, recipe = F.coalesce("l1", F.lit(False)), F.coalesce("has_recipe", F.lit(False))
    none = F.array().cast("array<string>")
    l2_missing = F.when(~recipe, F.array(F.concat(F.lit("no level 2 weights for "), "hazard"))).otherwise(F.coalesce("lacking", none))
    l2_ok = F.size(l2_missing) == 0
    want, found = F.col("wanted_level"), F.col("hazard").isNotNull()
    level = F.when(~found, F.lit(None).cast("int")).when(F.coalesce(want != 2, F.lit(True)) & l1_ok, F.lit(1)).when(F.coalesce(want != 1, F.lit(True)) & l2_ok, F.lit(2))
    fallback = F.when(l2_ok, F.array(F.concat(F.lit("no "), "risk"))).otherwise(l2_missing)
    missing = F.when(~found, F.array(F.concat(F.lit("unknown hazard '"), F.coalesce("asked", F.lit("")), F.lit("'")))).when(level.isNotNull(), none).when(want == 2, l2_missing).otherwise(fallback)
    return joined.select(
        "request_id", "asked", "wanted_level", "logical", level.alias("level"), F.when(level == 1, F.col("risk")).when(level == 2, F.concat("risk", F.lit("_l2"))).alias("layer"), F.when((level == 2) & l1_ok, F.col("risk")).alias("oracle"), missing.alias("missing")
    )


def missing_inputs(hazards: DataFrame, recipes: DataFrame, available: DataFrame) -> DataFrame:
    """(logical, layer): ingredients of level 2 that are not available."""
    needs = hazards.select("logical", F.col("hazard").alias("layer")).unionByName(hazards.join(recipes, "weight_key").select("logical", "layer"))
    return needs.join(available.select("layer"), "layer", "left_anti").select("logical", "layer").distinct()


def answer_options(hazards: DataFrame, recipes: DataFrame, available: DataFrame) -> DataFrame:
    """(logical, n, option, layer): what can answer a question about each hazard, numbered: exposure, risk-L1, risk-L2."""
    listed = available.select("layer").distinct()
    exposure = hazards.join(listed.withColumnRenamed("layer", "hazard"), "hazard", "left_semi").select("logical", F.lit(1).alias("ord"), F.lit("exposure").alias("option"), F.col("hazard").alias("layer"))
    l1 = hazards.join(listed.withColumnRenamed("layer", "risk"), "risk", "left_semi").select("logical", F.lit(2).alias("ord"), F.lit("risk-L1").alias("option"), F.col("risk").alias("layer"))
    complete = hazards.join(recipes.select("weight_key").distinct(), "weight_key", "left_semi").join(missing_inputs(hazards, recipes, available), "logical", "left_anti")
    l2 = complete.select("logical", F.lit(3).alias("ord"), F.lit("risk-L2").alias("option"), F.concat("risk", F.lit("_l2")).alias("layer"))
    options = exposure.unionByName(l1).unionByName(l2).groupBy("logical").agg(F.array_sort(F.collect_list(F.struct("ord", "option", "layer"))).alias("o"))
    return options.select("logical", F.posexplode("o").alias("at", "x")).select("logical", (F.col("at") + 1).alias("n"), "x.option", "x.layer")


def choose(replies: DataFrame, options: DataFrame) -> DataFrame:
    """(reply_id, option, layer) for replies (reply_id, logical, reply): by a leading number, else by a word that
    tells an option, else the first option."""
    # Words that tell an option.
    words = {"exposure": "exposure|raw|hazard|flooded|expos", "risk-L1": "l1|precomp|official", "risk-L2": "l2|recomp|comput|custom|weight"}
    said = F.lower(F.trim("reply"))
    told = F.lit(False)
    for option, pattern in words.items():
        told = told | ((F.col("option") == option) & said.rlike(pattern))
    digit = F.nullif(F.regexp_extract(said, r"^(\d)", 1), F.lit("")).cast("int")
    rank = F.when(digit == F.col("n"), 0).when(told, 1).otherwise(2)
    pick = F.min(F.struct(rank.alias("rank"), "n", "option", "layer"))
    return replies.join(options, "logical").groupBy("reply_id").agg(pick.alias("p")).select("reply_id", "p.option", "p.layer")


def resolve_layers(names: DataFrame, catalogue: DataFrame, name: str = "asked") -> DataFrame:
    """(asked, layer): the layer itself, else hazard_ and the name, else the first layer of the catalogue (ord,
    layer) that contains the name; null if none does."""
    asked = F.lower(F.trim(F.col(name)))
    fits = F.when(F.col("layer") == F.col("__asked"), 0).when(F.col("layer") == F.concat(F.lit("hazard_"), "__asked"), 1).when(F.col("layer").contains(F.col("__asked")) & (F.col("__asked") != ""), 2)
    listed = catalogue.agg(F.collect_list(F.struct("ord", "layer")).alias("__all"))  # a few dozen names in one row
    ranked = names.withColumn("__asked", asked).join(F.broadcast(listed), how="cross").select(name, "__asked", F.explode("__all").alias("c")).select(name, "__asked", "c.*")
    best = F.min(F.when(fits.isNotNull(), F.struct(fits.alias("rank"), "ord", "layer")))
    return ranked.groupBy(name).agg(best.alias("b")).select(name, F.col("b.layer").alias("layer"))


def boundaries(gazetteer: DataFrame, cap: float = AREA_CAP_KM2) -> DataFrame:
    """(query, name, km2): the largest administrative polygon under the cap of each query, the first of equals.

    gazetteer: (query, ord, name, class, type, gtype, km2, lon, lat)."""
    fits = (F.col("class") == "boundary") & (F.col("type") == "administrative") & F.col("gtype").isin("Polygon", "MultiPolygon") & (F.col("km2") <= cap)
    best = F.max_by(F.struct("name", "km2"), F.struct("km2", -F.col("ord")))
    return gazetteer.where(fits).groupBy("query").agg(best.alias("b")).select("query", tx.canonical_name(F.col("b.name")).alias("name"), "b.km2")


def centres(gazetteer: DataFrame) -> DataFrame:
    """(query, name, lon, lat): the best settlement of each query by kind, else its first row."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("type")), F.lit(0))
    rank = F.when(rank == 0, len(KINDS) + 1).otherwise(rank)
    best = F.min_by(F.struct("name", "lon", "lat"), F.struct(rank, "ord"))
    return gazetteer.groupBy("query").agg(best.alias("b")).select("query", tx.canonical_name(F.col("b.name")).alias("name"), "b.lon", "b.lat")


def areas(gazetteer: DataFrame, cap: float = AREA_CAP_KM2, km: float = 12.0) -> DataFrame:
    """(query, name, how, km2, min_lon, min_lat, max_lon, max_lat): a boundary under the cap, else a box around the centre."""
    box = geo.radius_box(F.col("lon"), F.col("lat"), km)
    both = centres(gazetteer).join(boundaries(gazetteer, cap).select("query", F.col("name").alias("b_name"), "km2"), "query", "left")
    named = F.col("b_name").isNotNull()
    return both.select("query", F.coalesce("b_name", "name").alias("name"), F.when(named, HOW[0]).otherwise(HOW[1]).alias("how"), "km2", F.when(~named, box).alias("box")).select("query", "name", "how", "km2", "box.*")


def corrections(gazetteer: DataFrame, cap: float = AREA_CAP_KM2) -> DataFrame:
    """(query, canonical): for each query without a boundary under the cap the name of what was found, where that is another."""
    named = centres(gazetteer).join(boundaries(gazetteer, cap).select("query"), "query", "left_anti").select("query", F.col("name").alias("canonical"))
    return named.where(F.lower(F.trim("canonical")) != F.lower(F.trim("query")))


def areas_with_retry(gazetteer: DataFrame, search: Callable[[DataFrame], DataFrame], cap: float = AREA_CAP_KM2, km: float = 12.0) -> DataFrame:
    """As areas, with corrected, the name that was searched for in a query's stead, or null.

    What finds no boundary is searched for once more by the name that it was recognised as: search gets (query), those names, and
    gives their rows of the gazetteer.  Their boundary counts, else their centre; a name that finds nothing changes nothing."""
    names = corrections(gazetteer, cap)
    again = areas(search(names.select(F.col("canonical").alias("query")).distinct()), cap, km)
    fields = [c for c in again.columns if c != "query"]
    second = names.join(again.withColumnRenamed("query", "canonical"), "canonical").select("query", F.struct(*fields).alias("second"), "canonical")
    both = areas(gazetteer, cap, km).join(second, "query", "left")
    return both.select("query", *(F.when(F.col("second").isNotNull(), F.col(f"second.{c}")).otherwise(F.col(c)).alias(c) for c in fields), F.col("canonical").alias("corrected"))


#: What each operation reads besides the area.
READS: dict[str, Sequence[str]] = {"roads_in_hazard": ("roads",), "count_features": (), "count_in_hazard": ()}


def needed_layers(operation: str, layer: str | None = None) -> list[str]:
    """Asset layers that an operation reads; the others are never fetched."""
    if operation not in READS:
        raise ValueError(f"unknown operation {operation}")
    return [*READS[operation], *([layer] if layer else [])]


class Refused(ValueError):
    """What an operation raises when a request cannot be answered."""


#: Rows of an answer at most.
ANSWER_ROWS = 10_000


def dispatch(operations: Mapping[str, Callable[..., DataFrame]], operation: str, most: int = ANSWER_ROWS, **arguments: Any) -> tuple[DataFrame | None, str | None]:
    """(the operation's result, None), or (None, why there is none).

    A refusal is told and no other answer takes its place: an unknown operation, arguments that it doesn't take or refuses
    (Refused, ValueError), a service that rejects a request or can't be reached, and what Spark reports when the result is first computed.
    Other errors are bugs and raise.  No more than `most` rows and one come to the driver; a result with more is refused."""
    told = lambda e: f"No data for that request: {str(e).splitlines()[0] if str(e) else type(e).__name__}"
    if operation not in operations:
        return None, told(Refused(f"unknown operation {operation}"))
    try:
        inspect.signature(operations[operation]).bind(**arguments)
    except TypeError as e:
        return None, told(e)
    try:
        found = operations[operation](**arguments)
        rows = found.limit(most + 1).collect()
        if len(rows) > most:
            raise Refused(f"more than {most} rows; ask for less")
        return found.sparkSession.createDataFrame(rows, found.schema), None
    except (ValueError, ConnectionError, PySparkException) as e:
        return None, told(e)
