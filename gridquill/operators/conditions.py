"""Monthly crop conditions by region: months, crops, filters, records, summaries and the crop calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridquill.functions import season as sn
from gridquill.functions import text as tx

OUT_OF_SEASON = "Out of season"
SHOWN_REGIONS = 12


def months(conditions: DataFrame) -> DataFrame:
    return conditions.select("month").distinct()


def resolve_months(asked: DataFrame, published: DataFrame) -> DataFrame:
    """(asked, month, nearest, status) for asked (asked): no month is the latest one, a published month itself,
    another one is missing with the nearest, the earlier of equals; what is no month is invalid.

    The published months travel as one array: there are twelve to a year."""
    key = tx.month_key(F.col("asked"))
    table = F.broadcast(published.agg(F.array_sort(F.collect_set("month")).alias("__all")))  # one row
    rows = asked.select("asked", key.alias("key")).join(table, how="cross")
    far = lambda m: F.abs(tx.month_number(m) - tx.month_number(F.col("key")))
    ranked = F.array_sort(F.transform("__all", lambda m: F.struct(far(m).alias("far"), m.alias("month"))))
    latest = F.element_at("__all", -1)
    there = F.array_contains("__all", F.col("key"))
    blank = tx.blank_to_null(F.col("asked")).isNull()
    status = F.when(blank, "latest").when(F.col("key").isNull(), "invalid").when(there, "published").otherwise("missing")
    month = F.when(blank, latest).when(there, F.col("key"))
    nearest = F.when(~blank & F.col("key").isNotNull() & ~there, F.element_at(ranked, 1)["month"])
    return rows.select("asked", month.alias("month"), nearest.alias("nearest"), status.alias("status"))


def distinct_crops(conditions: DataFrame) -> DataFrame:
    """(month, crop), blanks dropped."""
    return conditions.select("month", F.trim("crop").alias("crop")).where("crop <> ''").distinct()


def resolve_crops(asked: DataFrame, crops: DataFrame) -> DataFrame:
    """(asked, crop): crops that equal the word in any case, else those that contain it; a null crop if none does."""
    word = F.lower(F.trim("asked"))
    table = F.broadcast(crops.agg(F.array_sort(F.collect_set("crop")).alias("__menu")))  # the menu, a few dozen names
    rows = asked.join(table, how="cross")
    same = F.filter("__menu", lambda c: F.lower(c) == word)
    part = F.filter("__menu", lambda c: F.contains(F.lower(c), word) & (word != ""))
    found = F.when(F.size(same) > 0, same).otherwise(part)
    return rows.select("asked", F.explode_outer(found).alias("crop"))


def matching(month: str | None = None, crops: list[str] | None = None, place: str | None = None) -> Column:
    """The filter as an expression over columns, never as text; blank filters are none."""
    cond = F.lit(True)
    if month:
        cond = cond & (F.col("month") == month)
    if crops:
        cond = cond & F.col("crop").isin(crops)
    if place and place.strip():
        wanted = F.upper(F.lit(place.strip()))
        cond = cond & ((F.upper("country") == wanted) | (F.upper("region") == wanted))
    return cond


def receipt(crops: list[str] | None = None, place: str | None = None) -> str:
    """The same filter as it is shown to a reader; nothing runs it."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    if crops:
        parts.append(f"Crop IN ({', '.join(map(quoted, crops))})")
    if place and place.strip():
        p = quoted(place.strip())
        parts.append(f"(UPPER(Country) = UPPER({p}) OR UPPER(Region) = UPPER({p}))")
    return " AND ".join(parts) or "1=1"


def records(conditions: DataFrame, month: str | None = None, crops: list[str] | None = None, place: str | None = None) -> DataFrame:
    """(month, country, region, crop, conditions, drivers), trimmed."""
    cleaned = (F.trim(c).alias(c) for c in ("country", "region", "crop", "conditions", "drivers"))
    return conditions.where(matching(month, crops, place)).select("month", *cleaned)


def summary(found: DataFrame) -> DataFrame:
    """(month, conditions, n); blank conditions are out of season."""
    label = F.coalesce(tx.blank_to_null(F.col("conditions")), F.lit(OUT_OF_SEASON))
    return found.groupBy("month", label.alias("conditions")).agg(F.count("*").alias("n"))


def driver_rollup(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, drivers): distinct drivers in order, comma-joined; "none stated" without any."""
    names = F.array_sort(F.collect_set(tx.blank_to_null(F.col("drivers"))))
    return found.groupBy(*keys).agg(F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit("none stated")).alias("drivers"))


def region_listing(found: DataFrame, *keys: str, shown: int = SHOWN_REGIONS) -> DataFrame:
    """(keys, n, regions): "region: condition" of the first rows, and a note that says so where there are more.

    Rows are ordered by region, country, condition and crop; only the first ones of a key are gathered."""
    label = F.concat(F.coalesce(tx.blank_to_null(F.col("region")), F.col("country")), F.lit(": "), F.coalesce(tx.blank_to_null(F.col("conditions")), F.lit("out of season")))
    order = Window.partitionBy(*keys).orderBy("region", "country", "conditions", "crop", "drivers")
    numbered = found.select(*keys, "region", "country", "conditions", "crop", "drivers", label.alias("label")).withColumn("at", F.row_number().over(order)).where(F.col("at") <= shown)
    counts = found.groupBy(*keys).agg(F.count("*").alias("n"))
    first = numbered.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda s: s["label"]).alias("labels"))
    note = F.when(F.col("n") > shown, F.format_string(f" (first {shown} of %d rows)", "n")).otherwise(F.lit(""))
    return counts.join(first, list(keys)).select(*keys, "n", F.concat(F.array_join("labels", "; "), note).alias("regions"))


def note(what: str | None, place: str | None, month: str) -> str:
    """Why there may be no row."""
    reasons = (["the place must exactly match a Country or Region name (case-insensitive)"] if place else []) + ["the area may not be monitored"] + (["the crop may be out of season there"] if what else [])
    return f"no {what or 'any crop'} assessment for {place or 'the requested filter'} in {month} — " + "; ".join(reasons) + "."


def phases(calendar: DataFrame, asked: DataFrame) -> DataFrame:
    """(ord, country, crop, season, month, phase) of every season in each asked month (month int)."""
    rows = calendar.join(F.broadcast(asked), how="cross")  # twelve months at most
    return rows.select("ord", "country", "crop", "season", "month", sn.phase(F.col("month"), F.col("planting"), F.col("harvest")).alias("phase"))


def calendar_citations(calendar: DataFrame, asked: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(country, crop, month, adjusted, title, text) for asked (country, crop, month): the calendar as a piece
    of evidence; overrides, seasons like calendar's, take the place of those of the same country and crop."""
    seasons = calendar.withColumn("adjusted", F.lit(False))
    keys = lambda d: [F.lower(d["country"]), F.lower(d["crop"])]
    if overrides is not None:
        o = overrides.select(F.lower("country").alias("__c"), F.lower("crop").alias("__k")).distinct()
        kept = seasons.join(o, (F.lower("country") == F.col("__c")) & (F.lower("crop") == F.col("__k")), "left_anti")
        seasons = kept.unionByName(overrides.withColumn("adjusted", F.lit(True)))
    s = seasons.select(F.lower("country").alias("__c"), F.lower("crop").alias("__k"), "ord", "season", "planting", "harvest", "adjusted")
    a = asked.withColumns({"__c": keys(asked)[0], "__k": keys(asked)[1]})
    both = a.join(s, ["__c", "__k"])
    # The wording of a citation.
    line = F.concat(
        "season", F.lit(": planting "), sn.window_label(F.col("planting")), F.lit(", harvest "), sn.window_label(F.col("harvest")), F.lit(" — "),
        F.date_format(F.make_date(F.lit(2000), F.col("month"), F.lit(1)), "MMMM"), F.lit(" falls in the "), sn.phase(F.col("month"), F.col("planting"), F.col("harvest")),
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])
    found = both.groupBy("country", "crop", "month").agg(F.bool_or("adjusted").alias("adjusted"), F.array_join(lines, "; ").alias("lines"))
    head = F.when(F.col("adjusted"), F.concat(F.lit("CROP CALENDAR for "), "country", F.lit(" "), "crop", F.lit(", ADJUSTED by the requester for this run (not the default)"))).otherwise(
        F.concat(F.lit("Crop calendar for "), "country", F.lit(" "), "crop", F.lit(" (default configuration)"))
    )
    return found.select("country", "crop", "month", "adjusted", F.concat("country", F.lit(" "), "crop", F.lit(" season windows")).alias("title"), F.concat(head, F.lit(": "), "lines", F.lit(".")).alias("text"))


def conditions_citation(found: DataFrame) -> DataFrame:
    """(month, country, crop, text): the records of a month, country and crop as one piece of evidence."""
    keys = ("month", "country", "crop")
    counted = found.groupBy(*keys, F.coalesce(tx.blank_to_null(F.col("conditions")), F.lit(OUT_OF_SEASON)).alias("label")).agg(F.count("*").alias("n"))
    sums = counted.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "n"))), lambda x: F.concat(x["label"], F.lit(" "), x["n"].cast("string"))), ", ").alias("summary"))
    whole = sums.join(region_listing(found, *keys), list(keys)).join(driver_rollup(found, *keys), list(keys))
    text = F.concat(F.lit("conditions as of "), "month", F.lit(" for "), "country", F.lit(" "), "crop", F.lit(": summary "), "summary", F.lit("; regions: "), "regions", F.lit("; drivers: "), "drivers", F.lit("."))
    return whole.select(*keys, text.alias("text"))
