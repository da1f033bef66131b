"""Crop seasons as Column expressions: windows of months that may wrap around the year's end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_window(month: Column, first: Column, last: Column) -> Column:
    return F.when(first <= last, month.between(first, last)).otherwise((month >= first) | (month <= last))


def phase(month: Column, planting: Column, harvest: Column) -> Column:
    """planting, harvest, growing (the months between them) or off-season; the first that fits."""
    first, last = (F.element_at(planting, i).cast("int") for i in (1, 2))
    reap, end = (F.element_at(harvest, i).cast("int") for i in (1, 2))
    after, before = last % 12 + 1, F.pmod(reap - 2, F.lit(12)) + 1
    return (
        F.when(in_window(month, first, last), F.lit("planting"))
        .when(in_window(month, reap, end), F.lit("harvest"))
        .when(in_window(month, after, before), F.lit("growing"))
        .otherwise(F.lit("off-season"))
    )


def month_name(month: Column) -> Column:
    return F.date_format(F.make_date(F.lit(2000), month.cast("int"), F.lit(1)), "MMM")


def window_label(window: Column) -> Column:
    return F.concat(month_name(F.element_at(window, 1)), F.lit("–"), month_name(F.element_at(window, 2)))


def valid_window(window: Column) -> Column:
    """Two months, each 1 to 12."""
    return F.coalesce((F.size(window) == 2) & F.forall(window, lambda m: m.between(1, 12)), F.lit(False))
