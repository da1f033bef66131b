"""The index of monthly layers of a map service as a source of streams and tables: spark.readStream.format("month_layers").

The service lists its layers as JSON; those that are named by a month are rows (month, layer_id, name).  A stream's offset is the last
month that it has seen, so each batch has the months that have come since, a restart goes on behind the last committed one, and
a batch that is run again has the same months.  Months come once: what a service lists late, behind a later one, is not seen by a
stream that has passed it; a table reads all of them.  Options: url, attempts, backoff_s.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from gridquill.functions.text import MONTHLY
from gridquill.sources.rest import fetch_json

SCHEMA = "month string, layer_id long, name string"


def listed(options: dict[str, str]) -> list[tuple[str, int, str]]:
    """Monthly layers in the order of their months; of a month that is listed twice that with the highest id counts."""
    found = fetch_json(options["url"], {"f": "json"}, int(options.get("attempts", 3)), float(options.get("backoff_s", 1.0)))
    by_month: dict[str, tuple[str, int, str]] = {}
    for layer in found.get("layers") or []:
        match = re.fullmatch(MONTHLY, str(layer.get("name", "")))
        if match and 1 <= int(match[2]) <= 12 and layer.get("id") is not None:
            row = (f"{match[1]}-{match[2]}", int(layer["id"]), layer["name"])
            by_month[row[0]] = max(row, by_month.get(row[0], row))
    return [by_month[m] for m in sorted(by_month)]


class MonthStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"month": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = [r for r in listed(self.options) if r[0] > start["month"]]
        return iter(rows), {"month": rows[-1][0]} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for r in listed(self.options) if start["month"] < r[0] <= end["month"]])

    def commit(self, end: dict) -> None:
        pass


class MonthReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        yield from listed(self.options)


class MonthLayers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "month_layers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MonthReader:
        return MonthReader(self.options)

    def simpleStreamReader(self, schema) -> MonthStream:
        return MonthStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MonthLayers)
