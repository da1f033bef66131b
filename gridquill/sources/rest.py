"""A data source for paged JSON services: spark.read.format("paged_json"), a request for each page.

Options: url (or several mirrors, parted by blanks), page_size, offset_param (resultOffset), size_param (resultRecordCount), attempts, backoff_s, pages
(how many pages are asked for at once, each by a task of its own; 0: page after page until the service says
that there is no more).  Rows are (offset, item), item being the JSON text of a feature.

spark.read.format("map_features") reads assets from a service of map data by layer and area: filters on layer, lon and lat reach
the service as a tag and a box (with spark.sql.python.filterPushdown.enabled).  gazetteer reads a search of places.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from gridquill.functions import geo

#: Statuses after which another attempt may do better.
BUSY = (429, 500, 502, 503, 504)
TIMEOUT_S = 60


class Rejected(ValueError):
    """The service has understood and refused a request."""


def fetch_json(url: str, params: dict[str, object], attempts: int = 3, backoff_s: float = 1.0) -> dict:
    """One JSON document; refusals raise at once.  After busy or broken answers the next mirror is asked, and after the last
    one all of them again, with waits that double."""
    for attempt in range(attempts):
        for mirror in url.split():
            try:
                with urllib.request.urlopen(f"{mirror}{'&' if '?' in mirror else '?'}{urllib.parse.urlencode(params)}", timeout=TIMEOUT_S) as reply:
                    found = json.loads(reply.read())
                if isinstance(found, dict) and "error" in found:
                    raise Rejected(str(found["error"])[:300])
                return found
            except urllib.error.HTTPError as e:
                if e.code not in BUSY:
                    raise Rejected(f"HTTP {e.code}") from None
                problem: Exception = e
            except (urllib.error.URLError, TimeoutError, json.JSONDecodeError) as e:
                problem = e
        if attempt + 1 < attempts:
            time.sleep(backoff_s * 2**attempt)
    raise ConnectionError(f"{url} can't be reached: {problem}")


def has_more(page: dict) -> bool:
    """The flag of a cut-off page stands at the top or among the properties."""
    return bool(page.get("exceededTransferLimit") or (page.get("properties") or {}).get("exceededTransferLimit"))


class Page(InputPartition):
    def __init__(self, offset: int, follow: bool) -> None:
        self.offset, self.follow = offset, follow


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[Page]:
        size, pages = int(self.options.get("page_size", 1000)), int(self.options.get("pages", 0))
        return [Page(i * size, False) for i in range(pages)] or [Page(0, True)]

    def read(self, partition: Page) -> Iterator[tuple]:
        o = self.options
        size, offset = int(o.get("page_size", 1000)), partition.offset
        while True:
            page = fetch_json(o["url"], {o.get("offset_param", "resultOffset"): offset, o.get("size_param", "resultRecordCount"): size}, int(o.get("attempts", 3)), float(o.get("backoff_s", 1.0)))
            items = page.get("features") or []
            yield from ((offset + i, json.dumps(x)) for i, x in enumerate(items))
            offset += len(items)
            if not partition.follow or not items or not has_more(page):
                return


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "offset long, item string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


#: What the service calls the layers: kinds of elements, key and value of the tag, and which form is asked for.
MAP_LAYERS = {"roads": (("way",), "highway", None, "geom"), "hospitals": (("node", "way"), "amenity", "hospital", "center"), "schools": (("node", "way"), "amenity", "school", "center"), "buildings": (("way",), "building", None, "center")}
MAP_SCHEMA = "layer string, fid long, name string, lon double, lat double, min_lon double, min_lat double, max_lon double, max_lat double, line array<struct<lon: double, lat: double>>"
#: Which side of the box a filter moves: columns by the kinds of filters that do.
LOWER = {"lon": 0, "lat": 1, "max_lon": 0, "max_lat": 1}
UPPER = {"lon": 2, "lat": 3, "min_lon": 2, "min_lat": 3}


def map_query(layer: str, box: tuple[float, float, float, float], timeout_s: int) -> str:
    """The service's query for a layer in a box (min lon, min lat, max lon, max lat)."""
    kinds, key, value, form = MAP_LAYERS[layer]
    tag = f'["{key}"]' if value is None else f'["{key}"="{value}"]'
    where = f"({box[1]},{box[0]},{box[3]},{box[2]})"
    return f"[out:json][timeout:{timeout_s}];({''.join(f'{k}{tag}{where};' for k in kinds)});out {form};"


class MapReader(DataSourceReader):
    """A request for each layer and part of the box; a line stands at its first corner and has its bounds, anything else is at its point or centre.

    Filters on lon and lat are on where a feature stands; what may only run into a box is found by its bounds: max_lon >= west
    and min_lon <= east, the same for lat.  A part that the service refuses or doesn't answer is asked for in quarters, `splits`
    times at most; a feature that several parts have comes from each."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.layers, self.box = dict(options), list(MAP_LAYERS), [-180.0, -90.0, 180.0, 90.0]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "layer" and isinstance(f, (EqualTo, In)):
                wanted = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.layers = [x for x in self.layers if x in wanted]
            elif column in LOWER and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.box[LOWER[column]] = max(self.box[LOWER[column]], float(f.value))
            elif column in UPPER and isinstance(f, (LessThan, LessThanOrEqual)):
                self.box[UPPER[column]] = min(self.box[UPPER[column]], float(f.value))
            yield f  # Spark applies each again: a box has sides, and a service may answer with more

    def partitions(self) -> list[InputPartition]:
        side = int(self.options.get("parts", 1))
        return [InputPartition((x, part)) for x in self.layers for part in divided(tuple(self.box), side)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # what Spark hands out where none is planned
            return
        layer, box = partition.value
        seen: set[object] = set()
        for e in self.elements(layer, box, int(self.options.get("splits", 4))):
            line = [(float(p["lon"]), float(p["lat"])) for p in e.get("geometry") or [] if p]
            at = e if "lat" in e else e.get("center") or ({"lon": line[0][0], "lat": line[0][1]} if len(line) > 1 else {})
            if at.get("lat") is not None and at.get("lon") is not None and (e.get("type"), e.get("id")) not in seen:
                seen.add((e.get("type"), e.get("id")))
                lons, lats = zip(*line) if line else ((float(at["lon"]),), (float(at["lat"]),))
                yield layer, e.get("id"), (e.get("tags") or {}).get("name"), float(at["lon"]), float(at["lat"]), min(lons), min(lats), max(lons), max(lats), line or None

    def elements(self, layer: str, box: tuple[float, float, float, float], splits: int) -> Iterator[dict]:
        o = self.options
        try:
            found = fetch_json(o["url"], {"data": map_query(layer, box, int(o.get("server_timeout_s", 55)))}, int(o.get("attempts", 3)), float(o.get("backoff_s", 1.0)))
            if "error" in str(found.get("remark", "")):  # the service gave up half way
                raise Rejected(str(found["remark"])[:300])
        except (Rejected, ConnectionError):
            if not splits:
                raise
            for part in divided(box, 2):
                yield from self.elements(layer, part, splits - 1)
            return
        yield from found.get("elements") or []


def divided(box: tuple[float, float, float, float], side: int) -> list[tuple[float, float, float, float]]:
    """side x side parts of a box that share their sides."""
    x1, y1, x2, y2 = box
    xs, ys = ([a + (b - a) * i / side for i in range(side)] + [b] for a, b in ((x1, x2), (y1, y2)))
    return [(xs[i], ys[j], xs[i + 1], ys[j + 1]) for j in range(side) for i in range(side)]


def map_layer(spark: SparkSession, url: str, layer: str, box: tuple[float, float, float, float], parts: int = 1, **options: object) -> DataFrame:
    """A layer's features that meet a box (min lon, min lat, max lon, max lat), roads that only run through it too, once each.
    parts: the box is asked for in parts x parts requests, each by a task of its own."""
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        raise ValueError("spark.sql.python.filterPushdown.enabled has to be true, or the whole world would be asked for")
    x1, y1, x2, y2 = box
    read = spark.read.format("map_features").options(url=url, parts=parts, **options).load()
    met = (F.col("max_lon") >= x1) & (F.col("min_lon") <= x2) & (F.col("max_lat") >= y1) & (F.col("min_lat") <= y2)
    return read.where((F.col("layer") == layer) & met).dropDuplicates(["layer", "fid", "lon", "lat"])


class MapFeatures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "map_features"

    def schema(self) -> str:
        return MAP_SCHEMA

    def reader(self, schema) -> MapReader:
        return MapReader(self.options)


def gazetteer(items: DataFrame, query: str) -> DataFrame:
    """The rows of planning.boundaries and planning.centres from items (offset, item), the answers to a search of places."""
    place = F.from_json("item", "display_name string, class string, type string, lon string, lat string, geojson struct<type: string, coordinates: string>")
    rows = items.select(F.lit(query).alias("query"), F.col("offset").alias("ord"), place.alias("p"))
    kind = F.col("p.geojson.type")
    text = F.col("p.geojson.coordinates")
    # Every part of a boundary counts, less its holes.
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>"))
    corner = lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))
    each = F.transform(parts, lambda rings: geo.polygon_km2(F.transform(rings, lambda ring: F.transform(ring, corner))))
    km2 = F.aggregate(each, geo.number(0), lambda a, v: a + v)
    return rows.select("query", "ord", F.col("p.display_name").alias("name"), "p.class", "p.type", kind.alias("gtype"), F.when(parts.isNotNull(), km2).alias("km2"), F.col("p.lon").cast("double").alias("lon"), F.col("p.lat").cast("double").alias("lat"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
    spark.dataSource.register(MapFeatures)
