"""What is staged once and read often: clipped rasters, libraries, archived bytes, fetched tables.

All of it is partitioned Parquet below one root, so writers commit whole partitions and readers prune them.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquill.operators import raster
from gridquill.operators.planning import AREA_CAP_KM2
from gridquill.sources import geotiff
from gridquill.sources.tables import Grid

#: Cells of a tile's side; tiles are partitions, so a window reads its tiles only.
TILE = 1024
#: What may be part of a path.
IDENTIFIER = r"[A-Za-z0-9_][A-Za-z0-9_\-]{0,99}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table at path has been committed, in whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target))


def staged(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written first if it isn't there; a failed attempt leaves none."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_cells(cells: DataFrame, path: str, layer: str, tile: int = TILE) -> None:
    """A layer's cells, without those of class 0, by layer and tile; what the layer held before is replaced."""
    rows = cells.where(F.coalesce(F.col("value") != 0, F.lit(False))).select("row", "col", F.col("value").cast("double").alias("value"), F.expr(f"row div {tile}").alias("tile_row"), F.expr(f"col div {tile}").alias("tile_col"))
    rows.repartition("tile_row", "tile_col").sortWithinPartitions("row", "col").write.mode("overwrite").partitionBy("tile_row", "tile_col").parquet(f"{path}/layer={quote(layer, safe='')}")


def read_cells(spark: SparkSession, path: str, layer: str, grid: Grid | None = None, box: tuple[float, float, float, float] | None = None, tile: int = TILE) -> DataFrame:
    """(row, col, value) of a layer; with a box only the tiles and row groups around it are read."""
    cells = spark.read.parquet(path).where(F.col("layer") == layer)
    if grid is not None and box is not None:
        r1, r2, c1, c2 = raster.window_range(grid, box)
        cells = cells.where(F.col("tile_row").between(r1 // tile, r2 // tile) & F.col("tile_col").between(c1 // tile, c2 // tile))
        cells = raster.clip_window(cells, grid, box)
    return cells.select("row", "col", "value")


def ensure_area(spark: SparkSession, root: str, area_id: str, resolve: Callable[[], DataFrame], layers: Sequence[str], fetch: Callable[[str, DataFrame], DataFrame], cap_km2: float = AREA_CAP_KM2) -> dict[str, DataFrame]:
    """The boundary (name, km2, how, ...) of an area under "area", and each of its asset layers, kept below root.

    The boundary is resolved once, and only layers that aren't there yet are fetched, each by fetch(layer, boundary).  A
    drawn area (how is "drawn") beyond the cap is refused before anything is written."""
    wrong = [x for x in (area_id, *layers) if not re.fullmatch(IDENTIFIER, x)]
    if wrong:
        raise ValueError(f"no identifier: {wrong[0]!r}")
    folder = f"{root}/areas/{area_id}"

    def checked() -> DataFrame:
        found = resolve()
        large = found.where((F.col("how") == "drawn") & (F.col("km2") > cap_km2))
        if not large.isEmpty():
            raise ValueError(f"a drawn area of more than {cap_km2:g} km2; draw a smaller one")
        return found

    boundary = staged(spark, f"{folder}/area", checked)
    return {"area": boundary, **{x: staged(spark, f"{folder}/{x}", lambda x=x: fetch(x, boundary)) for x in layers}}


def hazard_clip(spark: SparkSession, root: str, area_id: str, layer: str, cells: DataFrame, grid: Grid, box: tuple[float, float, float, float]) -> DataFrame:
    """The window of a layer around an area, kept below root for the next request; ids that are no identifiers are refused."""
    if not (re.fullmatch(IDENTIFIER, area_id) and re.fullmatch(IDENTIFIER, layer)):
        raise ValueError(f"no identifier: {area_id!r}, {layer!r}")
    return staged(spark, f"{root}/clip/{area_id}/{layer}", lambda: raster.clip_window(cells, grid, box))


def geotiff_clip(spark: SparkSession, root: str, area_id: str, layer: str, source: str, grid: Grid, box: tuple[float, float, float, float], compression: str = "lzw") -> DataFrame:
    """As hazard_clip, from a GeoTIFF source whose tiles around the area alone are opened, and kept as GeoTIFF below root."""
    if not (re.fullmatch(IDENTIFIER, area_id) and re.fullmatch(IDENTIFIER, layer)):
        raise ValueError(f"no identifier: {area_id!r}, {layer!r}")
    path = f"{root}/clip/{area_id}/{layer}"
    if not exists(spark, path):
        geotiff.write_geotiff(geotiff.read_geotiff(spark, source, grid, box), path, grid, compression=compression)
    return geotiff.read_geotiff(spark, path, grid)


def recomputed_risk(spark: SparkSession, root: str, area_id: str, hazard: str, weights: dict[str, float], make: Callable[[], DataFrame]) -> DataFrame:
    """A recomputed grid kept below root; its key has the weights, so other weights never get a stale grid."""
    key = hashlib.sha1(",".join(f"{k}={v!r}" for k, v in sorted(weights.items())).encode()).hexdigest()[:12]
    return staged(spark, f"{root}/risk/{area_id}/{hazard}-{key}", make)


class Conflict(RuntimeError):
    """Another writer has committed, or is about to commit, the version that this one was going to."""


def library_version(spark: SparkSession, path: str) -> int:
    """The highest committed version of a library, 0 before the first."""
    return max((v for v, done, _ in _versions(spark, path) if done), default=0)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool, float]]:
    """(version, committed, when it was claimed) of every claim."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/claims")
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(root):
        return []
    claims = [(int(s.getPath().getName()), s.getModificationTime() / 1000) for s in fs.listStatus(root) if s.getPath().getName().isdecimal()]
    return [(v, exists(spark, f"{path}/version={v}"), at) for v, at in claims]


def save_library(chunks: DataFrame, path: str, seen: int | None = None, lease_s: float = 3600.0) -> int:
    """Commits chunks as the version behind seen, the version that the writer has read (by default the latest), and returns it.

    A writer claims its version by creating a file, which only one can; Conflict if another has done so or has
    committed since: load again and write again.  A claim that is older than lease_s without a commit is a lost writer's and is passed over.
    Readers see a version when it is whole."""
    spark = chunks.sparkSession
    claims = {v: (done, at) for v, done, at in _versions(spark, path)}
    latest = max((v for v, (done, _) in claims.items() if done), default=0)
    if seen is not None and seen != latest:
        raise Conflict(f"version {latest} has been committed since {seen}")
    version = latest + 1
    while version in claims and time.time() - claims[version][1] > lease_s:
        version += 1
    claim = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/claims/{version}")
    try:
        claim.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(claim, False).close()
    except Exception as e:
        if "AlreadyExists" in str(e):
            raise Conflict(f"version {version} is being written") from None
        raise
    chunks.write.mode("overwrite").parquet(f"{path}/version={version}")
    return version


def load_library(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """The chunks of a library's latest version; ValueError if an id repeats, an embedding is missing or of another size or model."""
    chunks = spark.read.parquet(f"{path}/version={library_version(spark, path)}")
    checks = [F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids")]
    if "embedding" in chunks.columns:
        checks += [F.count("embedding").alias("embedded"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")]
    if model is not None:
        checks.append(F.count_if(~F.col("model").eqNullSafe(F.lit(model))).alias("others"))
    found = chunks.agg(*checks).first().asDict()
    if found["n"] != found["ids"]:
        raise ValueError("chunk ids repeat")
    if found.get("embedded", found["n"]) != found["n"] or found.get("least") != found.get("most"):
        raise ValueError("embeddings are missing or differ in size")
    if found.get("others"):
        raise ValueError(f"chunks of another model than {model}")
    return chunks


def archive(raw: DataFrame, path: str) -> None:
    """(doc_id, filename, content) kept as they came, by the first two digits of the id."""
    raw.withColumn("shelf", F.substring("doc_id", 1, 2)).write.mode("append").partitionBy("shelf").parquet(path)


def archived(spark: SparkSession, path: str, doc_id: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("shelf") == doc_id[:2]) & (F.col("doc_id") == doc_id)).select("doc_id", "filename", "content")


def cached(spark: SparkSession, path: str, fetch: Callable[[], DataFrame], check: Callable[[DataFrame], bool], now: float, ttl_s: float) -> tuple[DataFrame, float | None]:
    """(table, None) if it is fresh, (last good table, its time) if a new one can't be fetched or fails check.

    Fetches are partitions by time; the latest one is read, so a failed fetch never harms a good one."""
    last = None
    if exists(spark, path):
        last = spark.read.parquet(path).agg(F.max("fetched_at")).first()[0]
    latest = lambda at: spark.read.parquet(path).where(F.col("fetched_at") == at).drop("fetched_at")
    if last is not None and now - last < ttl_s:
        return latest(last), None
    try:
        table = fetch()
        if not check(table):
            raise ValueError("the fetched table fails its check")
        table.withColumn("fetched_at", F.lit(float(now))).write.mode("append").partitionBy("fetched_at").parquet(path)
    except Exception:
        if last is None:
            raise
        return latest(last), last
    return latest(float(now)), None
