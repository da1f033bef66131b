"""Files of vectors, documents and traces: GeoJSON in and out, text and word-processor documents, JSON lines."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
MIN_TEXT, MAX_FILE = 20, 50 << 20
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(file, fid, geom_type, properties, coordinates) of every feature below path; coordinates stay JSON text
    until a layer's shape is known."""
    raw = spark.read.schema(f"features array<{FEATURE}>").option("multiLine", True).json(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode("features").alias("fid", "f"))
    return rows.select("file", F.col("fid").cast("long").alias("fid"), F.col("f.geometry.type").alias("geom_type"), F.col("f.properties").alias("properties"), F.col("f.geometry.coordinates").alias("coordinates"))


def points(features: DataFrame) -> DataFrame:
    """(file, fid, name, lon, lat) of Point features."""
    pair = F.from_json("coordinates", "array<double>")
    return features.where("geom_type = 'Point'").select("file", "fid", F.col("properties")["name"].alias("name"), pair[0].alias("lon"), pair[1].alias("lat"))


def line_vertices(features: DataFrame) -> DataFrame:
    """(file, fid, idx, lon, lat) of LineString features of two corners or more."""
    corners = F.from_json("coordinates", "array<array<double>>")
    rows = features.where("geom_type = 'LineString'").select("file", "fid", corners.alias("c")).where(F.size("c") >= 2)
    return rows.select("file", "fid", F.posexplode("c").alias("idx", "p")).select("file", "fid", "idx", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def boundary(features: DataFrame) -> list[list[tuple[float, float]]]:
    """The rings of the first feature, a Polygon or MultiPolygon.  An area is one feature, so it comes to the driver."""
    row = features.where("fid = 0").select("geom_type", "coordinates").first()
    if row is None or row["geom_type"] not in ("Polygon", "MultiPolygon"):
        raise ValueError("the first feature is no polygon")
    shape = "array<array<array<double>>>" if row["geom_type"] == "Polygon" else "array<array<array<array<double>>>>"
    parsed = features.sparkSession.createDataFrame([(row["coordinates"],)], "c string").select(F.from_json("c", shape).alias("p")).first()["p"]
    parts = [parsed] if row["geom_type"] == "Polygon" else parsed
    return [[(float(x), float(y)) for x, y, *_ in ring] for part in parts for ring in part]


def feature_json(geom_type: str, coordinates: Column, properties: Column) -> Column:
    """A GeoJSON feature as text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit(geom_type).alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def write_geojson_lines(features: DataFrame, path: str) -> None:
    """features (feature string) as newline-delimited GeoJSON: any number of tasks write files of their own."""
    features.select("feature").write.mode("overwrite").text(path)


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(fid, geom_type, properties, coordinates) of newline-delimited features; fid has no gaps within a file only."""
    f = F.from_json("value", FEATURE)
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("fid"), f.alias("f")).select("fid", F.col("f.geometry.type").alias("geom_type"), F.col("f.properties").alias("properties"), F.col("f.geometry.coordinates").alias("coordinates"))


def docx_text(raw: bytes) -> str:
    """Paragraphs, and rows of tables with their cells joined by a bar."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD}t"))
    lines = []
    for e in body if body is not None else []:
        if e.tag == f"{WORD}p":
            lines.append(said(e))
        elif e.tag == f"{WORD}tbl":
            lines += [" | ".join(said(c) for c in r.iter(f"{WORD}tc")) for r in e.iter(f"{WORD}tr")]
    return "\n\n".join(x for x in lines if x.strip())


def pdf_text(raw: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError:
        raise ValueError("no PDF reader is installed") from None
    return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages)


READERS = {"txt": lambda b: b.decode("utf-8", "replace"), "md": lambda b: b.decode("utf-8", "replace"), "docx": docx_text, "pdf": pdf_text}


def document_text(name: str, raw: bytes) -> tuple[str | None, str | None]:
    """(text, None), or (None, what is wrong with the file)."""
    reader = READERS.get(name.rsplit(".", 1)[-1].lower())
    if reader is None:
        return None, "unsupported file type"
    try:
        text = reader(raw)
    except Exception as e:  # whatever a broken file makes a parser raise
        return None, f"unreadable: {e}"
    return (text, None) if len(text.strip()) >= MIN_TEXT else (None, "no text in it")


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_bytes, text, error) of every file below path: txt, md, docx and, with a reader installed, pdf.

    A file that can't be read, is of another kind, larger than MAX_FILE or holds under MIN_TEXT characters has an error
    and no text; it doesn't fail the others."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, n, *(document_text(p, raw) if n <= MAX_FILE else (None, "too large"))) for p, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "n_bytes", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    capped = files.select("path", "length", F.when(F.col("length") <= MAX_FILE, F.col("content")).alias("content"))
    return capped.mapInArrow(task, "path string, n_bytes long, text string, error string")


def append_traces(traces: DataFrame, path: str) -> None:
    traces.write.mode("append").json(path)
