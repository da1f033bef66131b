"""A training-data pipeline over the documents table: five stages of gridquill.llm, whose part this file is.

Each stage takes the documents that the one before it has kept and hands on documents with the same
columns; the last deals them to batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquill.llm import decontam, packing, partenum, quality, secrets
from gridquill.llm.common import cut, read_table, without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; it is learned from labels and these documents."""
    scored = quality.score_quality(docs, read_table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where("predicted = 1").select(*(F.col(f"keep_{c}").alias(c) for c in COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of texts linked by a Jaccard similarity of
    0.8 or more of their five-word shingles.  Rows that share an id stay or go together."""
    classes = partenum.jaccard_classes(docs, n=5, num=80, den=100)
    gone = cut(classes.where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    return without(docs, gone, [(docs["doc_id"], "doc_id")]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item (or a whole shorter item)."""
    found = decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    gone = cut(found.where("n_hit > 0").select("doc_id", "text_key"), "contaminated")
    return without(docs, gone, [(docs["doc_id"], "doc_id"), (decontam.match_key(docs["text"]), "text_key")]).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; n_chars follows the text."""
    found = secrets.scan_secrets(docs, keep=COLUMNS)
    text = secrets.redact(F.col("keep_text"), F.col("spans"))
    clean = found.select(*(F.col(f"keep_{c}").alias(c) for c in COLUMNS if c not in ("text", "n_chars")), text.alias("text"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot."""
    return packing.pack_batches(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: A fitted classifier and an optimal packing are no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's documents written and read again in between."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
