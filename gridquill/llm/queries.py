"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, decontam, interplay, packing, partenum, quality, repeats, secrets, telephony, toxicity, variants, warc, wavelet
from .common import read_table
from .sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.warc_round_trip(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_batches(read_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wavelet.token_id_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(read_table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = telephony.media_round_trip(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    found = decontam.decontaminate(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans")
    )


def op9_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.remove_seen_windows(read_table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_classes(read_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interplay.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_token_ids": op4_token_ids,
    "op5_repeats": op5_repeats,
    "op6_telephony": op6_telephony,
    "op7_decontamination": op7_decontamination,
    "op8_secrets": op8_secrets,
    "op9_blocks": op9_blocks,
    "op10_jaccard": op10_jaccard,
    "op11_filter_audit": op11_filter_audit,
    "op12_variants": op12_variants,
    "op13_toxicity": op13_toxicity,
}
