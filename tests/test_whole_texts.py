"""Queries run over whole tables and whole texts: what earlier tests of drafts, evidence and choices guarded, now that the registered SQL does too."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from gridquill.plans import choices, library, registry
from gridquill.sources import tables as t
from tests.conftest import DATA

#: Subsets of ids and cuts of texts that registered SQL once had.
SUBSETS = (r"WHERE draft_id < \d", r"WHERE doc_id BETWEEN", r"WHERE n_regionkey < \d", r"substr\((?:coalesce\()?text(?:, '')?\)?, 1, \d+\)", r"string_split\(coalesce\(text, ''\), chr\(10\)\)\[1\]")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql_has_no_subsets_of_ids_and_no_cut_texts(name):
    assert not [p for p in SUBSETS if re.search(p, registry.ORACLE_SQL[name])]


def test_drafts_hold_whole_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("draft_id"), F.coalesce("text", F.lit("")).alias("text"))
    drafts = t.drafts(spark, DATA)
    assert drafts.count() == docs.count()
    assert drafts.join(docs, "draft_id").where(~F.contains("draft", "text")).isEmpty()


def test_evidence_holds_whole_chunks_of_any_document(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("whole"))
    found = library.evidence(spark, DATA).where("kind = 'document'")
    assert found.count() == 10
    lines = F.split("text", "\n\n")
    both = found.join(docs, "doc_id")
    assert both.count() == 10 and both.where(~F.forall(lines, lambda line: F.contains(F.col("whole"), line))).isEmpty()
    counts = library.rt.chunk_counts(library.cited_documents(spark, DATA), library.TARGET, library.LINE).agg(F.sum("n_chunks")).first()[0]
    assert counts == library.chunk_documents(spark, DATA).count()


def test_menus_of_all_regions(spark):
    assert choices.QUERIES["layer_menu"](spark, DATA).count() == spark.read.parquet(f"{DATA}/region.parquet").count()
