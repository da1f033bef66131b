"""Queries of the document library and of drafts that cite it, each with the same computation in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridquill.functions import text as tx
from gridquill.operators import evidence as ev
from gridquill.operators import pruned
from gridquill.operators import retrieval as rt
from gridquill.sources import catalog
from gridquill.sources import tables as t
from gridquill.sources.shared import cut, work_dir

K, FLOOR, LABEL, TARGET, LINE = 10, 0.5, 3, 600, r"\n"
#: Documents that a stream or an ingest has seen before; those from here on come in.
STORED_BELOW, AS_OF = 100, "1997-05"
#: Coefficients of a stated query vector: component i is cos(i), at unit length by the engine.
QUERY = [math.cos(i) for i in range(64)]


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each text: (doc_id, text, source, temporal, countries), as it first came."""
    rows = t.library(spark, sf_dir)
    return rt.ingest(rows, meta=("source", "temporal", "countries"))


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.content_ids(t.library(spark, sf_dir))


def dedupe_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from STORED_BELOW on come into a library that holds the others."""
    rows = t.library(spark, sf_dir)
    stored = rt.ingest(rows.where(F.col("row_id") < STORED_BELOW))
    found = rt.ingest(rows.where(F.col("row_id") >= STORED_BELOW), stored)
    return found.select("doc_id", "first_row", "rows", "source", "temporal", "status", F.length("text").alias("n_chars"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document; its lines are its paragraphs."""
    docs = t.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rt.chunk(docs, TARGET, LINE).select("chunk_id", "doc_id", "ord", F.length("text").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source")
    return rt.documents(rt.chunk(docs, TARGET, LINE))


def corpus_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.count(t.library(spark, sf_dir), temporal="Forecast", countries=["FR", "de"], source="")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.vectors(spark, sf_dir).withColumn("label", F.col("label").cast("string"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.search(vectors(spark, sf_dir), QUERY, K, id_col="vec_id").select("vec_id", "label", "score")


def filtered_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters before the limit, the floor after it."""
    return rt.search(vectors(spark, sf_dir), QUERY, 50, floor=0.05, id_col="vec_id", label=[str(LABEL)]).select("vec_id", "label", "score")


def relevance_floor_decline(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    reports = [rt.search_report(v, QUERY, K, floor, "vec_id", **f).withColumn("case", F.lit(i)) for i, (floor, f) in enumerate(((0.0, {}), (0.99, {}), (0.0, {"label": "none such"})))]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


def vector_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 100."""
    v = t.vectors(spark, sf_dir)
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return rt.search_many(v, queries, 5, "vec_id").withColumnRenamed("id", "vec_id")


def vector_topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As vector_topk_many, by lists that distances allow to skip."""
    v = t.vectors(spark, sf_dir)
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return pruned.search_many_pruned(v, queries, 5).withColumnRenamed("id", "vec_id")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked hits without vectors: of each language the documents by length, longest first."""
    rows = t.read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.coalesce("text", F.lit("")).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id"))
    return rows.withColumn("rank", rank).where("rank <= 5")


def source_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir).withColumn("source", F.when(F.col("doc_id") % 3 != 0, F.col("source"))).withColumn("title", F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
    return rt.source_block(found, [F.col("rank")], ["title"], ["lang"])


def required_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    docs = t.read(spark, sf_dir, "documents").select(
        "doc_id", F.when(k % 3 != 0, F.col("source")).otherwise(" ").alias("source"), F.when(k % 4 != 0, F.lit("1997-05")).alias("pub_date"),
        F.when(k % 5 == 0, "sometimes").when(k % 5 == 1, "").otherwise("forecast").alias("temporal"), F.when(k % 7 == 0, "hearsay").otherwise("single-agency").alias("validation"),
    )
    found = rt.require_provenance(docs, ("source", "pub_date", "temporal", "validation"), {"temporal": catalog.TEMPORAL, "validation": catalog.VALIDATION})
    return found.select("doc_id", F.array_join("missing", ",").alias("missing"), F.array_join("wrong", ",").alias("wrong"), "ok")


def joined(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(F.transform(n, lambda x: x.cast("string")), ",") for n in names})


def cited_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(t.drafts(spark, sf_dir).select("draft_id", tx.cited_numbers(F.col("draft")).alias("cited")), "cited")


def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(t.drafts(spark, sf_dir).select("draft_id", tx.number_tokens(tx.without_citations(F.col("draft"))).alias("numbers")), "numbers")


def cited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what evidence says of them."""
    return t.read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit("document").alias("kind"), "source", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.lit("1997-05").alias("pub_date"),
        F.when(F.col("doc_id") % 2 == 1, "forecast").otherwise("retrospective").alias("temporal"),
    )


def found_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked chunks of a search of either kind, whole; documents without text have none.

    Chunks of all documents have a vector each: embeddings are fewer than chunks, so they are dealt out by (doc_id + ord).  Chunks are
    ranked by their keys; texts are cut again for those that are found."""
    docs = cited_documents(spark, sf_dir)
    v = t.vectors(spark, sf_dir).select("vec_id", "embedding")
    counts = cut(rt.chunk_counts(docs, TARGET, LINE), work_dir(spark, "chunk-counts"))  # numbers alone; texts are cut once for them
    counted = counts.join(F.broadcast(v.agg(F.count("*").alias("n_vectors"))), how="cross")  # one row
    keys = counted.where("n_chunks > 0").withColumn("ord", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).drop("n_chunks")
    dealt = keys.withColumn("vec_id", (F.col("doc_id").cast("long") + F.col("ord")) % F.nullif("n_vectors", F.lit(0))).withColumn("chunk_id", F.concat_ws(":", "doc_id", F.col("ord").cast("string")))
    top = cut(rt.search_by(dealt, rt.similarities(v, QUERY), "temporal"), work_dir(spark, "hits"))
    return rt.pick_chunks(docs, top, TARGET, LINE)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered evidence of a question: what two searches find, conditions of a month, the calendar."""
    month = t.conditions(spark, sf_dir).where(F.col("month") == AS_OF)
    summary = month.agg(F.count("*").alias("n"), F.count_distinct("country").alias("countries"))
    cond = summary.select(F.lit(1).alias("rank"), F.lit("conditions").alias("kind"), F.lit("Crop conditions").alias("source"), F.lit("Global crop conditions").alias("title"), F.lit(AS_OF).alias("pub_date"), F.lit("multi-agency-consensus").alias("validation"), F.format_string("%d rows of %d countries", "n", "countries").alias("text"))
    cal = catalog.calendar(spark).where("country = 'Zambia'").select(F.lit(1).alias("rank"), F.lit("calendar").alias("kind"), F.lit("Crop calendar").alias("source"), F.concat("country", F.lit(" "), "crop").alias("title"), F.lit(False).alias("adjusted"), "season")
    cal = cal.withColumnRenamed("season", "text")
    hits = found_chunks(spark, sf_dir)
    whole = ev.union([hits.where("temporal = 'forecast'"), hits.where("temporal = 'retrospective'"), cond, cal])
    return cut(whole, work_dir(spark, "evidence"))  # a dozen rows that what follows reads several times


def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select("n", "kind", "source", "title", "pub_date", "validation", "temporal", "doc_id", "adjusted", F.length("text").alias("n_chars"))


def evidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.stats(evidence(spark, sf_dir))


def evidence_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(ev.feeds(evidence(spark, sf_dir).where("kind <> 'conditions'")), "cites")


def grouped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(ev.grouped_sources(evidence(spark, sf_dir)), "cites")


def sources_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sources_text(evidence(spark, sf_dir))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = ev.numbers_of(evidence(spark, sf_dir))
    return ev.check_drafts(t.drafts(spark, sf_dir).join(F.broadcast(numbers), how="cross"))  # one row of evidence


def phantom_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("draft_id", F.explode("phantom").alias("n"))


def uncited_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("draft_id", F.posexplode("uncited").alias("at", "paragraph"))


def groundedness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checked(spark, sf_dir).select("draft_id", "passed", "cited", "phantom", F.size("missing_sections").alias("n_missing"), "own_sources", F.size("uncited").alias("n_uncited"), F.size("unverified").alias("n_unverified"))
    return joined(found, "cited", "phantom")


def brief_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(ev.claims(t.drafts(spark, sf_dir)), "cites")


def claim_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.claim_edges(ev.claims(t.drafts(spark, sf_dir)))


def provenance_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What citations 1 and 7 of any draft lead to, claims named by their drafts."""
    edges = ev.claim_edges(ev.claims(t.drafts(spark, sf_dir)))
    of = lambda c: F.when(F.col(c).startswith("claim-"), F.concat("draft_id", F.lit("/"), c)).otherwise(F.col(c))
    named = edges.select(of("src").alias("src"), of("dst").alias("dst"))
    return ev.reachable(named, spark.createDataFrame([("cite-1",), ("cite-7",)], "start string"))


def used_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.used_citations(ev.claims(t.drafts(spark, sf_dir)), evidence(spark, sf_dir)).select("n", "kind", "used")


def document_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document of the library can be found; texts of an even length have an archived copy."""
    rows = t.library(spark, sf_dir)
    url = F.when(F.col("row_id") % 4 != 0, F.concat(F.lit("https://example.org/"), F.col("row_id").cast("string"))).otherwise(" ")
    return rows.select("row_id", rt.trace(F.col("doc_id"), url, F.length("text") % 2 == 0, "archive/").alias("x")).select("row_id", "x.*")


def page_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages: scripts, styles and tags taken out.  An extension."""
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))
    return t.read(spark, sf_dir, "pages").select("page_id", F.length(text).alias("n_chars"), F.md5(F.encode(text, "UTF-8")).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        document_ids, dedupe_ingest, chunk_documents, corpus_documents, corpus_count, vector_topk, filtered_vector_topk, relevance_floor_decline, vector_topk_many, vector_topk_pruned, source_block, required_provenance, cited_numbers, number_tokens,
        evidence_union, evidence_stats, evidence_feeds, grouped_sources, sources_text, phantom_citations, uncited_paragraphs, groundedness_report, brief_claims, claim_edges, provenance_reachability, used_citations, document_traces, page_text_extract,
    )
}

_LIB = "lib AS (SELECT doc_id AS row_id, substr(sha1(text), 1, 16) AS doc_id, text, source, CASE WHEN doc_id % 2 = 1 THEN 'forecast' ELSE 'retrospective' END AS temporal FROM documents)"
_QUERY = "[" + ", ".join(f"{x!r}::double" for x in QUERY) + "]"
_SIM = f"list_dot_product(embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)))"
_SCORED = f"scored AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, {_SIM} AS sim, round({_SIM}, 4) AS score FROM embeddings CROSS JOIN (SELECT {_QUERY} AS v) q)"
# Pieces of lines, then chunks of pieces, each by a recursion over the documents.
_CHUNKS = rf"""RECURSIVE paras AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, i, p FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL) WHERE p <> ''),
 cut AS (SELECT doc_id, i, 0 AS j, NULL::VARCHAR AS piece, p AS rest FROM paras
  UNION ALL SELECT doc_id, i, j + 1, regexp_replace(substr(rest, 1, pos), '^\s+|\s+$', '', 'g'), regexp_replace(substr(rest, pos + 1), '^\s+|\s+$', '', 'g') FROM (SELECT *, CASE WHEN stop > {TARGET // 2} THEN stop + 1 ELSE {TARGET} END AS pos FROM (
   SELECT *, CASE WHEN contains(substr(rest, 1, {TARGET}), '. ') THEN {TARGET - 1} - instr(reverse(substr(rest, 1, {TARGET})), ' .') ELSE -1 END AS stop FROM cut WHERE length(rest) > {TARGET}))),
 pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k, piece FROM (SELECT doc_id, i, j, piece FROM cut WHERE piece IS NOT NULL UNION ALL SELECT doc_id, i, 1000000, rest FROM cut WHERE length(rest) <= {TARGET}) WHERE piece <> ''),
 pack AS (SELECT doc_id, 1::BIGINT AS k, 0 AS ord, piece AS now FROM pieces WHERE k = 1
  UNION ALL SELECT p.doc_id, n.k, CASE WHEN length(p.now) + length(n.piece) + 2 <= {TARGET} THEN p.ord ELSE p.ord + 1 END, CASE WHEN length(p.now) + length(n.piece) + 2 <= {TARGET} THEN p.now || chr(10) || chr(10) || n.piece ELSE n.piece END FROM pack p JOIN pieces n ON n.doc_id = p.doc_id AND n.k = p.k + 1),
 chunks AS (SELECT doc_id, ord, arg_max(now, k) AS text FROM pack GROUP BY doc_id, ord)"""
_DRAFTS = """drafts AS (SELECT doc_id AS draft_id, CASE WHEN doc_id % 3 = 0 THEN '## What history says' ELSE '## The current signal' END || chr(10) || coalesce(text, '') ||
 CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN ' [' || doc_id % 12 || ']' WHEN 2 THEN ' [' || doc_id % 9 || ', ' || doc_id % 9 + 1 || ']' WHEN 3 THEN ' [' || doc_id % 5 || '-' || doc_id % 5 + 2 || ']'
 WHEN 4 THEN ' [' || doc_id % 5 || '–' || doc_id % 5 + 1 || ', 7]' WHEN 5 THEN ' [9-4] [1200]' ELSE ' about ' || doc_id % 40 || ',' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '.5 tonnes [2]' END ||
 CASE WHEN doc_id % 5 = 0 THEN chr(10) || chr(10) || '## Sources' || chr(10) || 'none' || chr(10) || chr(10) || '## Season timing caveat' || chr(10) || 'plain words only' ELSE chr(10) || chr(10) || '## What''s missing and how to weigh it' || chr(10) || 'nothing much [1]' END AS draft FROM documents)"""


def _cites_sql(text: str) -> str:
    """Sorted distinct citation numbers of a text."""
    groups = rf"regexp_extract_all({text}, '\[([\d\s,–\-]+)\]', 1)"
    parts = rf"flatten(list_transform({groups}, lambda g: regexp_split_to_array(trim(replace(g, '–', '-')), '[,\s]+')))"
    expand = r"CASE WHEN regexp_matches(p, '^\d+-\d+$') THEN range(CAST(split_part(p, '-', 1) AS BIGINT), least(CAST(split_part(p, '-', 2) AS BIGINT), CAST(split_part(p, '-', 1) AS BIGINT) + 50) + 1) WHEN regexp_matches(p, '^\d+$') THEN [CAST(p AS BIGINT)] ELSE [] END"
    return f"list_sort(list_distinct(list_filter(flatten(list_transform({parts}, lambda p: {expand})), lambda n: n < 1000)))"


_BARE = rf"regexp_replace(draft, '\[([\d\s,–\-]+)\]', '', 'g')"
_TOKENS = lambda x: rf"list_sort(list_distinct(regexp_extract_all(replace({x}, ',', ''), '\d+(?:\.\d+)?')))"
_TEXT = lambda xs: f"array_to_string({xs}, ',')"
# What two searches find among the chunks of all documents, conditions of a month, the calendar.
_EVIDENCE = f"""{_CHUNKS}, q AS (SELECT {_QUERY} AS v), n AS (SELECT count(*) AS n_vectors FROM embeddings),
 near AS (SELECT CAST(c.doc_id AS BIGINT) AS doc_id, c.text, d.source, round({_SIM}, 4) AS score, c.doc_id || ':' || c.ord AS chunk_id FROM chunks c JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.doc_id
  CROSS JOIN n JOIN embeddings e ON e.vec_id = (d.doc_id + c.ord) % n_vectors CROSS JOIN q),
 hit AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY score DESC, chunk_id) AS hit FROM near QUALIFY hit <= {rt.TOP_K}),
 parts AS (SELECT CASE WHEN doc_id % 2 = 1 THEN 0 ELSE 1 END AS s, hit AS rank, 'document' AS kind, source, 'Document ' || doc_id AS title, '1997-05' AS pub_date, NULL AS validation, CASE WHEN doc_id % 2 = 1 THEN 'forecast' ELSE 'retrospective' END AS temporal, CAST(doc_id AS VARCHAR) AS doc_id, NULL::BOOLEAN AS adjusted, text
  FROM hit
 UNION ALL SELECT 2, 1, 'conditions', 'Crop conditions', 'Global crop conditions', '{AS_OF}', 'multi-agency-consensus', NULL, NULL, NULL, count(*) || ' rows of ' || count(DISTINCT n_name) || ' countries' FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE strftime(o_orderdate, '%Y-%m') = '{AS_OF}'
 UNION ALL SELECT 3, 1, 'calendar', 'Crop calendar', 'Zambia maize', NULL, NULL, NULL, NULL, false, 'Main season'),
 ev AS (SELECT CAST(row_number() OVER (ORDER BY s, rank) AS INT) AS n, *, CASE WHEN kind = 'document' THEN temporal ELSE kind END AS feed FROM parts)"""
_BLOCKS = r"list_filter(list_transform(string_split(draft, chr(10) || chr(10)), lambda b: trim(array_to_string(list_filter(string_split(b, chr(10)), lambda l: NOT starts_with(ltrim(l), '#')), chr(10)))), lambda b: b <> '')"
_CHECKED = f"""{_EVIDENCE}, {_DRAFTS}, nums AS (SELECT list(n) AS valid, {_TOKENS("string_agg(concat_ws(' ', text, pub_date, title, source), ' ')")} AS numbers FROM ev),
 c AS (SELECT draft_id, draft, {_cites_sql("draft")} AS cited, valid, numbers, list_filter({_BLOCKS}, lambda b: NOT regexp_matches(b, '\\[([\\d\\s,–\\-]+)\\]')) AS uncited,
 list_filter({"[" + ", ".join("'" + s.replace("'", "''") + "'" for s in catalog.SECTIONS) + "]"}, lambda s: NOT contains(draft, s)) AS missing, contains(draft, '## Sources') AS own, {_TOKENS(_BARE)} AS said FROM drafts CROSS JOIN nums),
 chk AS (SELECT *, list_filter(cited, lambda n: NOT list_contains(valid, n)) AS phantom, list_filter(said, lambda x: NOT list_contains(numbers, x)) AS unverified FROM c)"""
_CLAIMS = rf"""{_DRAFTS}, blk AS (SELECT draft_id, unnest(string_split(string_split(draft, chr(10) || '## Sources')[1], chr(10) || chr(10))) AS raw, generate_subscripts(string_split(string_split(draft, chr(10) || '## Sources')[1], chr(10) || chr(10)), 1) AS pos FROM drafts),
 b AS (SELECT draft_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS block FROM blk WHERE regexp_replace(raw, '^\s+|\s+$', '', 'g') <> ''),
 h AS (SELECT draft_id, pos, CASE WHEN block[1] = '#' THEN regexp_replace(string_split(block, chr(10))[1], '^#+\s*', '') END AS heading, CASE WHEN block[1] = '#' THEN regexp_replace(array_to_string(list_filter(string_split(block, chr(10))[2:], lambda l: NOT starts_with(ltrim(l), '#')), chr(10)), '^\s+|\s+$', '', 'g') ELSE block END AS body FROM b),
 s AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY draft_id ORDER BY pos), 'Preamble') AS section FROM h),
 claims AS (SELECT draft_id, CAST(row_number() OVER (PARTITION BY draft_id ORDER BY pos) - 1 AS INT) AS claim, section, trim(regexp_replace(regexp_replace(body, '\[([\d\s,–\-]+)\]', '', 'g'), '\s+', ' ', 'g')) AS text, list_filter({_cites_sql("body")}, lambda n: n > 0) AS cites FROM s WHERE body <> '')"""
_EDGES = "edges AS (SELECT DISTINCT draft_id, 'cite-' || n AS src, 'claim-' || claim AS dst FROM (SELECT draft_id, claim, unnest(cites) AS n FROM claims) UNION SELECT DISTINCT draft_id, 'claim-' || claim, 'section-' || section FROM claims)"

ORACLE_SQL = {
    "document_ids": f"WITH {_LIB} SELECT row_id, doc_id FROM lib",
    "dedupe_ingest": f"""WITH {_LIB}, a AS (SELECT doc_id, min(row_id) FILTER (WHERE row_id < {STORED_BELOW}) AS f0, min(row_id) FILTER (WHERE row_id >= {STORED_BELOW}) AS f1, count(*) FILTER (WHERE row_id >= {STORED_BELOW}) AS rows,
        max(row_id) FILTER (WHERE row_id < {STORED_BELOW}) AS l0, max(row_id) FILTER (WHERE row_id >= {STORED_BELOW}) AS l1 FROM lib GROUP BY doc_id)
        SELECT a.doc_id, coalesce(f0, f1) AS first_row, rows, y.source, y.temporal, CASE WHEN f0 IS NULL THEN 'new' WHEN f1 IS NULL THEN 'kept' WHEN x.source IS NOT DISTINCT FROM y.source AND x.temporal = y.temporal THEN 'unchanged' ELSE 'updated' END AS status, CAST(length(y.text) AS INT) AS n_chars
        FROM a LEFT JOIN lib x ON x.row_id = l0 JOIN lib y ON y.row_id = coalesce(l1, l0)""",
    "chunk_documents": f"WITH {_CHUNKS} SELECT doc_id || ':' || ord AS chunk_id, doc_id, ord, CAST(length(text) AS INT) AS n_chars, md5(text) AS digest FROM chunks",
    "corpus_documents": f"WITH {_CHUNKS} SELECT c.doc_id, count(*) AS n_chunks, any_value(d.source) AS source FROM chunks c JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.doc_id GROUP BY c.doc_id",
    "corpus_count": "SELECT count(*) AS n FROM documents WHERE doc_id % 2 = 1 AND lower(lang) IN ('fr', 'de')",
    "vector_topk": f"WITH {_SCORED} SELECT vec_id, label, score FROM scored ORDER BY score DESC, vec_id LIMIT {K}",
    "filtered_vector_topk": f"WITH {_SCORED} SELECT vec_id, label, score FROM (SELECT * FROM scored WHERE label = '{LABEL}' ORDER BY score DESC, vec_id LIMIT 50) WHERE sim >= 0.05",
    "relevance_floor_decline": f"""WITH {_SCORED}, top AS (SELECT sim FROM scored ORDER BY score DESC, vec_id LIMIT {K})
        SELECT (SELECT count(*) FROM scored) AS n_docs, (SELECT count(*) FROM scored WHERE i < 2) AS n_match, (SELECT count(*) FROM top WHERE i < 2 AND sim >= fl) AS n_hits,
        CASE WHEN (SELECT count(*) FROM top WHERE i < 2 AND sim >= fl) > 0 THEN NULL WHEN i = 2 THEN 'no document matches the filters' ELSE 'no document is relevant enough (floor 0.99)' END AS note, i AS "case" FROM (VALUES (0, 0.0), (1, 0.99), (2, 0.0)) AS v(i, fl)""",
    "vector_topk_many": """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0)
        SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p QUALIFY rank <= 5""",
    "source_block": """WITH h AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
        SELECT lang, count(*) AS n, string_agg('[' || rank || '] ' || CASE WHEN doc_id % 3 <> 0 AND trim(source) <> '' THEN source ELSE 'unknown source' END || ' — Document ' || doc_id || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS block FROM h WHERE rank <= 5 GROUP BY lang""",
    "required_provenance": """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 OR trim(coalesce(source, '')) = '' THEN 'source' END, CASE WHEN doc_id % 4 = 0 THEN 'pub_date' END, CASE WHEN doc_id % 5 = 1 THEN 'temporal' END], lambda x: x IS NOT NULL), ',') AS missing,
        array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'temporal' END, CASE WHEN doc_id % 7 = 0 THEN 'validation' END], lambda x: x IS NOT NULL), ',') AS wrong,
        NOT (doc_id % 3 = 0 OR trim(coalesce(source, '')) = '' OR doc_id % 4 = 0 OR doc_id % 5 <= 1 OR doc_id % 7 = 0) AS ok FROM documents""",
    "cited_numbers": f"WITH {_DRAFTS} SELECT draft_id, {_TEXT(_cites_sql('draft'))} AS cited FROM drafts",
    "number_tokens": f"WITH {_DRAFTS} SELECT draft_id, {_TEXT(_TOKENS(_BARE))} AS numbers FROM drafts",
    "evidence_union": f"WITH {_EVIDENCE} SELECT n, kind, source, title, pub_date, validation, temporal, doc_id, adjusted, CAST(length(text) AS INT) AS n_chars FROM ev",
    "evidence_stats": f"WITH {_EVIDENCE} SELECT count(*) FILTER (feed = 'forecast') AS forecast_hits, count(*) FILTER (feed = 'retrospective') AS retrospective_hits, bool_or(feed = 'conditions') AS conditions, bool_or(feed = 'calendar') AS calendar, bool_or(feed <> 'calendar') AS is_evidence FROM ev".replace("FILTER (", "FILTER (WHERE "),
    "evidence_feeds": f"WITH {_EVIDENCE} SELECT ord, f.feed, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n), '') AS cites, count(n) = 0 AS empty FROM (VALUES (0, 'forecast'), (1, 'retrospective'), (2, 'conditions'), (3, 'calendar')) AS f(ord, feed) LEFT JOIN ev ON ev.feed = f.feed AND kind <> 'conditions' GROUP BY ord, f.feed",
    "grouped_sources": f"WITH {_EVIDENCE} SELECT coalesce(doc_id, kind || '-' || n) AS key, min(n) AS first_n, arg_min(coalesce(source, 'unknown source'), n) AS source, arg_min(title, n) AS title, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS cites FROM ev GROUP BY 1",
    "sources_text": f"WITH {_EVIDENCE} SELECT string_agg('[' || n || '] ' || concat_ws(' — ', coalesce(nullif(trim(source), ''), 'unknown source'), title, pub_date, 'validation: ' || validation), chr(10) ORDER BY n) AS sources FROM ev",
    "phantom_citations": f"WITH {_CHECKED} SELECT draft_id, CAST(unnest(phantom) AS INT) AS n FROM chk",
    "uncited_paragraphs": f"WITH {_CHECKED} SELECT draft_id, CAST(generate_subscripts(uncited, 1) - 1 AS INT) AS at, substr(unnest(uncited), 1, 70) AS paragraph FROM chk",
    "groundedness_report": f"WITH {_CHECKED} SELECT draft_id, len(missing) = 0 AND NOT own AND len(cited) > 0 AND len(phantom) = 0 AND len(uncited) = 0 AS passed, {_TEXT('cited')} AS cited, {_TEXT('phantom')} AS phantom, CAST(len(missing) AS INT) AS n_missing, own AS own_sources, CAST(len(uncited) AS INT) AS n_uncited, CAST(len(unverified) AS INT) AS n_unverified FROM chk",
    "brief_claims": f"WITH {_CLAIMS} SELECT draft_id, claim, section, text, {_TEXT('cites')} AS cites FROM claims",
    "claim_edges": f"WITH {_CLAIMS}, {_EDGES} SELECT draft_id, src, dst FROM edges",
    "provenance_reachability": f"""WITH RECURSIVE {_CLAIMS}, {_EDGES}, named AS (SELECT DISTINCT CASE WHEN starts_with(src, 'claim-') THEN draft_id || '/' || src ELSE src END AS src, CASE WHEN starts_with(dst, 'claim-') THEN draft_id || '/' || dst ELSE dst END AS dst FROM edges),
        walk AS (SELECT s AS start, s AS node FROM (VALUES ('cite-1'), ('cite-7')) AS v(s) UNION SELECT w.start, e.dst FROM walk w JOIN named e ON e.src = w.node) SELECT start, node FROM walk""",
    "document_traces": f"WITH {_LIB} SELECT row_id, CASE WHEN row_id % 4 <> 0 THEN 'https://example.org/' || row_id END AS source_url, CASE WHEN length(text) % 2 = 0 THEN 'archive/' || doc_id END AS archived_copy, doc_id FROM lib",
    "page_text_extract": r"""WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
        said AS (SELECT page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM bare) SELECT page_id, CAST(length(text) AS INT) AS n_chars, md5(text) AS digest FROM said""",
    "used_citations": f"WITH {_EVIDENCE}, {_CLAIMS} SELECT n, kind, n IN (SELECT unnest(cites) FROM claims) AS used FROM ev",
}
ORACLE_SQL["vector_topk_pruned"] = ORACLE_SQL["vector_topk_many"]
