"""A library of documents: ingest by content, chunks, filtered search by vector, numbered sources.

A chunk, its metadata and its embedding are one row, so they can't come apart.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridquill.functions import text as tx
from gridquill.functions import vectors as vx
from gridquill.operators import nearest

TOP_K, MOST_K, FLOOR, TARGET = 5, 50, 0.5, 1800


def content_ids(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id): the id of each document's text; equal texts share one."""
    return docs.select("row_id", "doc_id")


def ingest(incoming: DataFrame, stored: DataFrame | None = None, meta: Sequence[str] = ("source", "temporal")) -> DataFrame:
    """(doc_id, text, first_row, rows, meta...., status): what the library holds after incoming rows (row_id,
    doc_id, text, meta...) have come in the order of row_id.

    A text that is new is added once; one that is there has its metadata replaced by the last row's, in
    place; metadata that doesn't differ changes nothing.  status: new, updated, unchanged, or kept for
    documents that no row came for.  Only ids and metadata are aggregated; each text is taken from its first row."""
    order = F.col("row_id")
    coming = incoming.groupBy("doc_id").agg(F.min(order).alias("first_row"), F.count("*").alias("rows"), F.max_by(F.struct(*meta), order).alias("last"))
    texts = incoming.select(F.col("row_id").alias("__row"), "text")
    found = coming.join(texts, F.col("first_row") == F.col("__row")).drop("__row")
    named = [F.col(f"last.{m}").alias(m) for m in meta]
    if stored is None:
        return found.select("doc_id", "text", "first_row", "rows", *named, F.lit("new").alias("status"))
    old = stored.select("doc_id", F.col("text").alias("__text"), F.col("first_row").alias("__first"), F.struct(*meta).alias("__meta"))
    both = found.join(old, "doc_id", "full_outer")
    came, there = F.col("last").isNotNull(), F.col("__meta").isNotNull()
    status = F.when(came & ~there, "new").when(~came, "kept").when(F.col("last").eqNullSafe(F.col("__meta")), "unchanged").otherwise("updated")
    return both.select(
        "doc_id", F.coalesce("__text", "text").alias("text"), F.coalesce("__first", "first_row").alias("first_row"), F.coalesce("rows", F.lit(0)).alias("rows"),
        *(F.when(came, F.col(f"last.{m}")).otherwise(F.col(f"__meta.{m}")).alias(m) for m in meta), status.alias("status"),
    )


def chunk(docs: DataFrame, target: int = TARGET, separator: str = r"\n\s*\n") -> DataFrame:
    """docs (doc_id, text, ...) with chunk_id, ord and the chunk's text, a row for each chunk."""
    rest = [c for c in docs.columns if c != "text"]
    exploded = docs.select(*rest, F.posexplode(tx.chunks(F.col("text"), target, separator)).alias("ord", "text"))
    return exploded.select(F.concat_ws(":", "doc_id", F.col("ord").cast("string")).alias("chunk_id"), *rest, "ord", "text")


def chunk_counts(docs: DataFrame, target: int = TARGET, separator: str = r"\n\s*\n") -> DataFrame:
    """docs without text, with n_chunks, how many chunks chunk() cuts a text into."""
    return docs.withColumn("n_chunks", F.coalesce(F.size(tx.chunks(F.col("text"), target, separator)), F.lit(0))).drop("text")


def pick_chunks(docs: DataFrame, keys: DataFrame, target: int = TARGET, separator: str = r"\n\s*\n") -> DataFrame:
    """keys (doc_id, ord, ...) with the chunk's text: of all documents only those of the keys, a bounded result of a search, are cut."""
    wanted = F.broadcast(keys.select("doc_id").distinct())
    texts = chunk(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), target, separator).select("doc_id", "ord", "text")
    return keys.join(texts, ["doc_id", "ord"])


def documents(chunks: DataFrame, meta: Sequence[str] = ("source",)) -> DataFrame:
    """(doc_id, n_chunks, meta of the first chunk...)."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min_by(F.struct(*meta), "ord").alias("m")).select("doc_id", "n_chunks", "m.*")


def matches(chunks: DataFrame, filters: Mapping[str, Any]) -> Column:
    """Scalars match in any case, lists if they share an element; empty filters are none.  A null never matches."""
    kinds = dict(chunks.dtypes)
    cond = F.lit(True)
    for name, want in filters.items():
        wants = [w for w in (want if isinstance(want, (list, tuple, set)) else [want]) if w not in (None, "")]
        if not wants:
            continue
        if kinds[name].startswith("array"):
            one = F.arrays_overlap(F.transform(F.col(name), lambda x: F.lower(x.cast("string"))), F.array(*(F.lit(str(w).lower()) for w in wants)))
        else:
            one = F.lower(F.col(name).cast("string")).isin([str(w).lower() for w in wants])
        cond = cond & F.coalesce(one, F.lit(False))
    return cond


def count(chunks: DataFrame, **filters: Any) -> DataFrame:
    return chunks.where(matches(chunks, filters)).agg(F.count("*").alias("n"))


def search(chunks: DataFrame, query: Sequence[float], k: int = TOP_K, floor: float | None = None, id_col: str = "chunk_id", vector_col: str = "embedding", **filters: Any) -> DataFrame:
    """The k nearest of the chunks that match the filters, those under the floor taken away afterwards; score is
    rounded to 4 places, ties go by id.  A sort with a limit keeps k rows a task, whatever the library's size."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = chunks.where(matches(chunks, filters)).withColumn("__sim", vx.cosine(F.col(vector_col), q))
    top = scored.orderBy(F.round("__sim", 4).desc(), id_col).limit(max(int(k), 0))
    if floor is not None:
        top = top.where(F.col("__sim") >= floor)
    return top.withColumn("score", F.round("__sim", 4)).drop("__sim")


def search_by(keys: DataFrame, sims: DataFrame, by: str, k: int = TOP_K, id_col: str = "chunk_id", vector_id: str = "vec_id") -> DataFrame:
    """keys (id, by, vector id, ...) with score and rank: the k nearest of each value of by, as search() orders them.

    sims (vector id, sim) has what each vector scores, so neither vectors nor texts are shuffled; Spark keeps k rows of each
    value in front of its exchange."""
    scored = keys.join(sims, vector_id).withColumn("score", F.round("sim", 4)).drop("sim")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def similarities(vectors: DataFrame, query: Sequence[float], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, sim) of every vector."""
    return vectors.select(id_col, vx.cosine(F.col(vector_col), F.array(*(F.lit(float(x)) for x in query))).alias("sim"))


def search_many(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "chunk_id", vector_col: str = "embedding", block: int = nearest.QUERY_BLOCK) -> DataFrame:
    """(query_id, chunk id, score, rank): the k nearest chunks of every query (query_id, vector).

    Queries are counted and dealt into blocks of about `block`, chunks into parts, and every block meets every part in a task of its
    own, which holds no more than these two, however many there are of either.  Each keeps the best of its own chunks
    before the partial results meet by query."""
    blocks = max(1, -(-queries.count() // block))
    parts = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chunks.count() // nearest.VECTOR_BLOCK))
    none = F.lit(None).cast("double")
    mine = chunks.select(F.col(id_col).alias("id"), vx.normalised(F.col(vector_col)).alias("v"), none.alias("far"), nearest.dealt(id_col, parts).alias("part"))
    asked = queries.select("query_id", vx.normalised(F.col("vector")).alias("q"), none.alias("away"), none.alias("reach"), nearest.dealt("query_id", blocks).alias("block"))
    rows = nearest.meet(mine.select("*", nearest.every("block", blocks)), asked.select("*", nearest.every("part", parts)), ["part", "block"], k).drop("compared")
    # A row number with a limit is turned into a partial top-k in front of the shuffle.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def decline_note(n_docs: Column, n_match: Column, n_hits: Column, floor: float) -> Column:
    """Why a search has no result; null if it has one."""
    return (
        F.when(n_hits > 0, F.lit(None).cast("string"))
        .when(n_docs == 0, F.lit("the library is empty"))
        .when(n_match == 0, F.lit("no document matches the filters"))
        .otherwise(F.lit(f"no document is relevant enough (floor {floor:g})"))
    )


def search_report(chunks: DataFrame, query: Sequence[float], k: int = TOP_K, floor: float = FLOOR, id_col: str = "chunk_id", **filters: Any) -> DataFrame:
    """One row: n_docs, n_match, n_hits, note."""
    hits = search(chunks, query, k, floor, id_col, **filters).agg(F.count("*").alias("n_hits"))
    sums = chunks.agg(F.count("*").alias("n_docs"), F.count_if(matches(chunks, filters)).alias("n_match"))
    return sums.join(F.broadcast(hits), how="cross").select("n_docs", "n_match", "n_hits", decline_note(F.col("n_docs"), F.col("n_match"), F.col("n_hits"), floor).alias("note"))


def trace(doc_id: Column, url: Column, archived: Column, prefix: str = "") -> Column:
    """struct<source_url, archived_copy, doc_id>: where a citation leads; archived_copy is null where no copy is kept."""
    return F.struct(tx.blank_to_null(url).alias("source_url"), F.when(archived, F.concat(F.lit(prefix), doc_id)).alias("archived_copy"), doc_id.alias("doc_id"))


def source_line(n: Column, source: Column, *more: Column) -> Column:
    """[n] source — what else there is."""
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.concat_ws(" — ", F.coalesce(tx.blank_to_null(source), F.lit("unknown source")), *(tx.blank_to_null(m) for m in more)))


def source_block(hits: DataFrame, by: Sequence[Column], fields: Sequence[str] = (), id_cols: Sequence[str] = ()) -> DataFrame:
    """(id_cols, n, block): ranked hits as a numbered block of evidence; hits are the bounded result of a search."""
    rank = F.row_number().over(Window.partitionBy(*id_cols).orderBy(*by))
    numbered = hits.withColumn("__n", rank)
    lines = F.concat(source_line(F.col("__n"), F.col("source"), *(F.col(f) for f in fields)), F.lit("\n"), F.col("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), lines.alias("line")))), lambda x: x["line"])
    return numbered.groupBy(*id_cols).agg(F.count("*").alias("n"), F.array_join(ordered, "\n\n").alias("block"))


def require_provenance(docs: DataFrame, required: Sequence[str], enums: Mapping[str, Sequence[str]]) -> DataFrame:
    """docs with missing, the required fields that are blank, wrong, the fields whose value isn't one of theirs, and ok."""
    missing = F.filter(F.array(*(F.when(tx.blank_to_null(F.col(f)).isNull(), F.lit(f)) for f in required)), lambda x: x.isNotNull())
    bad = F.filter(F.array(*(F.when(tx.blank_to_null(F.col(f)).isNotNull() & ~F.col(f).isin(list(v)), F.lit(f)) for f, v in enums.items())), lambda x: x.isNotNull())
    return docs.withColumns({"missing": missing, "wrong": bad}).withColumn("ok", (F.size("missing") == 0) & (F.size("wrong") == 0))
