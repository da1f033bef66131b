"""Exact nearest vectors by lists that distances allow to skip.

Vectors of unit length are dealt to lists by the nearest of some centres, which are fitted on a bounded sample.  The distance of a vector
to its centre and that of a query to the same centre bound how near the two can be, by the triangle inequality.  So a query first
looks into its nearest list, whose k-th score is a bound; of the other lists only those are read that may hold a better one, and in
them only vectors that may be.  The result is that of comparing everything; a bad sample only makes it slower.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridquill.functions import vectors as vx
from gridquill.operators import nearest
from gridquill.operators.retrieval import TOP_K
from gridquill.sources.shared import cut, work_dir

#: Lists, vectors that the centres are fitted on at most, and rounds of the fit.
LISTS, SAMPLE, ROUNDS = 64, 4096, 8
#: Scores are rounded to four places, so a bound within this of a score is no reason to skip.
SLACK = 0.5e-4 + 1e-9


def fit_centres(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """(lists, d) centres of unit length from at most `sample` vectors, those of the smallest hashes of their ids."""
    rows = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vector_col).collect()
    x = np.array([r[0] for r in rows], dtype=float)
    if not len(x):
        return np.zeros((0, 0))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[np.random.default_rng(5).permutation(len(x))[:lists]].copy()
    for _ in range(ROUNDS):
        nearest = np.argmax(x @ centres.T, axis=1)
        for i in range(len(centres)):
            mine = x[nearest == i]
            if len(mine):
                centres[i] = mine.mean(axis=0) / max(np.linalg.norm(mine.mean(axis=0)), 1e-12)
    return centres


def distance(score: Column) -> Column:
    """Of two unit vectors, from their cosine."""
    return F.sqrt(F.greatest(2 - 2 * score, F.lit(0.0)))


def centre_scores(v: Column, centres: np.ndarray) -> Column:
    """array<struct<score, list>>, a literal row for each centre."""
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in centres))
    return F.transform(rows, lambda c, i: F.struct(vx.dot(v, c).alias("score"), i.alias("list")))


def index(vectors: DataFrame, centres: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v, list, far): every vector at unit length, its list and its distance to the list's centre."""
    unit = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), vx.normalised(F.col(vector_col)).alias("v"))
    best = F.array_max(centre_scores(F.col("v"), centres))
    return unit.withColumn("best", best).select("id", "v", F.col("best.list").alias("list"), distance(F.col("best.score")).alias("far"))


def search_pruned(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = TOP_K) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, score, rank), (lists, skipped, vectors, compared)): the k nearest of every query (query_id, vector), and how much was
    looked at.  indexed is a written table; queries meet the vectors of a list by the list's parts, and a task hands on the best alone."""
    spark = indexed.sparkSession
    path = work_dir(spark, "pruned")
    lists = indexed.groupBy("list").agg(F.max("far").alias("most"), F.min("far").alias("least"), F.count("*").alias("n"))
    q = queries.select("query_id", vx.normalised(F.col("vector")).alias("q"))
    near = q.withColumn("c", F.explode(centre_scores(F.col("q"), centres))).select("query_id", "q", F.col("c.list").alias("list"), distance(F.col("c.score")).alias("away"))
    # Lists are LISTS rows; the nearest that has vectors is looked into first.
    known = near.join(F.broadcast(lists), "list")
    order = Window.partitionBy("query_id").orderBy("away", "list")
    plan = cut(known.withColumn("turn", F.row_number().over(order)), f"{path}/plan")
    # Lists are cut into parts and queries into blocks, so that a task holds a part and a block at most.
    blocks = max(1, -(-queries.count() // nearest.QUERY_BLOCK))
    sizes = lists.select("list", F.ceil(F.col("n") / nearest.VECTOR_BLOCK).cast("int").alias("parts"))
    cells = indexed.join(F.broadcast(sizes), "list").withColumn("part", nearest.dealt("id", F.col("parts"))).select("*", nearest.every("block", blocks))

    def scored(pairs: DataFrame) -> DataFrame:
        asked = pairs.join(F.broadcast(sizes), "list").withColumn("block", nearest.dealt("query_id", blocks)).select("*", nearest.every("part", F.col("parts")))
        return nearest.meet(cells, asked, ["list", "part", "block"], k)

    first = cut(scored(plan.where("turn = 1").withColumn("reach", F.lit(None).cast("double"))), f"{path}/first")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    floor = first.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    # A score above the floor needs a distance below this; without k scores nothing is too far.
    reach = F.when(F.col("floor").isNull(), F.lit(2.0)).otherwise(distance(F.col("floor") - SLACK)) + 1e-9
    rest = plan.where("turn > 1").join(floor, "query_id", "left").withColumn("reach", reach)
    open_ = cut(rest.where((F.col("away") - F.col("most") <= F.col("reach")) & (F.col("least") - F.col("away") <= F.col("reach"))), f"{path}/open")
    more = cut(scored(open_), f"{path}/more")
    top = first.unionByName(more).drop("compared").withColumn("rank", rank).where(F.col("rank") <= k)
    sums = plan.agg(F.count("*").alias("lists"), F.sum("n").alias("vectors"), F.count_if(F.col("turn") == 1).alias("__first"))
    seen = open_.agg(F.count("*").alias("__open"))
    compared = first.unionByName(more).agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
    report = sums.join(F.broadcast(seen), how="cross").join(F.broadcast(compared), how="cross")  # a row each
    return top, report.select("lists", (F.col("lists") - F.col("__first") - F.col("__open")).alias("skipped"), "vectors", "compared")


def search_many_pruned(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, lists: int = LISTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank), as retrieval.search_many, by an index made for the purpose."""
    centres = fit_centres(vectors, lists, id_col=id_col, vector_col=vector_col)
    if not len(centres):
        return queries.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    written = cut(index(vectors, centres, id_col, vector_col), work_dir(vectors.sparkSession, "lists"))
    return search_pruned(written, centres, queries, k)[0]
