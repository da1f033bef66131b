"""The nearest vectors of a block of queries among a block of vectors, where the two meet in a task.

One matrix product finds which pairs may be among a query's best; only these are scored as `vectors.dot` does it, term by
term, and rounded as `round(score, 4)` does, so the result is that of scoring every pair in a Column.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries and vectors of a block, about: what a task holds of either.  Queries of one matrix product.
QUERY_BLOCK, VECTOR_BLOCK, STEP = 4096, 16384, 128
#: A score that is rounded to four places stands above one that is larger by no more than this.
SLACK = 1e-4 + 1e-9


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(n, d) of a column of lists, short ones filled with 0, and their lengths; -1 for nulls and lists with nulls."""
    rows = column.combine_chunks()
    if isinstance(rows, pa.ChunkedArray):  # no chunk at all
        return np.zeros((0, 0)), np.zeros(0, dtype=np.int64)
    n, flat = len(rows), rows.flatten()
    sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.where(rows.is_null().to_numpy(zero_copy_only=False), -1, sizes)
    at = np.repeat(np.arange(n), sizes)
    if flat.null_count:
        lengths[at[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).astype(float, copy=False)
    d = int(sizes.max(initial=0))
    if (sizes == d).all():
        return values.reshape(n, d), lengths
    full = np.zeros((n, d))
    full[at, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return full, lengths


def rounded(scores: np.ndarray, places: int = 4) -> np.ndarray:
    """As Spark's round: half up, on the number as it is printed."""
    size = np.abs(scores) * 10.0**places
    whole = np.floor(size + 0.5)
    for i in np.flatnonzero(np.abs(size - np.floor(size) - 0.5) < 1e-6):
        whole[i] = float(Decimal(repr(float(abs(scores[i])))).scaleb(places).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(whole / 10.0**places, scores)


def best_pairs(ids: np.ndarray, v: np.ndarray, v_len: np.ndarray, q: np.ndarray, q_len: np.ndarray, k: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score, null) of the k best of each query by score and then by ids; of wanted (queries, vectors) pairs alone, if given.
    Pairs of different lengths have no score and come last."""
    d = min(v.shape[1], q.shape[1])
    with np.errstate(invalid="ignore"):
        s = q[:, :d] @ v[:, :d].T
    s[np.isnan(s)] = np.inf
    uniform = len(v_len) and len(q_len) and v_len.min() >= 0 and v_len.min() == v_len.max() == q_len.min() == q_len.max()
    if not uniform:
        s[(q_len[:, None] != v_len) | (q_len[:, None] < 0)] = -4.0
    if wanted is not None:
        s[~wanted] = -np.inf
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
    qi, vi = np.nonzero((s >= (least - SLACK)[:, None]) & (s > -np.inf))
    exact = np.zeros(len(qi))
    for j in range(d):
        exact += v[vi, j] * q[qi, j]
    odd = (q_len[qi] != v_len[vi]) | (q_len[qi] < 0)
    good = ~odd & np.isfinite(exact)
    exact[good] = rounded(exact[good])
    key = np.where(odd, -np.inf, np.where(np.isnan(exact), np.inf, exact))
    order = np.lexsort((ids[vi], -key, qi))
    qi, vi, exact, odd = qi[order], vi[order], exact[order], odd[order]
    turn = np.arange(len(qi)) - np.searchsorted(qi, qi)
    kept = turn < k
    return qi[kept], vi[kept], exact[kept], odd[kept]


def meet(vectors: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(query_id, id, score, compared): of each block the k best of vectors (keys, id, v, far) for each of queries (keys, query_id, q, away, reach).

    Where reach isn't null, only vectors are compared whose far differs from away by no more than it.  compared is how
    many a query was compared with, in one row of the query's and 0 in its others."""

    def task(mine: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if mine.num_rows and asked.num_rows:
            (v, v_len), (q, q_len) = matrix(mine["v"]), matrix(asked["q"])
            far, away, reach = (t[c].to_numpy().astype(float) for t, c in ((mine, "far"), (asked, "away"), (asked, "reach")))
            ids = np.unique(mine["id"].to_numpy(), return_inverse=True)[1]
            for at in range(0, len(q), STEP):
                part = slice(at, at + STEP)
                bound = reach[part, None]
                wanted = None if np.isnan(bound).all() else np.isnan(bound) | (np.abs(away[part, None] - far) <= bound)
                qi, vi, score, odd = best_pairs(ids, v, v_len, q[part], q_len[part], k, wanted)
                seen = np.full(len(q[part]), len(v)) if wanted is None else wanted.sum(axis=1)
                first = np.diff(qi, prepend=-1) != 0
                found.append((qi + at, vi, score, odd, np.where(first, seen[qi], 0)))
        qi, vi, score, odd, seen = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=t) for t in (int, int, float, bool, int))
        return pa.table({"query_id": asked["query_id"].take(pa.array(qi)), "id": mine["id"].take(pa.array(vi)), "score": pa.array(score, mask=odd), "compared": pa.array(seen, pa.int64())})

    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["id"]
    left, right = vectors.select(*keys, "id", "v", "far"), queries.select(*keys, "query_id", "q", "away", "reach")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(task, f"query_id {kinds[0]}, id {kinds[1]}, score double, compared long")


def dealt(column: str, n: int | Column) -> Column:
    """A number below n, by a hash."""
    return F.pmod(F.xxhash64(column), n if isinstance(n, Column) else F.lit(n)).cast("int")


def every(name: str, n: int | Column) -> Column:
    """A row for each number below n."""
    return F.explode(F.sequence(F.lit(0), (n if isinstance(n, Column) else F.lit(n)) - 1)).alias(name)
