"""Exact top-k search by inner product with Fagin's threshold algorithm.

Candidates and queries are dealt into blocks by a hash of their ids; a task meets one block of each. It keeps, for each dimension, the block's
candidates sorted by their component. For a query it reads these lists from the end that its component's sign prefers, in
steps that grow; what it meets for the first time is scored from the whole vector. The bound for what it has not met
is the query's product with the components at the places reached. It stops when the bound is less than the kth best score (an equal
one could still win a tie), or when it has met all. Each task gives at most k rows per query; the best k of
these are the result.

* Components are floor(scale * x) of x as double, as 64-bit integers up to +-2^62. Vectors that are null, or hold a null, nan or infinite
  component, take no part, nor do rows without an id. Scores are summed in a type in which they are exact, whole numbers of any length where
  64 bits do not hold them; such a score is ranked by its exact value and shown as the largest or least 64-bit integer.
* Missing components of shorter vectors count as 0; a vector without components scores 0.
* Of rows with one id the greatest vector counts. A query never finds its own id. Ties go to the smaller id.
* An empty table, or no queries, gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
SCALE = 64
LARGEST = float(1 << 62)
#: Bytes of a score by which results are put in order.
KEY = 20
#: Vectors in a block, about: candidates, and queries.
CANDIDATES = 8192
QUERIES = 512
#: Places read from each list at first, and how much longer each next step is.
FIRST_STEP = 16
GROWTH = 3


def whole(vector: Column, scale: int = SCALE) -> Column:
    """Integer components, or null if the vector takes no part."""
    x = vector.cast("array<double>")
    fit = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(fit, F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(LARGEST)), F.lit(-LARGEST)))))


class Lists:
    """A block's candidates sorted in each dimension: row j ascends against dimension j, row dims + j descends."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        up = np.argsort(self.vectors, axis=0, kind="stable").T
        self.order = np.concatenate([up, up[:, ::-1]]).astype(np.int32)
        values = np.take_along_axis(self.vectors.T, up, axis=1)
        self.values = np.concatenate([values, values[:, ::-1]])

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, in order."""
        n, dims = self.vectors.shape
        met = np.zeros(n, bool)
        own = np.searchsorted(self.ids, query_id)
        if own < n and self.ids[own] == query_id:
            met[own] = True
        else:
            own = n
        used = np.flatnonzero(query)
        lists = np.where(query[used] > 0, used + dims, used)
        weights = query[used]
        kept, scores = np.zeros(0, np.int64), np.zeros(0, query.dtype)
        depth, step = 0, FIRST_STEP if len(used) else n
        while depth < n:
            to = min(n, depth + step)
            seen = met.copy()
            if len(used):
                seen[self.order[lists, depth:to].ravel()] = True
            else:
                seen[:] = True  # a query of zeros: all scores are 0
            new = np.flatnonzero(seen & ~met)
            met = seen
            kept, scores = np.concatenate([kept, new]), np.concatenate([scores, self.vectors[new] @ query])
            depth, step = to, step * GROWTH
            if len(kept) > k:
                kth = _kth(scores, k)
                good = scores >= kth
                kept, scores = kept[good], scores[good]
                if weights @ self.values[lists, depth - 1] < kth:
                    break
            if met.all():
                break
        order = np.lexsort((kept, -scores))[:k]
        return self.ids[kept[order]], scores[order]


def _kth(scores: np.ndarray, k: int):
    """The kth largest."""
    place = len(scores) - k
    return np.sort(scores)[place] if scores.dtype == object else np.partition(scores, place)[place]


def _matrix(vectors: list[np.ndarray], dims: int, dtype) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v.tolist() if dtype is object else v
    return out


_TOP = (1 << 63) - 1


def _searcher(k: int) -> Callable:
    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if candidates.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "key": []})
        of = [[w if v is None else v for v, w in zip(side["v"], side["w"], strict=True)] for side in (candidates, queries)]
        dims = max(1, *map(len, of[0]), *map(len, of[1]))
        most = [max((int(np.abs(v).max(initial=0)) for v in side), default=0) for side in of]
        bound = dims * most[0] * most[1]
        # a type in which all sums are exact
        dtype = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
        lists = Lists(candidates["id"].to_numpy(np.int64), _matrix(of[0], dims, dtype))
        found = [lists.best(i, q, k) for i, q in zip(queries["id"].to_numpy(np.int64), _matrix(of[1], dims, dtype), strict=True)]
        scores = [int(s) for f in found for s in f[1]]
        return pd.DataFrame({
            "query_id": np.repeat(queries["id"].to_numpy(np.int64), [len(f[0]) for f in found]), "vec_id": np.concatenate([f[0] for f in found]),
            "score": np.array([max(-_TOP - 1, min(_TOP, s)) for s in scores], np.int64), "key": [(s + (1 << 8 * KEY - 1)).to_bytes(KEY, "big") for s in scores]})

    return search


def _dealt(rows: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
    """Each row in its block, once for each block of the other side."""
    return (rows.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each row for which ``is_query`` (of column ``id``) holds."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col), scale).alias("w"))
    rows = rows.where(F.col("id").isNotNull() & F.col("w").isNotNull()).groupBy("id").agg(F.max("w").alias("w"))
    # nearly all vectors need half the bytes
    small = ~F.exists("w", lambda c: F.abs(c) >= 1 << 31)
    rows = rows.select("id", F.when(small, F.col("w").cast("array<int>")).alias("v"), F.when(~small, F.col("w")).alias("w"))
    # an upper bound of the sizes is enough for the number of blocks
    n, n_queries = vectors.select(F.col(id_col).cast("long").alias("id")).agg(F.count("id"), F.count_if(is_query)).first()
    blocks, query_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-n_queries // QUERIES))
    candidates = _dealt(rows, "block", blocks, "query_block", query_blocks)
    queries = _dealt(rows.where(is_query), "query_block", query_blocks, "block", blocks)
    found = candidates.groupBy("block", "query_block").cogroup(queries.groupBy("block", "query_block")).applyInPandas(_searcher(k), "query_id long, vec_id long, score long, key binary")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
