"""Exact top-k inner products by Fagin's threshold algorithm, in blocks.

Candidates are dealt to shards and queries to blocks, both of bounded size, by hash. A shard holds one list per
dimension, sorted by component. For a query, the lists are read from the end that adds most to the score (the high end
where the query's component is positive, the low end where it is negative; lists of zero components are not read), a deeper slice of all lists in each round. Each vector
seen for the first time is scored whole. A round ends with the bound, the score of a vector that would stand at the current depth of every list; when the
bound is below the k-th score, no unseen vector can enter, not even by a tie. The shards' results are merged by a window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates in a shard and queries in a block, on average. A shard is shuffled once for each block, so blocks are large.
SHARD_ROWS, BLOCK_ROWS = 16384, 16384
FIRST_SLICE = 16


class ThresholdLists:
    """The sorted lists of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        # integer arithmetic in floating point while every sum is exact there, else in 64-bit integers
        most = float(np.abs(vectors.astype(np.float64)).max(initial=0.0))
        self.kinds = [(np.float32, 2.0**24), (np.float64, 2.0**53), (np.int64, np.inf)]
        self.most, self.ids, self.wide = most, ids, vectors
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, order, axis=0)
        self.order = np.ascontiguousarray(order.T)  # a row for each dimension
        self.as_kind: dict = {}
        self.stopped = 0  # the depth at which the search before stopped: the next begins with a slice of half that

    def _vectors(self, query: np.ndarray) -> tuple[np.ndarray, type]:
        reach = self.most * float(np.abs(query.astype(np.float64)).sum())
        kind = next(k for k, top in self.kinds if reach < top)
        if kind not in self.as_kind:
            self.as_kind[kind] = self.wide.astype(kind)
        return self.as_kind[kind], kind

    def search(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best but the query's own rows, best first, ties to the smaller id."""
        vectors, kind = self._vectors(query)
        asked = query.astype(kind)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        m = len(self.ids)
        fresh = self.ids != query_id
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, slice_rows = 0, max(FIRST_SLICE, self.stopped // 2)
        while depth < m:
            until = min(m, depth + slice_rows)
            if len(up) + len(down):
                seen = np.zeros(m, bool)
                seen[self.order[up, m - until : m - depth].ravel()] = True
                seen[self.order[down, depth:until].ravel()] = True
                new = np.flatnonzero(seen & fresh)
            else:  # every score is 0: all that is left is the order of ids
                new, until = np.flatnonzero(fresh), m
            if len(new):
                fresh[new] = False
                ids = np.concatenate([ids, self.ids[new]])
                # a product with all rows costs less than a copy of most of them
                fresh_scores = (vectors @ asked)[new] if 3 * len(new) > m else vectors[new] @ asked
                scores = np.concatenate([scores, fresh_scores.astype(np.int64)])
                if len(ids) > 4 * k:
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    ids, scores = ids[scores >= least], scores[scores >= least]
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if until == m:
                break
            bound = int(self.sorted[m - until, up].astype(np.int64) @ query[up]) + int(self.sorted[until - 1, down].astype(np.int64) @ query[down])
            if len(ids) == k and bound < scores[-1] or not fresh.any():
                break
            depth, slice_rows = until, slice_rows * 2
        self.stopped = until if m else 0
        return ids, scores


def _stacked(vectors: pd.Series, size: int) -> np.ndarray:
    return np.concatenate([np.asarray(v, dtype=np.int64) for v in vectors]).reshape(-1, size) if size and len(vectors) else np.zeros((len(vectors), size), np.int64)


def _search_block(key: tuple, candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(candidates) or not len(queries):
        return pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}).astype("int64")
    size = int(key[0])
    lists = ThresholdLists(candidates["vec_id"].to_numpy(np.int64), _stacked(candidates["vector"], size))
    asked, out = _stacked(queries["vector"], size), []
    for at, (query_id, row) in enumerate(zip(queries["vec_id"].tolist(), queries["query_row"].tolist(), strict=True)):
        ids, scores = lists.search(asked[at], query_id, k)
        out.append((np.full(len(ids), query_id), np.full(len(ids), row), ids, scores))
    return pd.DataFrame(dict(zip(["query_id", "query_row", "vec_id", "score"], (np.concatenate(x) for x in zip(*out, strict=True)), strict=True))).astype("int64")


def exact_top_k(vectors: DataFrame, queries: DataFrame, *, k: int, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k highest inner products over ``vectors`` (arrays of long).

    Rows with the query's own id are not its candidates; ties go to the smaller id; fewer candidates give fewer rows. Rows whose id or
    vector is null or whose vector holds a null take no part. Vectors meet only vectors of their own length; vectors of no components score 0.
    A repeated candidate row is a candidate each time, a query repeated with its vector is answered once, a query id with two vectors is answered for each.
    Sums beyond 64 bits are not supported. Empty inputs give an empty result. Other columns are not read.
    """

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<long>").alias("vector"))
        return rows.where("vec_id is not null and vector is not null and not exists(vector, x -> x is null)").withColumn("dims", F.size("vector"))

    cand, asked = usable(vectors), usable(queries).distinct()
    n_cand, n_asked = cand.count(), asked.count()
    shards, blocks = max(1, -(-n_cand // SHARD_ROWS)), max(1, -(-n_asked // BLOCK_ROWS))
    shards = max(shards, min(6, -(-n_cand // 1024)))  # small tables still use several tasks
    by_row = F.xxhash64("vec_id", "vector")
    left = cand.withColumn("shard", F.pmod(by_row, F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = (
        asked.withColumn("query_row", by_row)
        .withColumn("block", F.pmod(by_row, F.lit(blocks)).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    keys = ["dims", "shard", "block"]
    local = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(lambda key, a, b: _search_block(key, a, b, k), "query_id long, query_row long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantise(df: DataFrame, *, vector_col: str = "embedding", out_col: str = "vector", scale: int = 64) -> DataFrame:
    """Adds floor(scale * x) of every component as an array of long; null where the vector is null or holds a null or non-finite component."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.withColumn(out_col, F.when(finite, F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v).cast("long"))))
