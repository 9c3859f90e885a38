"""Exact top-k inner-product search with block-at-a-time pruning."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import materialize

#: Vectors that one task indexes, and queries that it answers, at a time on average.
PART_ROWS, QUERY_ROWS = 16_384, 8_192
_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)


def finite(vector: Column) -> Column:
    """Whether a vector is there and none of its components is null or not finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, odd), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


class BlockIndex:
    """Vectors in ranges of block rows, alike ones together, with the largest and smallest value of every component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int = 64):
        d = vectors.shape[1]
        top = np.argsort(-np.abs(vectors), axis=1, kind="stable")[:, :2] if d > 1 else np.zeros((len(ids), 2), np.int64)
        sign = np.take_along_axis(vectors, top, axis=1) < 0 if d > 1 else np.zeros((len(ids), 2), bool)
        order = np.lexsort((ids, sign[:, 1], top[:, 1], sign[:, 0], top[:, 0]))
        self.ids, self.block, self.scored = ids[order], block, 0
        self.vectors = vectors[order]
        starts = np.arange(0, len(ids), block)
        self.most, self.least = np.maximum.reduceat(self.vectors, starts), np.minimum.reduceat(self.vectors, starts)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and block, the sum over components (terms) of the largest product a vector of it can have."""
        return np.maximum(queries, 0) @ self.most.T + np.minimum(queries, 0) @ self.least.T

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, least: float | None = None, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best vectors (of other ids), the best first, ties to the smaller id; of those with a
        score of least or more, where that is given. Blocks are scored in the order of their bounds until the next bound
        is below the k-th score, or below least; scored counts them."""
        order = np.argsort(-bounds, kind="stable")
        ids, scores, at = np.zeros(0, np.int64), np.zeros(0, query.dtype), 0
        while at < len(order):
            floor = scores[-1] if len(ids) == k else least
            now = order[at : at + step] if floor is None else order[at : at + step][bounds[order[at : at + step]] >= floor]
            if not len(now):
                break
            rows = (now[:, None] * self.block + np.arange(self.block)).ravel()
            rows = rows[rows < len(self.ids)]
            got = self.vectors[rows] @ query
            keep = self.ids[rows] != own
            if floor is not None:
                keep &= got >= floor
            ids, scores = np.concatenate([ids, self.ids[rows[keep]]]), np.concatenate([scores, got[keep]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            at, self.scored = at + step, self.scored + len(now)
        return ids, scores


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """For each query row the k rows with the highest integer inner products, its own id apart: query_id, rank (from 1),
    id, score. A component x counts as floor(scale * x), x taken as a double.

    Vectors are dealt by a hash of their ids to parts, queries to blocks; a part meets a block of queries in one task
    (a stated query set against all rows, in blocks), which builds a BlockIndex and prunes with it, and returns k rows a
    query at most. Each block of queries meets one part first; the k-th scores found there are the least that the other
    parts search for. The rows of all parts are ranked by query.

    Null vectors and those with null or non-finite components take no part, nor do rows with null ids. Vectors meet only
    vectors of their length. Of repeated query ids the smallest vector is the query; repeated rows of other ids are rows
    of their own. Ties go to the smaller id. Fewer than k others: all. Empty table: no rows. Components are exact up to
    the limits of a long, to which larger ones are set; so are scores, once those of one part have been compared.
    Columns besides the two named are not read, except by is_query."""
    rows = vectors.where(F.col(id_col).isNotNull() & finite(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("i"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    asked = rows.where("q").groupBy("i").agg(F.min("v").alias("v"))
    n, m = rows.agg(F.count("*"), F.count_if("q")).first()
    parts, blocks = max(1, math.ceil(n / PART_ROWS)), max(1, math.ceil(m / QUERY_ROWS))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.select("i", "v", F.size("v").alias("d"), F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block"))
    right = asked.select("i", "v", F.size("v").alias("d"), F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"))

    def answer(key: tuple, these: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(these) and len(queries):
            v, q = _matrix(these.column("v")), _matrix(queries.column("v"))
            large = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (v, q)]
            kind = np.float64 if large[0] * large[1] * max(1, v.shape[1]) < 1 << 53 else object
            index, q = BlockIndex(these.column("i").to_numpy(), v.astype(kind)), q.astype(kind)
            bounds = index.bounds(q)
            floors = queries.column("least").to_pylist() if "least" in queries.column_names else [None] * len(q)
            for own, query, bound, least in zip(queries.column("i").to_pylist(), q, bounds, floors, strict=True):
                ids, scores = index.search(own, query, bound, k, None if least in (_MOST, _LEAST) else least)
                out[0] += [own] * len(ids)
                out[1] += ids.tolist()
                out[2] += [min(max(int(x), _LEAST), _MOST) for x in scores]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "i", "score"), out, strict=True)})

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        keys = ("d", "part", "block")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(answer, "query_id long, i long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "i")
    if parts == 1:
        found = meet(left, right)
    else:
        first = F.col("part") == F.pmod("block", F.lit(parts))
        begun = materialize(meet(left.where(first), right.where(first)), "first")
        floors = begun.groupBy(F.col("query_id").alias("i")).agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        asks = right.where(~first).withColumnRenamed("i", "asked").join(floors.withColumnRenamed("i", "of"), F.col("asked") == F.col("of"), "left")
        found = begun.unionByName(meet(left.where(~first), asks.select(F.col("asked").alias("i"), "v", "d", "block", "part", "least")))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("i").alias(id_col), "score")
