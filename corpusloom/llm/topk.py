"""Exact top-k by inner product: columnar branch and bound.

Rows are hashed into blocks, and a block is laid out by dimension. For a query, partial products are
accumulated a few dimensions at a time, those with the query's largest components first. What the
other dimensions can still add is at most the product of the remaining lengths of the two vectors
(Cauchy-Schwarz): once a row's highest possible score is below the k-th best lowest possible score,
it is dropped, and the survivors are compacted before the next dimensions are read.

Queries are a stated set against all rows: blocks of queries meet blocks of rows, each pair of
blocks in a task of its own, and only k rows of a query leave it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.vectors import matrix

ROWS, QUERIES, DIMS = 16_384, 1024, 8
_EXACT = 2.0**52


def scaled(vector: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of each component, as integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))


class Block:
    """Vectors in vertical layout with the lengths that bound what is left of a product."""

    def __init__(self, rows: np.ndarray):
        self.columns = np.ascontiguousarray(rows.T)
        self.squares = self.columns.astype(np.float64) ** 2
        self.lengths = self.squares.sum(axis=0)

    def best(self, query: np.ndarray, alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``alive`` that may be among the k best, with their exact scores."""
        order = np.argsort(-np.abs(query.astype(np.float64)), kind="stable")
        score = np.zeros(len(alive), query.dtype)
        left = self.lengths[alive]
        own = float((query.astype(np.float64) ** 2).sum())
        for i in range(0, len(order), DIMS):
            dims = order[i : i + DIMS]
            at = np.ix_(dims, alive)
            score = score + query[dims] @ self.columns[at]
            left = left - self.squares[at].sum(axis=0)
            own -= float((query[dims].astype(np.float64) ** 2).sum())
            if len(alive) <= k or i + DIMS >= len(order):
                continue
            # A little more than the bound, so that rounding never drops a row.
            more = np.sqrt(max(own, 0.0) * np.maximum(left, 0.0)) * (1 + 1e-6) + 1e-3
            floor = np.partition(score - more, len(alive) - k)[len(alive) - k]
            keep = score + more >= floor
            alive, score, left = alive[keep], score[keep], left[keep]
        return alive, score


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best rows (all, if fewer).

    ``rows`` is (vec_id, vector) and ``queries`` is (query_id, vector), vectors of long. The score
    is the inner product, a shorter vector being filled up with zeros; ties go to the smaller
    vec_id. A row with the query's own id is no candidate. Rows with a null id or vector, or null
    components, take no part; repeated rows are candidates each on its own, repeated queries are
    one (the smallest vector counts). Scores must fit a long. Other columns are ignored; without
    rows or queries the result is empty.
    """
    whole = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull()), F.lit(False))
    rows = rows.filter(F.col("vec_id").isNotNull() & whole(F.col("vector")))
    queries = queries.filter(F.col("query_id").isNotNull() & whole(F.col("vector")))
    queries = queries.groupBy("query_id").agg(F.min("vector").alias("vector"))
    size = rows.agg(
        F.count("*").alias("n"),
        F.max(F.size("vector")).alias("dims"),
        F.max(F.array_max(F.transform("vector", F.abs))).cast("double").alias("most"),
    ).first()
    asked = queries.agg(
        F.count("*").alias("n"),
        F.max(F.size("vector")).alias("dims"),
        F.max(F.array_max(F.transform("vector", F.abs))).cast("double").alias("most"),
    ).first()
    dims = max(size["dims"] or 0, asked["dims"] or 0, 1)
    exact = (size["most"] or 0) * (asked["most"] or 0) * dims < _EXACT
    kind = np.float64 if exact else np.int64  # whole numbers below 2^52 are exact as doubles
    row_blocks = -(-size["n"] // ROWS) or 1
    query_blocks = -(-asked["n"] // QUERIES) or 1

    def spread(df: DataFrame, name: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.withColumns(
            {
                name: F.pmod(F.xxhash64(df.columns[0]), F.lit(blocks)),
                other: F.explode(
                    F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))
                ),
            }
        )

    left = spread(rows.select("vec_id", "vector"), "r", row_blocks, "q", query_blocks)
    right = spread(queries.select("query_id", "vector"), "q", query_blocks, "r", row_blocks)

    def search(some: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(some) and len(asking):
            ids = some["vec_id"].to_numpy(np.int64)
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            block = Block(matrix(some["vector"], dims, kind)[order])
            wanted = matrix(asking["vector"], dims, kind)
            for q, vector in zip(asking["query_id"], wanted, strict=True):
                own, end = np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right")
                alive = np.r_[0:own, end : len(ids)]
                alive, score = block.best(vector, alive, k)
                best = np.lexsort([ids[alive], -score])[:k]
                found.append(
                    pd.DataFrame(
                        {"query_id": q, "vec_id": ids[alive[best]], "score": score[best]}
                    )
                )
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(np.int64)
        return pd.concat(found).astype(np.int64)

    hits = (
        left.groupBy("r", "q")
        .cogroup(right.groupBy("r", "q"))
        .applyInPandas(search, "query_id long, vec_id long, score long")
    )
    # Each task ranks what it has before rows are shuffled by query.
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
