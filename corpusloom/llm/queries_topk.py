"""op4: exact top-k search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import topk
from corpusloom.llm.tables import read
from corpusloom.llm.vectors import usable


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        read(spark, sf_dir, "embeddings")
        .filter(usable(F.col("embedding")))
        .select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    )
    queries = rows.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return topk.top_k(rows, queries, 10)


SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
    FROM v q JOIN v r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

QUERIES = {"op4_branch_and_bound": (op4, SQL)}
