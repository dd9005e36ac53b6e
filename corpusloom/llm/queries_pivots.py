"""op7: near-duplicate vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import pivots
from corpusloom.llm.tables import read


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(read(spark, sf_dir, "embeddings"))


QUERIES = {"op7_pivot_permutations": (op7, None)}
