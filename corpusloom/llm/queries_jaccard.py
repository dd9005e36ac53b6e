"""op10: n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import jaccard
from corpusloom.llm.tables import read


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op10_pigeonhole_join": (op10, None)}
