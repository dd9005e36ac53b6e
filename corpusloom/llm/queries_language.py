"""op2: language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import language
from corpusloom.llm.tables import read


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)
    )
    net = language.learn(docs.filter(~held_out).select("text", "lang"))
    texts = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language.predict(texts, net).drop("text")


QUERIES = {"op2_byte_network": (op2, None)}
