"""op8: language-model scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import kneser_ney
from corpusloom.llm.tables import read


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)
    )
    docs = docs.select("doc_id", held_out.alias("held_out"), "text")
    model = kneser_ney.train(docs.filter(~F.col("held_out")).select("text"))
    return kneser_ney.score(docs, model)


QUERIES = {"op8_kneser_ney": (op8, None)}
