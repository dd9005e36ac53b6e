"""From documents to packed training sequences, as a chain of stages over the llm operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written and read again as the next one's docs. All but the last return the columns of
``documents``. SQL cannot express the network, so the stages are tested against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import jaccard, language, mixing, packing
from corpusloom.llm.tables import read, ship, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is less certain than this are rejected, as are those without a letter.
LEAST_SCORE = 0.5
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the network learns from all that have a label."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    net = language.learn(docs.select("text", "lang"))
    return (
        language.predict(docs, net)
        .filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
        .select(*COLUMNS)
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked documents.

    Of rows with one doc_id any one stays; rows without a doc_id cannot be told apart and stay.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    kept = jaccard.near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    return (
        named.dropDuplicates(["doc_id"])
        .unionByName(docs.filter("doc_id IS NULL"))
        .select(*COLUMNS)
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that the mix takes over a whole document, and for each part of one."""
    ship(spark)
    mixed = mixing.mix(docs.select(*COLUMNS), keep=COLUMNS).filter("taken > 0")
    words = F.regexp_extract_all(
        F.col("row")["text"], F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)
    )
    parts = F.transform(
        "ranges",
        lambda r: F.array_join(
            F.slice(words, r["first"].cast("int") + 1, r["words"].cast("int")), ""
        ),
    )
    wholes = F.array_repeat(F.col("row")["text"], F.col("passes").cast("int"))
    return mixed.select("row", F.explode(F.concat(wholes, parts)).alias("taken_text")).select(
        "row.doc_id",
        F.col("taken_text").alias("text"),
        "row.lang",
        "row.source",
        F.length("taken_text").cast("long").alias("n_chars"),
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that hold every token of the mix."""
    ship(spark)
    return packing.pack(docs, TOKENIZER).drop("ids")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs if i == 0 else stage(docs), sf_dir)
    return docs
