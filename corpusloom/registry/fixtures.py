"""Tables that registered queries derive from the given ones, on the Spark side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.vectors import hash_vector
from corpusloom.operators.augmentation import chunk_questions, complete, question_prompts
from corpusloom.operators.chunking import ChunkOptions, chunk_markdown
from corpusloom.operators.cleaning import clean_markdown
from corpusloom.operators.indexing import index_rows
from corpusloom.plans.build import build_rows, chunk_corpus, embed_queries
from corpusloom.registry.base import built, dealt, table
from corpusloom.registry.sql import MARKDOWN

MD_OPTIONS = ChunkOptions(chunk_size=300, overlap=50, min_chars=60)


def md_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, markdown), one document per conversation turn."""
    turns = dealt(table(spark, folder, "conversations"))
    return turns.selectExpr("conv_id * 1000000 + turn AS doc_id", f"{MARKDOWN} AS markdown")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, markdown) of the plain documents."""
    docs = dealt(table(spark, folder, "documents"))
    return docs.select("doc_id", F.col("text").alias("markdown"))


@built("md_chunks")
def md_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_markdown(clean_markdown(md_corpus(spark, folder)), MD_OPTIONS)


def user_queries(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, query): what users said."""
    turns = table(spark, folder, "conversations").filter("role = 'user'")
    return turns.selectExpr("conv_id * 1000000 + turn AS query_id", "text AS query")


def question_model(prompts: list[str]) -> list[str]:
    """Stands in for a chat model: two list items about the text, or a failure."""
    answers = []
    for prompt in prompts:
        text = prompt.split("Text:\n", 1)[1]
        if len(text) % 2:
            raise ValueError("no answer")
        head, opening = text.split("\n")[0], text[:50].replace("\n", " ")
        answers.append(f"1. What does {head} say?\n\n- {opening}\n")
    return answers


@built("md_completions")
def md_completions(spark: SparkSession, folder: str) -> DataFrame:
    return complete(question_prompts(md_chunks(spark, folder), 2), question_model)


def md_questions(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_questions(md_completions(spark, folder), 2)


def md_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows of the markdown corpus, without vectors."""
    return index_rows(md_chunks(spark, folder), md_questions(spark, folder))


@built("md_index")
def md_index(spark: SparkSession, folder: str) -> DataFrame:
    return md_rows(spark, folder).withColumn("vector", hash_vector(F.col("document")))


@built("document_index")
def document_index(spark: SparkSession, folder: str) -> DataFrame:
    """Index table of the plain documents under the default settings."""
    return build_rows(chunk_corpus(documents(spark, folder)))


@built("asked")
def asked(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, query, vector) of all user turns."""
    return embed_queries(user_queries(spark, folder))


@built("vectors")
def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The given embeddings as an index whose parents are the ten labels."""
    return dealt(table(spark, folder, "embeddings")).selectExpr(
        "CAST(label AS BIGINT) AS doc_id",
        "printf('v%06d', vec_id) AS row_id",
        "concat('l', label) AS parent_id",
        "vec_id AS query_id",
        "CAST(embedding AS ARRAY<DOUBLE>) AS vector",
    )


REVIEWS = """
SELECT d.doc_id AS seq,
  'Is ' || d.lang || ' text ' || CAST(d.doc_id % 7 AS STRING) || ' of use?' AS question,
  'c' || CAST(d.doc_id % 11 AS STRING) AS chunk_id,
  CASE WHEN l.toxic = 1 THEN 'unjudged' WHEN l.quality = 1 THEN 'relevant'
       ELSE 'not relevant' END AS verdict,
  d.source AS note, d.lang AS section, round((d.n_chars % 997) / 997e0, 4) AS similarity,
  CASE WHEN d.doc_id % 2 = 0 THEN 'chunk' ELSE 'question' END AS match_type,
  CAST(1 + d.doc_id % 5 AS INT) AS rank
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Judgements made from the labels of documents, several per question and chunk."""
    return spark.sql(
        REVIEWS,
        documents=table(spark, folder, "documents"),
        labels=table(spark, folder, "labels"),
    )
