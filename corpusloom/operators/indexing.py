"""Index rows: chunks and their questions, merged by content-derived ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_ROW = "chunk"
QUESTION_ROW = "question"


def bucket_of(doc: str | Column, buckets: int) -> Column:
    """Storage bucket of a document: all of its rows share one."""
    return F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int")


def index_rows(chunks: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """(doc_id, row_id, document, type, parent_id, chunk_index, section).

    One row per chunk and one per question; a question row points at its chunk and does
    not copy its text. ``questions`` is (doc_id, chunk_id, questions). The rows of a chunk
    come out of one join row, so the chunks are computed once.
    """
    own = F.struct(
        F.col("chunk_id").alias("row_id"), F.col("text").alias("document"), F.lit(CHUNK_ROW).alias("type")
    )
    rows = F.array(own)
    if questions is not None:
        chunks = chunks.join(
            questions.select("doc_id", "chunk_id", "questions"), ["doc_id", "chunk_id"], "left"
        )
        asked = F.transform(
            F.coalesce("questions", F.array().cast("array<string>")),
            lambda question, at: F.struct(
                F.concat(F.col("chunk_id"), F.lit("-q"), at.cast("string")).alias("row_id"),
                question.alias("document"),
                F.lit(QUESTION_ROW).alias("type"),
            ),
        )
        rows = F.concat(rows, asked)
    return chunks.select(
        "doc_id", F.inline_outer(rows), F.col("chunk_id").alias("parent_id"), "chunk_index", "section"
    )


def upsert_index(
    existing: DataFrame,
    incoming: DataFrame,
    replace_docs: bool = False,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Old rows whose id does not come again, and all incoming ones.

    Ids depend on content, so an edited chunk gets a new id and its old row would stay;
    ``replace_docs`` drops every old row of a document that comes again.
    """
    by = [*keys, "doc_id"] if replace_docs else [*keys, "doc_id", "row_id"]
    arriving = incoming.select(*by)
    kept = existing.join(arriving.distinct() if replace_docs else arriving, by, "left_anti")
    return kept.unionByName(incoming)


def index_stats(rows: DataFrame) -> DataFrame:
    """Rows per type; the two known types are there even without rows."""
    counts = rows.groupBy(F.coalesce("type", F.lit(CHUNK_ROW)).alias("type")).agg(
        F.count("*").alias("rows")
    )
    # A zero for each known type, added up with what was counted: no join needed.
    spark = rows.sparkSession
    known = spark.range(1).select(
        F.explode(F.array(F.lit(CHUNK_ROW), F.lit(QUESTION_ROW))).alias("type"),
        F.lit(0).cast("long").alias("rows"),
    )
    return counts.unionByName(known).groupBy("type").agg(F.sum("rows").alias("rows"))
