"""End-to-end plans: pages or markdown to an index table, queries to hits and prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.vectors import hash_vector
from corpusloom.operators.answering import answer_prompts, pack_context
from corpusloom.operators.augmentation import chunk_questions, complete, question_prompts
from corpusloom.operators.chunking import ChunkOptions, chunk_markdown
from corpusloom.operators.cleaning import CleanOptions, clean_markdown
from corpusloom.operators.diagnostics import build_summary
from corpusloom.operators.embedding import embed_with_model
from corpusloom.operators.html import page_markdown
from corpusloom.operators.indexing import index_rows
from corpusloom.operators.retrieval import search, search_exact, valid_queries
from corpusloom.settings import Settings
from corpusloom.sources.pages import accepted, extraction_gate
from corpusloom.sources.tables import buckets_of, index_count, read_index, stage, upsert_table

TextModel = Callable[[list[str]], list[str]]
VectorModel = Callable[[list[str]], list[list[float]]]


def extract_pages(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(page_id, url, html) to (doc_id, markdown) of the pages whose content came through."""
    gated = extraction_gate(page_markdown(pages), settings.min_extract_chars)
    return accepted(gated).select(F.col("page_id").alias("doc_id"), "markdown")


def chunk_corpus(
    docs: DataFrame, settings: Settings = Settings(), clean: CleanOptions = CleanOptions()
) -> DataFrame:
    """(doc_id, markdown) to chunks; nothing is shuffled."""
    return chunk_markdown(clean_markdown(docs, clean), ChunkOptions.of(settings))


def generate_questions(
    chunks: DataFrame, model: TextModel, settings: Settings = Settings()
) -> DataFrame:
    """(doc_id, chunk_id, questions) from a user's model; chunks it fails on have none."""
    count = settings.questions
    return chunk_questions(complete(question_prompts(chunks, count), model), count)


def build_rows(
    chunks: DataFrame,
    settings: Settings = Settings(),
    questions: DataFrame | None = None,
    embed: VectorModel | None = None,
) -> DataFrame:
    """Index rows with vectors, under the key of their settings and of what makes the vectors."""
    rows = index_rows(chunks, questions if settings.questions else None)
    if embed is None:
        rows = rows.withColumn("vector", hash_vector(F.col("document")))
    else:
        rows = embed_with_model(
            rows, embed, "document", settings.document_prefix, settings.embed_batch_size
        )
    return rows.withColumn("config_key", F.lit(settings.embedded_by(embed).config_key))


def embed_queries(
    queries: DataFrame, settings: Settings = Settings(), embed: VectorModel | None = None
) -> DataFrame:
    """Queries that say something, with vectors."""
    asked = valid_queries(queries)
    if embed is None:
        return asked.withColumn("vector", hash_vector(F.col("query")))
    return embed_with_model(
        asked, embed, "query", settings.query_prefix, settings.embed_batch_size
    )


def build(
    spark: SparkSession,
    docs: DataFrame,
    path: str,
    settings: Settings = Settings(),
    force: bool = False,
    ask: TextModel | None = None,
    embed: VectorModel | None = None,
) -> DataFrame:
    """Build one configuration into the index at ``path`` and report on it.

    A configuration that has rows is left alone, unless ``force`` puts new rows in their place.
    """
    key = settings.embedded_by(embed).config_key
    existing = index_count(spark, path, key)
    chunks = questions = 0
    skipped = existing > 0 and not force
    rows = existing
    if not skipped:
        cut = stage(chunk_corpus(docs, settings))
        asked = None
        if ask is not None and settings.questions:
            asked = stage(generate_questions(cut, ask, settings))
            questions = asked.agg(F.coalesce(F.sum(F.size("questions")), F.lit(0))).head()[0]
        chunks = cut.count()
        new = build_rows(cut, settings, asked, embed)
        rows = upsert_table(
            spark,
            new,
            path,
            buckets=settings.index_buckets,
            instead_of=key if existing else None,
        )
    report = spark.range(1).select(
        F.lit(key).alias("collection"),
        F.lit(chunks).cast("long").alias("chunks"),
        F.lit(questions).cast("long").alias("questions"),
        F.lit(rows).cast("long").alias("rows_indexed"),
        F.lit(skipped).alias("skipped"),
    )
    return report.withColumn(
        "summary",
        build_summary(
            F.col("collection"),
            F.col("rows_indexed"),
            F.col("chunks"),
            F.col("questions"),
            F.col("skipped"),
        ),
    )


def search_index(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    settings: Settings = Settings(),
    embed: VectorModel | None = None,
    exact: bool = True,
) -> DataFrame:
    """Hits of (query_id, query) in one configuration of an index table.

    Unless ``exact``, rows are cut before they are collapsed to chunks, and hits may be missing.
    """
    index = read_index(spark, path, settings.embedded_by(embed).config_key)
    if index is None:
        raise ValueError(f"no index at {path}")
    asked = stage(embed_queries(queries, settings, embed))
    bounds = {"n_queries": asked.count(), "buckets": buckets_of(index, settings.index_buckets)}
    if exact:
        return search_exact(index, asked, settings.top_k, **bounds)
    return search(
        index, asked, settings.top_k, settings.dedupe_by_chunk, settings.overfetch, **bounds
    )


def prompts_for(queries: DataFrame, hits: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, prompt, fixed_answer) from hits, within the context budget."""
    return answer_prompts(queries, pack_context(hits, settings.max_context_chars))
