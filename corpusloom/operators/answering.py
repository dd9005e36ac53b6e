"""Numbered context and answer prompts from ranked hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.augmentation import complete

# Prompt wording and the two answers given without a model call.
ANSWER_PROMPT = (
    "Answer the question using ONLY the numbered sources below. Cite the "
    "sources you use as [1], [2], and so on. If the sources do not contain "
    "the answer, say so plainly.\n\n"
    "Question: {question}\n\nSources:\n{sources}\n\nAnswer:"
)
NO_SOURCES = "No sources retrieved — nothing to answer from."
NO_MODEL = "No model configured — pass one to generate answers."
MAX_CONTEXT_CHARS = 8_000


def pack_context(hits: DataFrame, max_chars: int = MAX_CONTEXT_CHARS) -> DataFrame:
    """(query_id, rank, block, used): hits by rank until the budget is spent.

    The last text that still fits in part is cut. The window holds the hits of one query,
    at most k of them.
    """
    earlier = (
        Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    )
    used = F.coalesce(F.sum(F.length("text")).over(earlier), F.lit(0)).cast("int")
    open_hits = hits.withColumn("_used", used).filter(F.col("_used") < max_chars)
    text = F.substring(F.col("text"), F.lit(1), F.lit(max_chars) - F.col("_used"))
    label = F.when(F.col("section") == "", "document").otherwise(F.col("section"))
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] ("), label, F.lit(")\n"), text
    )
    return open_hits.select("query_id", "rank", block.alias("block"), F.length(text).alias("used"))


def answer_prompts(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, prompt, fixed_answer): one row per query, also for those without hits."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "block")))["block"]
    sources = blocks.groupBy("query_id").agg(F.array_join(ordered, "\n\n").alias("_sources"))
    head, rest = ANSWER_PROMPT.split("{question}")
    middle, tail = rest.split("{sources}")
    prompt = F.concat(
        F.lit(head), F.col("query"), F.lit(middle), F.col("_sources"), F.lit(tail)
    )
    return queries.join(sources, "query_id", "left").select(
        "query_id",
        prompt.alias("prompt"),
        F.when(F.col("_sources").isNull(), NO_SOURCES).alias("fixed_answer"),
    )


def answer(
    prompts: DataFrame, model: Callable[[list[str]], list[str]] | None = None
) -> DataFrame:
    """(query_id, answer, error): prompts through a user's model, fixed answers as they are."""
    fixed = F.col("fixed_answer")
    if model is None:
        return prompts.select(
            "query_id",
            F.coalesce(fixed, F.lit(NO_MODEL)).alias("answer"),
            F.lit(None).cast("string").alias("error"),
        )
    asked = complete(prompts.select("query_id", "prompt", "fixed_answer"), model, given="fixed_answer")
    return asked.select("query_id", F.col("raw").alias("answer"), "error")


def cited_numbers(text: Column) -> Column:
    return F.array_distinct(
        F.transform(
            F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), 1), lambda n: n.cast("int")
        )
    )


def citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, cited, chunk_id, valid): which sources an answer cites, and wrong numbers."""
    cited = answers.select("query_id", F.explode(cited_numbers(F.col("answer"))).alias("cited"))
    sources = hits.select("query_id", F.col("rank").alias("cited"), "doc_id", "chunk_id")
    return cited.join(sources, ["query_id", "cited"], "left").select(
        "query_id", "cited", "doc_id", "chunk_id", F.col("chunk_id").isNotNull().alias("valid")
    )
