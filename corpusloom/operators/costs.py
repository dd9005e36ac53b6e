"""What a build would cost, before it is run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import as_column


def _ceil_div(value: Column, by) -> Column:
    return F.ceil(value / as_column(by)).cast("long")


def build_calls(chunks: Column, questions, batch_size=16) -> Column:
    """Model calls of a build: embedding batches, and one call per chunk for questions."""
    questions = as_column(questions)
    return _ceil_div(chunks * (1 + questions), batch_size) + F.when(
        questions > 0, chunks
    ).otherwise(0).cast("long")


def build_calls_exact(rows: Column, write_size: int = 100, batch_size: int = 16) -> Column:
    """Embedding calls when rows are written in slices and each slice is batched anew."""
    per_slice = -(-write_size // batch_size)
    full = F.floor(rows / write_size).cast("long")
    return full * per_slice + _ceil_div(rows % write_size, batch_size)


def build_cost(configs: DataFrame) -> DataFrame:
    """(…, calls) for a table of (…, chunks, questions_per_chunk)."""
    calls = build_calls(F.col("chunks"), F.col("questions_per_chunk"))
    return configs.withColumn("calls", calls)


def build_minutes(costs: DataFrame, requests_per_minute=20) -> DataFrame:
    """Projected rows and pacing: minutes = calls / max(requests per minute, 1)."""
    rpm = F.greatest(as_column(requests_per_minute), F.lit(1))
    questions = F.col("chunks") * F.col("questions_per_chunk")
    return costs.withColumns(
        {
            "questions": questions.cast("long"),
            "rows": (F.col("chunks") + questions).cast("long"),
            "minutes": F.round(F.col("calls") / rpm, 6),
        }
    )
