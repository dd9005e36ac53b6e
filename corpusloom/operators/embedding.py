"""Embedding tables: prefixes, batches, and a hook for a user's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.vectors import HASH_DIM, hash_vector

DOCUMENT_PREFIX = "passage: "
QUERY_PREFIX = "query: "


def with_prefix(text: Column, prefix: str) -> Column:
    """Mark a text as document or query for a model that tells them apart."""
    return F.concat(F.lit(prefix), text) if prefix else text


def batch_rows(
    rows: DataFrame, size: int, group: str, order: list[str], value: str
) -> DataFrame:
    """Order-preserving batches of at most ``size`` values within each group.

    Numbering needs one order per group, so the group should be small (a document); a
    batch itself never holds more than ``size`` values.
    """
    size = max(1, size)
    position = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    numbered = rows.withColumn("_pos", position)
    item = F.struct("_pos", F.col(value).alias("item"))
    return (
        numbered.groupBy(group, F.floor(F.col("_pos") / size).cast("int").alias("batch"))
        .agg(F.sort_array(F.collect_list(item)).alias("_items"))
        .select(group, "batch", F.col("_items.item").alias("items"))
    )


def embed_hash(rows: DataFrame, text: str = "document", dim: int = HASH_DIM) -> DataFrame:
    """Add the deterministic word-overlap vector of ``text``; documents and queries alike."""
    return rows.withColumn("vector", hash_vector(F.col(text), dim))


def embed_with_model(
    rows: DataFrame,
    model: Callable[[list[str]], list[list[float]]],
    text: str = "document",
    prefix: str = DOCUMENT_PREFIX,
    batch_size: int = 16,
) -> DataFrame:
    """Add the unit vectors a user's model gives for the prefixed texts."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float]] = []
            texts = [f"{prefix}{value}" for value in frame[text]]
            for start in range(0, len(texts), max(1, batch_size)):
                batch = texts[start : start + max(1, batch_size)]
                answer = np.asarray(model(batch), dtype=np.float64)
                if len(answer) != len(batch):
                    raise ValueError(f"asked for {len(batch)} vectors, got {len(answer)}")
                norms = np.linalg.norm(answer, axis=1, keepdims=True)
                vectors.extend((answer / np.where(norms > 0, norms, 1.0)).tolist())
            yield frame.assign(vector=vectors)

    return rows.mapInPandas(run, f"{fields}, vector array<double>")
