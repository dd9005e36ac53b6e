"""Vectors as matrices inside tasks, and which vectors take part."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite, F.lit(False))


def matrix(vectors: pd.Series, dims: int, dtype=np.float64) -> np.ndarray:
    """A row for each vector; shorter vectors are filled up with zeros."""
    out = np.zeros((len(vectors), dims), dtype)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out
