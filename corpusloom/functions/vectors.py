"""Vector columns: hash embedding, unit length, dense and sparse forms."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

HASH_DIM = 256
_NOT_ALNUM = re.compile(r"[\W_]+")


@lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> int:
    """First byte of the word's digest, -1 for a word without letters or digits."""
    token = _NOT_ALNUM.sub("", word)
    return hashlib.md5(token.encode("utf-8")).digest()[0] if token else -1


def hash_counts(text: str, dim: int) -> np.ndarray:
    hashes = np.array([_word_hash(word) for word in text.lower().split()], dtype=np.int64)
    return np.bincount(hashes[hashes >= 0] % dim, minlength=dim)


def hash_vector(text: Column, dim: int = HASH_DIM) -> Column:
    """Unit bag-of-words vector of ``dim`` buckets; all zero for a text without words."""

    @arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), dim))
        for row, value in enumerate(texts.to_pylist()):
            if value:
                out[row] = hash_counts(value, dim)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        np.divide(out, norms, out=out, where=norms > 0)
        offsets = np.arange(0, (len(texts) + 1) * dim, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    return embed(text)


def l2_norm(vector: Column) -> Column:
    total = F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v * v)
    return F.sqrt(total)


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    vector = vector.cast("array<double>")
    norm = l2_norm(vector)
    return F.when(norm > 0, F.transform(vector, lambda v: v / norm)).otherwise(vector)


def sparse_entries(rows: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """(keys, bucket, weight) of the non-zero entries; no shuffle.

    The outer explode gets no filter on its input, which would embed every text twice.
    """
    entries = rows.select(*keys, F.posexplode_outer(vector).alias("bucket", "weight"))
    return entries.filter(F.col("weight") != 0)


def densify(entries: Column, dim: int) -> Column:
    """ARRAY<STRUCT<bucket, weight>> to a list of ``dim`` doubles."""
    weights = F.map_from_entries(entries)
    buckets = F.sequence(F.lit(0), F.lit(dim - 1))
    return F.transform(
        buckets, lambda b: F.coalesce(F.try_element_at(weights, b), F.lit(0.0))
    )
