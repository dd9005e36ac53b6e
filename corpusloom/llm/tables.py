"""Helpers of the operators here: reading tables, staging results, normalised words."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import packaging
from corpusloom.sources.tables import stage, staging_folder

__all__ = ["ascii_lower", "column_like", "read", "ship", "stage", "staging_folder"]

ship = packaging.ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def column_like(name: str, taken: list[str]) -> str:
    """``name``, or with underscores before it until no column of ``taken`` is called so."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name
