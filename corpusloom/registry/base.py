"""Registered queries: a Spark callable, and SQL that computes the same independently."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from corpusloom.packaging import ship
from corpusloom.sources.tables import stage

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


#: Given rows that one task chunks or embeds, at most about.
TASK_ROWS = 5_000

REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function of (spark, folder) under ``name``."""

    def add(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(lambda spark, folder: run(ship(spark), folder), sql)
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out to as many tasks as there are cores, and to more if there are many rows.

    The given tables hold one row group each, which one task reads; tables of many row groups are read by many
    tasks as they are, and no operator of the library does this. Rows are counted by the files' footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, math.ceil(df.count() / TASK_ROWS)))


_BUILT: dict[tuple[str, str, str], tuple[str, object]] = {}


def built(name: str):
    """A table derived from the given ones and written once per application and folder,
    as an index is built once and searched often.
    """

    def wrap(make: Run) -> Run:
        def get(spark: SparkSession, folder: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, folder, name)
            if key in _BUILT:
                path, schema = _BUILT[key]
                try:
                    return spark.read.schema(schema).parquet(path)
                except AnalysisException:  # scratch space was cleared
                    pass
            df = stage(make(spark, folder))
            _BUILT[key] = (df.inputFiles()[0].rsplit("/", 1)[0], df.schema)
            return df

        return get

    return wrap
