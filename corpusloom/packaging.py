"""Make the package importable in Python workers that do not have it installed."""

from __future__ import annotations

import shutil
import tempfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
#: Bytes of an Arrow batch: Spark's 10,000 rows take much memory when they are whole texts.
BATCH_BYTES = 4 << 20


@lru_cache(maxsize=None)
def _archive() -> str:
    folder = tempfile.mkdtemp(prefix="corpusloom-")
    return shutil.make_archive(f"{folder}/corpusloom", "zip", ROOT.parent, ROOT.name)


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once per application, and keep Arrow batches of texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if not any(path.endswith("corpusloom.zip") for path in context.listFiles):
        context.addPyFile(_archive())
    return spark
