"""Index tables on storage: partitioned parquet, upserts, and staged results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusloom.operators.indexing import bucket_of, upsert_index
from corpusloom.settings import Settings

BUCKETS = Settings().index_buckets
#: What reading a table that is not there, or has no rows any more, is answered with.
NO_TABLE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def staging_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; in local mode, where none is, a new one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a result that several later steps read, and go on from the written table.

    Unlike a cache it survives lost executors, and readers prune columns on it.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_bucket(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows with their bucket, and the number of buckets that a table keeps for good."""
    return rows.withColumns(
        {"bucket": bucket_of("doc_id", buckets), "buckets": F.lit(buckets).cast("int")}
    )


def buckets_of(index: DataFrame | None, otherwise: int = BUCKETS) -> int:
    """The number of buckets a table was built with, whatever the settings say now."""
    row = None if index is None else index.select("buckets").head()
    return otherwise if row is None else row[0]


def read_index(spark: SparkSession, path: str, config_key: str | None = None) -> DataFrame | None:
    """The index table, or one configuration of it (partition pruned); None before a build."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() not in NO_TABLE:
            raise
        return None
    return table if config_key is None else table.filter(F.col("config_key") == config_key)


def write_index(placed: DataFrame, path: str) -> None:
    """Replace the partitions (config_key, bucket) that ``placed`` has rows for.

    Rebalancing brings the rows of a partition together and cuts large ones into several
    files, so the number and size of files follow the data.
    """
    (
        placed.hint("rebalance", "config_key", "bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("config_key", "bucket")
        .parquet(path)
    )


def upsert_table(
    spark: SparkSession,
    rows: DataFrame,
    path: str,
    replace_docs: bool = False,
    buckets: int = BUCKETS,
    documents: DataFrame | None = None,
    instead_of: str | None = None,
) -> int:
    """Idempotent write keyed by (config_key, doc_id, row_id); returns the rows written.

    Only buckets that receive rows are read and rewritten. The incoming rows are staged
    first, because they decide the buckets, win over old rows and are written. With
    ``replace_docs``, ``documents`` (config_key, doc_id) names all that arrived, so that those
    without rows lose their old ones too. ``instead_of`` names the rows' configuration if they take the place
    of all it has: a bucket's old rows are there until its new ones are, and buckets that get none go last.
    """
    existing = read_index(spark, path)
    buckets = buckets_of(existing, buckets)
    incoming = stage(with_bucket(rows, buckets))
    if instead_of is not None:
        old = existing.filter(F.col("config_key") == instead_of) if existing is not None else incoming
        before = {r[0] for r in old.select("bucket").distinct().collect()}
        filled = {r[0] for r in incoming.select("bucket").distinct().collect()}
        write_index(incoming, path)
        for bucket in before - filled:
            _drop_folder(spark, f"{path.rstrip('/')}/config_key={instead_of}/bucket={bucket}")
        return incoming.count()
    if existing is None:
        merged = incoming
    else:
        place = ["config_key", "bucket"]
        if documents is not None:
            documents = with_bucket(documents.select("config_key", "doc_id").distinct(), buckets)
            existing = existing.join(documents, [*place, "doc_id"], "left_anti")
        # At most one row per configuration and bucket.
        arrived = incoming if documents is None else incoming.select(*place).union(documents.select(*place))
        touched = arrived.select(*place).distinct()
        nearby = existing.join(F.broadcast(touched), place, "left_semi")
        merged = upsert_index(nearby, incoming, replace_docs, keys=tuple(place))
        if documents is not None:  # a bucket that is left without rows is not overwritten
            merged = stage(merged)
            filled = merged.select(*place).distinct().collect()
            empty = {tuple(r) for r in touched.collect()} - {tuple(r) for r in filled}
            for key, bucket in empty:
                _drop_folder(spark, f"{path.rstrip('/')}/config_key={key}/bucket={bucket}")
    # New files are put in place only when the job commits, so it may read the old ones.
    write_index(merged, path)
    return incoming.count()


def _drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def reset_index(spark: SparkSession, path: str, config_key: str) -> None:
    """Empty one configuration: its partitions are dropped, others stay."""
    _drop_folder(spark, f"{path.rstrip('/')}/config_key={config_key}")


def list_indexes(spark: SparkSession, path: str) -> DataFrame:
    """Sorted configuration keys with their row counts."""
    table = read_index(spark, path)
    if table is None:
        return spark.createDataFrame([], "config_key string, rows long")
    return table.groupBy("config_key").agg(F.count("*").alias("rows")).orderBy("config_key")


def index_count(spark: SparkSession, path: str, config_key: str) -> int:
    table = read_index(spark, path, config_key)
    return 0 if table is None else table.count()
