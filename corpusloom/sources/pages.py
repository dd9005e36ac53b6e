"""Reading sources and deciding what to extract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.html import page_markdown

SLUG_CHARS = 60
MIN_EXTRACT_CHARS = 1_000


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of pages or documents (parquet), in the partitions its files give."""
    return spark.read.parquet(path)


def scan_html_files(spark: SparkSession, path: str) -> DataFrame:
    """Local or shared HTML files, one row each; a missing path is an error."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.xxhash64("_metadata.file_path").alias("page_id"),
        F.col("_metadata.file_path").alias("url"),
        F.col("value").alias("html"),
    )


def source_slug(url: Column) -> Column:
    """Last path segment without its extension, as lower-case words joined by "-"."""
    name = F.regexp_extract(F.rtrim(url, F.lit("/")), r"(?s)([^/]*)\z", 1)
    without_suffix = F.regexp_extract(name, r"(?s)^(.+)\.[^.]+\z", 1)
    stem = F.when(without_suffix != "", without_suffix).otherwise(name)
    words = F.trim(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.substring(words, 1, SLUG_CHARS), F.lit("")), F.lit("source"))


def slug_collisions(pages: DataFrame) -> DataFrame:
    """Slugs that more than one url maps to."""
    slugs = pages.select(source_slug(F.col("url")).alias("slug"), "url")
    counted = slugs.groupBy("slug").agg(
        F.count("*").alias("sources"),
        F.min("url").alias("first_url"),
        F.max("url").alias("last_url"),
    )
    return counted.filter(F.col("sources") > 1)


def extraction_gate(extracted: DataFrame, min_chars: int = MIN_EXTRACT_CHARS) -> DataFrame:
    """Tell accepted extractions from those that lost their content.

    A corpus job goes on: rejected rows carry a reason and can be set aside.
    """
    size = F.coalesce(F.length("markdown"), F.lit(0))
    reason = (
        F.when(size == 0, "empty").when(size < min_chars, "too short").otherwise(F.lit(""))
    )
    return extracted.withColumn("n_chars", size).withColumn("reason", reason).withColumn(
        "accepted", F.col("reason") == ""
    )


def accepted(gated: DataFrame) -> DataFrame:
    """The extractions that passed, without the columns of the gate.

    A plain filter would be moved below the extraction and run all of it once more to
    know its length; behind an outer explode it stays where it is.
    """
    rest = [c for c in gated.columns if c not in ("markdown", "n_chars", "reason", "accepted")]
    passed = F.when(F.col("accepted"), F.array("markdown"))
    kept = gated.select(*rest, F.explode_outer(passed).alias("markdown"))
    return kept.filter(F.col("markdown").isNotNull())


def quarantined(gated: DataFrame) -> DataFrame:
    return gated.filter("NOT accepted").drop("accepted")


def incremental_extract(pages: DataFrame, extracted: DataFrame) -> DataFrame:
    """(page_id, slug, markdown): what was extracted, and all pages that were not yet.

    ``extracted`` is (page_id, slug, markdown). Pages are known by their id, since many share a
    slug; of rows with one new id each is extracted.
    """
    missing = pages.join(extracted.select("page_id"), "page_id", "left_anti")
    fresh = page_markdown(missing.withColumn("slug", source_slug(F.col("url"))))
    columns = ["page_id", "slug", "markdown"]
    return extracted.select(*columns).unionByName(fresh.select(*columns))
