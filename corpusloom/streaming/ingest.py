"""Pages that keep arriving, built into the index batch by batch.

The chain from page to index row has no state across pages, so every micro-batch is an
ordinary build of the pages it holds, merged by id. A page that arrives twice, or a batch
that is run again after a failure, leaves the table as it is; of the versions of a page in
one batch, the one in the latest file counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.plans.build import (
    TextModel,
    VectorModel,
    build_rows,
    chunk_corpus,
    extract_pages,
    generate_questions,
)
from corpusloom.settings import Settings
from corpusloom.sources.tables import stage, upsert_table

PAGE_SCHEMA = "page_id long, url string, html string"


def read_pages(spark: SparkSession, folder: str, files_per_batch: int = 1_000) -> DataFrame:
    """A stream over the parquet files of pages that appear in ``folder``."""
    reader = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def latest_pages(pages: DataFrame) -> DataFrame:
    """One version of each page: the last that arrived (ties: the larger hash).

    Which one it is is settled on hashes; only then are the texts filtered. Versions that are equal
    in all of that are one and the same text, of which any row stays.
    """
    version = F.struct(
        F.col("arrived") if "arrived" in pages.columns else F.lit(0).alias("arrived"),
        F.xxhash64("url", "html").alias("version"),
    )
    marked = pages.withColumn("version", version)
    last = marked.groupBy("page_id").agg(F.max("version").alias("version"))
    kept = marked.join(last, ["page_id", "version"], "left_semi")
    return kept.dropDuplicates(["page_id"]).select("page_id", "url", "html")


def ingest(
    pages: DataFrame,
    path: str,
    checkpoint: str,
    settings: Settings = Settings(),
    ask: TextModel | None = None,
    embed: VectorModel | None = None,
) -> StreamingQuery:
    """Index what has arrived and stop; run again, it goes on from its checkpoint.

    A page that changed replaces all rows it had, also if its new version has none.
    """

    def merge(batch: DataFrame, _: int) -> None:
        batch = latest_pages(batch)
        chunks = chunk_corpus(extract_pages(batch, settings), settings)
        asked = None
        if ask is not None and settings.questions:
            chunks = stage(chunks)
            asked = generate_questions(chunks, ask, settings)
        rows = build_rows(chunks, settings, asked, embed)
        upsert_table(
            batch.sparkSession,
            rows,
            path,
            replace_docs=True,
            buckets=settings.index_buckets,
            documents=batch.select(
                F.lit(settings.embedded_by(embed).config_key).alias("config_key"), F.col("page_id").alias("doc_id")
            ),
        )

    writer = pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
