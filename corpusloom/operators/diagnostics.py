"""Chunk quality: flags, size report, previews and dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import count_of, has_letter

# Flag names in the order they are listed.
FLAGS = ("OVERSIZED", "TINY", "TABLE", "LINK-HEAVY", "NO-PROSE")
MAX_PIPES = 5
MAX_LINKS = 4
PREVIEW_CHARS = 300
DUMP_RULE = "=" * 70


def flags_of(text: Column, chunk_size: int = 600, tiny_below: int = 100) -> Column:
    """ARRAY<STRING> of the flags a chunk text raises."""
    raised = (
        F.length(text) > chunk_size,
        F.length(text) < tiny_below,
        count_of(text, "|") > MAX_PIPES,
        count_of(text, "](") > MAX_LINKS,
        ~has_letter(text),
    )
    return F.array_compact(F.array(*[F.when(on, F.lit(name)) for on, name in zip(raised, FLAGS)]))


def chunk_flags(chunks: DataFrame, chunk_size: int = 600, tiny_below: int = 100) -> DataFrame:
    return chunks.withColumn("flags", flags_of(F.col("text"), chunk_size, tiny_below))


def flag_label(flags: Column) -> Column:
    return F.when(F.size(flags) > 0, F.array_join(flags, " ")).otherwise(F.lit("ok"))


def _report_columns() -> list[Column]:
    return [
        F.count("*").alias("total"),
        F.coalesce(F.min("size"), F.lit(0)).alias("min_chars"),
        F.coalesce(F.median("size"), F.lit(0.0)).alias("median_chars"),
        F.coalesce(F.max("size"), F.lit(0)).alias("max_chars"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_chars"),
        F.countDistinct("section").alias("sections"),
    ]


def _flag_columns() -> list[Column]:
    """One count per flag, named after it."""
    return [
        F.coalesce(F.sum(F.array_contains("flags", name).cast("int")), F.lit(0)).alias(
            name.lower().replace("-", "_")
        )
        for name in FLAGS
    ]


def chunk_report(chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sizes and sections, over the corpus or per ``by``; an empty corpus reports zeros.

    The exact median merges counts per distinct size, and sizes are bounded by the chunk
    size, so its state stays small however many chunks there are.
    """
    return chunks.groupBy(*by).agg(*_report_columns())


def flag_counts(flagged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One column per flag with the number of chunks that carry it."""
    return flagged.groupBy(*by).agg(*_flag_columns())


def flagged_chunks(flagged: DataFrame, show: int | None = None) -> DataFrame:
    """Flagged chunks in document order; with ``show`` the first of them, as a preview."""
    rows = flagged.filter(F.size("flags") > 0).select(
        "doc_id",
        "chunk_index",
        "size",
        F.array_join("flags", " ").alias("flags"),
        F.substring("text", 1, PREVIEW_CHARS).alias("preview"),
    )
    ordered = rows.orderBy("doc_id", "chunk_index")
    return ordered if show is None else ordered.limit(show)


def filter_chunks(
    flagged: DataFrame, needle: str = "", only_flagged: bool = False, show: int | None = None
) -> DataFrame:
    """Chunks that hold ``needle`` in any case, and are flagged if asked for."""
    rows = flagged
    if only_flagged:
        rows = rows.filter(F.size("flags") > 0)
    if needle:
        rows = rows.filter(F.contains(F.lower("text"), F.lit(needle.lower())))
    return rows if show is None else rows.orderBy("doc_id", "chunk_index").limit(show)


def dump_block(flagged: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, block): every chunk as a readable block of text."""
    section = F.when(F.col("section") == "", "-").otherwise(F.col("section"))
    header = F.format_string(
        "\n" + DUMP_RULE + "\n[%4d] %4d chars  %s\nsection: %s\n" + DUMP_RULE + "\n",
        F.col("chunk_index"),
        F.col("size"),
        flag_label(F.col("flags")),
        section,
    )
    return flagged.select(
        "doc_id", "chunk_index", F.concat(header, F.col("text"), F.lit("\n")).alias("block")
    )


def write_dump(flagged: DataFrame, path: str) -> None:
    """The blocks as text files, each file in document order."""
    blocks = dump_block(flagged).repartitionByRange("doc_id", "chunk_index")
    blocks.sortWithinPartitions("doc_id", "chunk_index").select("block").write.text(path)


def report_summary(flagged: DataFrame) -> DataFrame:
    """Sizes and flag counts of a corpus as two lines of text, from one aggregation."""
    both = flagged.agg(*_report_columns(), *_flag_columns())
    return both.select(
        F.format_string(
            "%d chunks across %d sections | min %d | median %.0f | max %d | total %,d chars\n"
            "oversized: %d | tiny: %d | tables: %d | link-heavy: %d | no-prose: %d",
            "total", "sections", "min_chars", F.bround("median_chars"), "max_chars", "total_chars",
            "oversized", "tiny", "table", "link_heavy", "no_prose",
        ).alias("summary")
    )


def build_summary(
    collection: Column, rows: Column, chunks: Column, questions: Column, skipped: Column
) -> Column:
    return F.when(
        skipped, F.format_string("'%s' already indexed (%d rows).", collection, rows)
    ).otherwise(
        F.format_string(
            "Indexed %d rows into '%s': %d chunks + %d questions.",
            rows,
            collection,
            chunks,
            questions,
        )
    )


def compare_configs(chunks: DataFrame) -> DataFrame:
    """The size report of every configuration of a sweep, one row each."""
    return chunk_report(chunks, by=("config_key",))
