"""Sections and chunks: heading paths by a scan along a document's lines, splitting by one Arrow
function. All of it happens within the document's row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import scan
from corpusloom.functions.splitting import chunk_sections
from corpusloom.functions.text import (
    as_column,
    heading_level,
    heading_title,
    rstrip,
    strip,
    with_lines,
)
from corpusloom.settings import Settings

PATH_SEPARATOR = " > "
MIN_PREFIX_BUDGET = 20


@dataclass(frozen=True)
class ChunkOptions:
    chunk_size: int = 600
    overlap: int = 100
    min_chars: int = 80
    prepend_section: bool = True
    max_section_chars: int = 80

    @classmethod
    def of(cls, settings: Settings) -> "ChunkOptions":
        return cls(
            settings.chunk_size,
            settings.chunk_overlap,
            settings.min_chunk_chars,
            settings.prepend_section,
            settings.max_section_chars,
        )


def breadcrumb(titles: Column, deeper: Column, max_chars: int = 80) -> Column:
    """Heading path: the titles below level 1 (all of them if there are none), without
    the outermost ones that would make it longer than ``max_chars``.
    """
    path = F.when(F.size(deeper) > 0, deeper).otherwise(titles)
    fitting = F.lit(None).cast("string")
    for outermost in range(1, 6):
        rest = F.array_join(F.slice(path, outermost, 6), PATH_SEPARATOR)
        fits = (F.size(path) >= outermost) & (F.length(rest) <= max_chars)
        fitting = F.coalesce(fitting, F.when(fits, rest))
    return F.coalesce(fitting, F.try_element_at(path, F.lit(-1)), F.lit(""))


def _with_headings(docs: DataFrame, text: str) -> DataFrame:
    """``text`` replaced by ``lines``, ``heads`` (pos, lvl, title of its titled headings) and, for each
    of these, ``stack``: the titles open there by level, null for a level without one.
    """

    def head(x: Column, i: Column) -> Column:
        level, title = heading_level(x["line"]).alias("lvl"), x["title"]
        return F.when(title != "", F.struct(i.alias("pos"), level, title.alias("title")))

    def open_below(stack: Column, head: Column) -> Column:
        above = head["lvl"] - 1
        skipped = F.array_repeat(F.lit(None).cast("string"), F.greatest(above - F.size(stack), F.lit(0)))
        return F.concat(F.slice(stack, F.lit(1), above), skipped, F.array(head["title"]))

    none = F.array().cast("array<string>")
    titles = F.transform("lines", heading_title)
    titled = F.arrays_zip(F.col("lines").alias("line"), titles.alias("title"))
    return (
        with_lines(docs, text)
        .withColumn("heads", F.array_compact(F.transform(titled, head)))
        .withColumn("stack", scan(F.col("heads"), none, open_below))
    )


def heading_stack(docs: DataFrame, doc: str = "doc_id", text: str = "markdown") -> DataFrame:
    """(doc, pos, stack) per titled heading: ``1:Title/3:Part`` from the outside in."""
    level = lambda t, i: F.when(t.isNotNull(), F.concat((i + 1).cast("string"), F.lit(":"), t))
    found = _with_headings(docs.select(doc, text), text).select(
        doc, F.inline_outer(F.arrays_zip(F.col("heads.pos").alias("pos"), F.col("stack")))
    )
    return found.filter("pos IS NOT NULL").select(doc, "pos", F.array_join(F.transform("stack", level), "/").alias("stack"))


def _with_paths(docs: DataFrame, max_section_chars: int, text: str) -> DataFrame:
    """Adds ``paths``: the heading path of each of ``heads``."""

    def titles(stack: Column) -> Column:
        deeper = F.array_compact(F.slice(stack, 2, 5))
        return F.when(F.size(deeper) > 0, deeper).otherwise(F.array_compact(stack))

    path = lambda p: breadcrumb(p, p, max_section_chars)
    return (
        _with_headings(docs, text)
        .withColumn("_open", F.transform("stack", titles))
        .withColumn("paths", F.transform("_open", path))
        .drop("_open", "stack")
    )


def heading_paths(
    docs: DataFrame, max_section_chars: int = 80, doc: str = "doc_id", text: str = "markdown"
) -> DataFrame:
    """(doc, pos, path) per titled heading."""
    found = _with_paths(docs.select(doc, text), max_section_chars, text)
    return found.select(
        doc, F.inline_outer(F.arrays_zip(F.col("heads.pos").alias("pos"), F.col("paths").alias("path")))
    ).filter("pos IS NOT NULL")


def with_sections(docs: DataFrame, max_section_chars: int = 80, text: str = "markdown") -> DataFrame:
    """``text`` replaced by ``sections``: (section_seq, section, body) of each titled heading that has
    text below it, and of what stands above the first.
    """

    def section(x: Column, k: Column) -> Column:
        body = F.array_join(F.slice("lines", x["begin"] + 1, x["end"] - x["begin"]), "\n")
        return F.struct(k.alias("section_seq"), x["section"], strip(body).alias("body"))

    # Whatever stands above the first heading, and then the lines from each heading to the next.
    begins = F.concat(F.array(F.lit(0)), F.transform("heads.pos", lambda p: p + 1))
    ends = F.concat("heads.pos", F.array(F.size("lines")))
    parts = F.arrays_zip(
        begins.alias("begin"),
        ends.alias("end"),
        F.concat(F.array(F.lit("")), "paths").alias("section"),
    )
    return (
        _with_paths(docs, max_section_chars, text)
        .withColumn("sections", F.filter(F.transform(parts, section), lambda s: s["body"] != ""))
        .drop("lines", "heads", "paths")
    )


def split_sections(
    docs: DataFrame, max_section_chars: int = 80, doc: str = "doc_id", text: str = "markdown"
) -> DataFrame:
    """(doc, section_seq, section, body), one row per titled heading with text below it."""
    found = with_sections(docs.select(doc, text), max_section_chars, text)
    # An inner explode would be given a filter that computes all of this once more.
    rows = found.select(doc, F.inline_outer("sections"))
    return rows.filter("section_seq IS NOT NULL")


def section_prefix(section: Column, chunk_size, prepend=True) -> Column:
    """Heading path put before every chunk, cut to a third of the chunk size."""
    budget = F.greatest((as_column(chunk_size) / 3).cast("int"), F.lit(MIN_PREFIX_BUDGET))
    cut = F.concat(rstrip(F.substring(section, F.lit(1), budget - 1)), F.lit("…"))
    label = F.when(F.length(section) > budget, cut).otherwise(section)
    return F.when(as_column(prepend) & (section != ""), F.concat(label, F.lit("\n\n"))).otherwise(
        F.lit("")
    )


def body_budget(chunk_size, prefix: Column) -> Column:
    """Characters left for the body, but never less than half of the chunk size."""
    size = as_column(chunk_size)
    return F.greatest(size - F.length(prefix), (size / 2).cast("int"))


def overlap_budget(overlap, budget: Column) -> Column:
    return F.least(as_column(overlap), (budget / 2).cast("int"))


def chunk_id(index: Column, text: Column) -> Column:
    """``c0042-1f3a9b7c``: position and content, the same on every run."""
    return F.format_string("c%04d-%s", index, F.substring(F.sha1(text), 1, 8))


def _limits(size, overlap, min_chars, prepend_section) -> Column:
    """What one setting allows each of a document's ``sections``."""

    def limit(section: Column) -> Column:
        prefix = section_prefix(section["section"], size, prepend_section)
        budget = body_budget(size, prefix)
        return F.struct(
            prefix.alias("prefix"),
            budget.cast("int").alias("size"),
            overlap_budget(overlap, budget).cast("int").alias("overlap"),
        )

    return F.struct(
        as_column(min_chars).cast("int").alias("least"), F.transform("sections", limit).alias("limits")
    )


def _chunks(docs: DataFrame, doc: str, settings: list[tuple], keys: list[str] | None) -> DataFrame:
    """Chunks of documents with ``sections`` under every one of ``settings``, in one trip to Python
    that carries the texts once; the place in a document's list is the dense chunk index.
    """
    cut = docs.withColumn("_limits", F.array(*[_limits(*s) for s in settings])).select(
        doc, chunk_sections(F.col("sections"), F.col("_limits")).alias("_lists")
    )
    names = [] if keys is None else ["config_key"]
    key = F.get(F.array(*map(F.lit, keys or [""])), F.col("_setting"))
    lists = cut.select(doc, F.posexplode_outer("_lists").alias("_setting", "_chunks"))
    chunks = lists.select(
        doc,
        *([key.alias("config_key")] if names else []),
        F.posexplode_outer("_chunks").alias("chunk_index", "_chunk"),
    )
    return (
        chunks.filter(F.col("_chunk").isNotNull())
        .select(doc, *names, "chunk_index", "_chunk.section", "_chunk.text")
        .select(
            doc,
            *names,
            "chunk_index",
            chunk_id(F.col("chunk_index"), F.col("text")).alias("chunk_id"),
            "section",
            "text",
            F.length("text").alias("size"),
        )
    )


def chunk_markdown(
    docs: DataFrame,
    options: ChunkOptions = ChunkOptions(),
    doc: str = "doc_id",
    text: str = "markdown",
) -> DataFrame:
    """(doc, markdown) to (doc, chunk_index, chunk_id, section, text, size)."""
    sections = with_sections(docs.select(doc, text), options.max_section_chars, text)
    setting = (options.chunk_size, options.overlap, options.min_chars, options.prepend_section)
    return _chunks(sections, doc, [setting], None)


def chunk_sweep(
    docs: DataFrame,
    configs: list[Settings],
    doc: str = "doc_id",
    text: str = "markdown",
) -> DataFrame:
    """The same documents under several settings, keyed by ``config_key``.

    Sections do not depend on the chunk size, so they are built once; their texts are not multiplied.
    """
    limits = {s.max_section_chars for s in configs}
    if len(limits) != 1:
        raise ValueError("one sweep shares one max_section_chars")
    sections = with_sections(docs.select(doc, text), limits.pop(), text)
    settings = [
        (s.chunk_size, s.chunk_overlap, s.min_chunk_chars, s.prepend_section) for s in configs
    ]
    return _chunks(sections, doc, settings, [s.config_key for s in configs])
