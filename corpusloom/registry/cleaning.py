"""Cleaning queries, all on the composed markdown corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import cleaning as c
from corpusloom.registry import sql
from corpusloom.registry.base import query
from corpusloom.registry.fixtures import md_corpus


def _rewrite(name: str, column, expression: str) -> None:
    """A query that applies one rewrite to whole documents."""
    text = sql.with_(
        sql.MD_CORPUS,
        last=f"SELECT doc_id, {expression} AS markdown FROM md_corpus",
        recursive=False,
    )

    @query(name, text)
    def run(spark, folder):
        return md_corpus(spark, folder).select("doc_id", column(F.col("markdown")).alias("markdown"))


_rewrite("unescape_brackets", c.unescape_brackets, sql.unescaped("markdown"))
_rewrite("unwrap_links", c.unwrap_links, sql.unwrapped("markdown"))
_rewrite(
    "strip_bare_urls", c.strip_bare_urls, sql.sub("markdown", rf"https?://{sql.NOT_WS}+")
)
_rewrite("strip_html_tags", c.strip_html_tags, sql.sub("markdown", sql.TAG))
_rewrite("strip_citations", c.strip_citations, sql.sub("markdown", sql.CITATION))
_rewrite("collapse_asterisks", c.collapse_asterisks, sql.sub("markdown", r"\*{3,}", " "))
_rewrite("tidy_punctuation", c.tidy_punctuation, sql.tidied("markdown"))

LINES = [sql.MD_CORPUS, ("raw_lines", sql.lines("md_corpus"))]


def _lines(spark, folder):
    return t.with_lines(md_corpus(spark, folder))


def _kept(docs):
    return t.explode_lines(docs).filter("line IS NOT NULL")


@query(
    "drop_sections",
    sql.with_(*LINES, *sql.drop_sections("raw_lines"), last="SELECT doc_id, pos, line FROM kept"),
)
def drop_sections(spark, folder):
    return _kept(c.drop_sections(_lines(spark, folder)))


@query(
    "name_empty_headings",
    sql.with_(*LINES, *sql.named_headings("raw_lines"), last="SELECT doc_id, pos, line FROM named"),
)
def name_empty_headings(spark, folder):
    return _kept(c.name_empty_headings(_lines(spark, folder)))


@query(
    "infer_title",
    sql.with_(
        *LINES,
        (
            "subjects",
            f"SELECT *, {sql.inferred('line')} AS subject FROM raw_lines",
        ),
        (
            "worded",
            f"SELECT *, list_filter(regexp_split_to_array(subject, '{sql.WS}+'), lambda w: w <> '') AS words FROM subjects",
        ),
        last=rf"""SELECT doc_id, pos, CASE WHEN {sql.level('line')} > 0 OR len(words) = 0 OR len(words) > 5
            OR NOT regexp_matches(words[1], '^\p{{L}}') THEN ''
            ELSE substring(array_to_string(words, ' '), 1, 40) END AS title FROM worded""",
    ),
)
def infer_title(spark, folder):
    return t.explode_lines(_lines(spark, folder)).select("doc_id", "pos", c.infer_title(F.col("line")).alias("title"))


@query(
    "tidy_lines",
    sql.with_(*LINES, *sql.tidy_lines("raw_lines"), last="SELECT doc_id, pos, line FROM tidy"),
)
def tidy_lines(spark, folder):
    return _kept(c.tidy_lines(_lines(spark, folder)))


@query(
    "drop_boilerplate",
    sql.with_(
        *LINES,
        last=f"""SELECT doc_id, pos, line FROM raw_lines
          WHERE length({sql.strip('line')}) <= 60 AND NOT starts_with({sql.strip('line')}, '#')
          AND regexp_matches(lower({sql.strip('line')}), '^[-*| ]*(?:{sql.BOILERPLATE})')""",
    ),
)
def drop_boilerplate(spark, folder):
    """The lines that the boilerplate rule drops."""
    return t.explode_lines(_lines(spark, folder)).filter(c.is_boilerplate(t.strip(F.col("line"))))


@query("join_lines", sql.with_(*LINES, last=sql.joined("raw_lines")))
def join_lines(spark, folder):
    return c.join_lines(_lines(spark, folder))


@query(
    "heading_of",
    sql.with_(
        *LINES,
        last=f"SELECT doc_id, pos, {sql.level('line')} AS lvl, {sql.title('line')} AS title FROM raw_lines",
    ),
)
def heading_of(spark, folder):
    return t.explode_lines(_lines(spark, folder)).select(
        "doc_id",
        "pos",
        t.heading_level(F.col("line")).alias("lvl"),
        t.heading_title(F.col("line")).alias("title"),
    )


CLEAN = [sql.MD_CORPUS, *sql.clean("md_corpus")]


@query("clean_markdown", sql.with_(*CLEAN, last="SELECT doc_id, markdown FROM cleaned"))
def clean_markdown(spark, folder):
    return c.clean_markdown(md_corpus(spark, folder))


@query(
    "clean_markdown_links_kept",
    sql.with_(
        sql.MD_CORPUS,
        (
            "inlined",
            "SELECT doc_id, "
            + sql.tidied(
                sql.sub(sql.sub(sql.unescaped("markdown"), sql.TAG), r"\*{3,}", " ")
            )
            + " AS markdown FROM md_corpus",
        ),
        ("raw_lines", sql.lines("inlined")),
        *sql.tidy_lines("raw_lines"),
        ("cleaned", sql.joined("tidy")),
        last="SELECT doc_id, markdown FROM cleaned",
    ),
)
def clean_markdown_links_kept(spark, folder):
    """Links, citations, sections and empty headings left as they are."""
    options = c.CleanOptions(
        strip_links=False, strip_citations=False, name_empty_headings=False, drop_sections=()
    )
    return c.clean_markdown(md_corpus(spark, folder), options)


def _counts(stage: str, source: str) -> str:
    def found(pattern: str) -> str:
        return f"CAST(sum(len(regexp_extract_all(markdown, '{pattern}'))) AS BIGINT)"

    return rf"""SELECT '{stage}' AS stage, count(*) AS documents,
      CAST(sum(length(markdown)) AS BIGINT) AS chars,
      CAST(sum(length(markdown) - length(replace(markdown, chr(10), ''))) AS BIGINT) AS line_ends,
      {found(sql.LINK)} AS links, {found(sql.TAG)} AS tags, {found(sql.CITATION)} AS citations,
      {found('(?m)^[ ' + chr(92) + 't]*#')} AS headings FROM {source}"""


@query(
    "cleaning_report",
    sql.with_(*CLEAN, last=f"{_counts('before', 'md_corpus')} UNION ALL {_counts('after', 'cleaned')}"),
)
def cleaning_report(spark, folder):
    docs = md_corpus(spark, folder)
    return c.cleaning_report(docs, "before").unionByName(
        c.cleaning_report(c.clean_markdown(docs), "after")
    )
