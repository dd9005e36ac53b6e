"""Queries on pages, index rows and stored index tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import diagnostics as d
from corpusloom.operators import html as h
from corpusloom.operators import indexing as ix
from corpusloom.operators.reviews import latest_reviews, review_json
from corpusloom.plans.build import build
from corpusloom.registry import sql
from corpusloom.registry.base import dealt, query, table
from corpusloom.registry.fixtures import (
    REVIEWS,
    md_chunks,
    md_corpus,
    md_questions,
    md_rows,
    reviews,
)
from corpusloom.settings import Settings, with_config_key
from corpusloom.sources import pages as p
from corpusloom.sources import tables as s


def _pages(spark, folder):
    return dealt(p.scan_table(spark, f"{folder}/pages.parquet"))


@query(
    "scan_pages",
    "SELECT page_id, url, CAST(length(html) AS INTEGER) AS n_chars FROM pages",
)
def scan_pages(spark, folder):
    pages = p.scan_table(spark, f"{folder}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").alias("n_chars"))


BLOCKS = f"""SELECT page_id, pos, CASE WHEN {sql.level('line')} > 0 THEN 'heading'
  WHEN starts_with(line, '- ') THEN 'item' WHEN starts_with(line, '|') THEN 'row' ELSE 'text' END AS kind,
  {sql.level('line')} AS lvl, line AS text FROM blocks"""


@query("page_blocks", sql.with_(*sql.page_blocks(), last=BLOCKS))
def page_blocks(spark, folder):
    return h.page_blocks(_pages(spark, folder))


@query("page_blocks_with_navigation", sql.with_(*sql.page_blocks(True), last=BLOCKS))
def page_blocks_with_navigation(spark, folder):
    return h.page_blocks(_pages(spark, folder), keep_nav=True)


@query(
    "page_markdown",
    sql.with_(*sql.page_blocks(), last="SELECT page_id, url, markdown FROM page_texts"),
)
def page_markdown(spark, folder):
    return h.page_markdown(_pages(spark, folder))


# What is put at the end of every article: links with up to eight steps up, and a table.
ADDED = """replace(html, '</article>', concat('<p>See <a href="/a/b/c/d/e/f/', repeat('../', page_id % 9),
  'p', page_id, '.html">deep</a> or <a href="', repeat('./../', page_id % 4), 'q?r=../s">near</a></p>',
  '<table><tr><th>id</th><th>a|b</th></tr><tr><td>', page_id, '</td><td><p>x</p><p>', page_id % 9,
  '</p></td></tr></table></article>'))"""
NL = "' || chr(10) || '"


@query(
    "page_markdown_structured",
    sql.with_(
        *sql.page_blocks(),
        (
            "placed",
            r"""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin,
              string_split(regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1), '/') AS steps, markdown,
              contains(html, '</article>') AS longer
            FROM page_texts JOIN (SELECT page_id, html FROM pages) USING (page_id)""",
        ),
        (
            "climbed",
            """SELECT *, ['a', 'b', 'c', 'd', 'e', 'f'][:greatest(6 - page_id % 9, 0)] AS deep,
              steps[:greatest(len(steps) - 1 - page_id % 4, 0)] AS near FROM placed""",
        ),
        (
            "reached",
            """SELECT *, array_to_string([origin] || deep || ['p' || page_id || '.html'], '/') AS deep_url,
              array_to_string([origin] || near || ['q?r=../s'], '/') AS near_url FROM climbed""",
        ),
        last=rf"""SELECT page_id, markdown || CASE WHEN longer THEN
            '{NL}{NL}See [deep](' || deep_url || ') or [near](' || near_url || '){NL}{NL}'
            || '| id | a\|b |{NL}| --- | --- |{NL}| ' || page_id || ' | x ' || page_id % 9 || ' |'
          ELSE '' END AS markdown FROM reached""",
    ),
)
def page_markdown_structured(spark, folder):
    """Pages with deep relative links and tables put into them."""
    pages = _pages(spark, folder).withColumn("html", F.expr(ADDED))
    return h.page_markdown(pages).select("page_id", "markdown")


@query(
    "extraction_gate",
    sql.with_(
        *sql.page_blocks(),
        last="""SELECT page_id, CAST(length(markdown) AS INTEGER) AS n_chars, length(markdown) >= 1000 AS accepted,
          CASE WHEN markdown = '' THEN 'empty' WHEN length(markdown) < 1000 THEN 'too short' ELSE '' END AS reason
          FROM page_texts""",
    ),
)
def extraction_gate(spark, folder):
    gated = p.extraction_gate(h.page_markdown(_pages(spark, folder)))
    return gated.select("page_id", "n_chars", "accepted", "reason")


@query("source_slug", f"SELECT page_id, {sql.slug('url')} AS slug FROM pages")
def source_slug(spark, folder):
    return _pages(spark, folder).select("page_id", p.source_slug(F.col("url")).alias("slug"))


@query(
    "slug_collisions",
    f"""SELECT slug, count(*) AS sources, min(url) AS first_url, max(url) AS last_url
      FROM (SELECT url, {sql.slug('url')} AS slug FROM pages) GROUP BY slug HAVING count(*) > 1""",
)
def slug_collisions(spark, folder):
    return p.slug_collisions(_pages(spark, folder))


@query(
    "incremental_extract",
    sql.with_(
        *sql.page_blocks(),
        ("slugged", f"SELECT *, {sql.slug('url')} AS slug FROM page_texts"),
        last="""SELECT page_id, slug, CASE WHEN starts_with(url, 'https://')
          THEN 'kept from ' || url ELSE markdown END AS markdown FROM slugged""",
    ),
)
def incremental_extract(spark, folder):
    """Pages over http, after those over https have been extracted."""
    pages = _pages(spark, folder)
    done = pages.filter("startswith(url, 'https://')").select(
        "page_id",
        p.source_slug(F.col("url")).alias("slug"),
        F.concat(F.lit("kept from "), "url").alias("markdown"),
    )
    return p.incremental_extract(pages, done)


ROW = "doc_id, row_id, document, type, parent_id, chunk_index, section"


@query("index_rows", sql.with_(*sql.MD_INDEX, last=f"SELECT {ROW} FROM index_rows"))
def index_rows(spark, folder):
    return ix.index_rows(md_chunks(spark, folder), md_questions(spark, folder))


def _upsert_sql(condition: str) -> str:
    return sql.with_(
        *sql.MD_INDEX,
        (
            "old_rows",
            "SELECT doc_id, chunk_id AS row_id, 'old: ' || text AS document, 'chunk' AS type, "
            "chunk_id AS parent_id, chunk_index, section FROM chunks",
        ),
        ("new_rows", "SELECT * FROM index_rows WHERE contains(section, 'user')"),
        last=f"""SELECT {ROW} FROM old_rows o WHERE NOT EXISTS (SELECT 1 FROM new_rows n WHERE {condition})
          UNION ALL SELECT {ROW} FROM new_rows""",
    )


def _old_and_new(spark, folder):
    """An index that was built from other texts, and the rows of what users said."""
    old = ix.index_rows(md_chunks(spark, folder)).withColumn(
        "document", F.concat(F.lit("old: "), F.col("document"))
    )
    return old, md_rows(spark, folder).filter("contains(section, 'user')")


@query("upsert_index", _upsert_sql("n.doc_id = o.doc_id AND n.row_id = o.row_id"))
def upsert_index(spark, folder):
    return ix.upsert_index(*_old_and_new(spark, folder)).select(*ROW.split(", "))


@query("upsert_index_replacing", _upsert_sql("n.doc_id = o.doc_id"))
def upsert_index_replacing(spark, folder):
    old, new = _old_and_new(spark, folder)
    return ix.upsert_index(old, new, replace_docs=True).select(*ROW.split(", "))


NO_QUESTIONS = Settings(enable_questions=False)
MD_DEFAULT = [sql.MD_CORPUS, *sql.clean("md_corpus"), *sql.chunk_ctes("cleaned")]


@query(
    "build_mode",
    sql.with_(
        *MD_DEFAULT,
        ("built", "SELECT count(*) AS n FROM chunks"),
        ("tries", "SELECT unnest(['build', 'again', 'force']) AS attempt"),
        last=f"""SELECT attempt, '{NO_QUESTIONS.config_key}' AS collection,
          CASE WHEN attempt = 'again' THEN 0 ELSE n END AS chunks, CAST(0 AS BIGINT) AS questions,
          n AS rows_indexed, attempt = 'again' AS skipped,
          CASE WHEN attempt = 'again'
            THEN printf('''%s'' already indexed (%d rows).', '{NO_QUESTIONS.config_key}', n)
            ELSE printf('Indexed %d rows into ''%s'': %d chunks + 0 questions.', n,
              '{NO_QUESTIONS.config_key}', n) END AS summary FROM built, tries""",
    ),
)
def build_mode(spark, folder):
    """Build an index, build it again (skipped), and force a rebuild."""
    path = f"{s.staging_folder(spark)}/index-{uuid.uuid4().hex}"
    docs = md_corpus(spark, folder)
    reports = None
    for attempt, force in (("build", False), ("again", False), ("force", True)):
        report = build(spark, docs, path, NO_QUESTIONS, force)
        report = report.select(F.lit(attempt).alias("attempt"), "*")
        reports = report if reports is None else reports.unionByName(report)
    return reports


SMALL = NO_QUESTIONS.with_(chunk_size=300, chunk_overlap=50, min_chunk_chars=60)


@query(
    "list_indexes",
    f"""SELECT '{NO_QUESTIONS.config_key}' AS config_key, count(*) AS rows FROM
        ({sql.with_(*MD_DEFAULT, last='SELECT * FROM chunks')})
      UNION ALL SELECT '{SMALL.config_key}', count(*) FROM
        ({sql.with_(*sql.MD_CHUNKS, last='SELECT * FROM chunks')})""",
)
def list_indexes(spark, folder):
    """Two configurations built into one table."""
    path = f"{s.staging_folder(spark)}/index-{uuid.uuid4().hex}"
    for settings in (NO_QUESTIONS, SMALL):
        build(spark, md_corpus(spark, folder), path, settings)
    return s.list_indexes(spark, path)


@query(
    "reset_index",
    f"""SELECT '{SMALL.config_key}' AS config_key, count(*) AS rows FROM
        ({sql.with_(*sql.MD_CHUNKS, last='SELECT * FROM chunks')})""",
)
def reset_index(spark, folder):
    """Of two configurations, what is left when one is emptied."""
    path = f"{s.staging_folder(spark)}/index-{uuid.uuid4().hex}"
    for settings in (NO_QUESTIONS, SMALL):
        build(spark, md_corpus(spark, folder), path, settings)
    s.reset_index(spark, path, NO_QUESTIONS.config_key)
    return s.list_indexes(spark, path)


@query("index_count", sql.with_(*sql.MD_INDEX, last="SELECT count(*) AS rows FROM index_rows"))
def index_count(spark, folder):
    return md_rows(spark, folder).agg(F.count("*").alias("rows"))


@query(
    "index_stats",
    sql.with_(*sql.MD_INDEX, last="SELECT type, count(*) AS rows FROM index_rows GROUP BY type"),
)
def index_stats(spark, folder):
    return ix.index_stats(md_rows(spark, folder))


@query(
    "index_stats_no_questions",
    sql.with_(
        *sql.MD_CHUNKS,
        last="SELECT 'chunk' AS type, count(*) AS rows FROM chunks UNION ALL SELECT 'question', 0",
    ),
)
def index_stats_no_questions(spark, folder):
    return ix.index_stats(ix.index_rows(md_chunks(spark, folder)))


FLAGS = r"""array_to_string(list_filter([CASE WHEN length(text) > {0} THEN 'OVERSIZED' END,
  CASE WHEN length(text) < {1} THEN 'TINY' END,
  CASE WHEN len(regexp_extract_all(text, '\|')) > 5 THEN 'TABLE' END,
  CASE WHEN len(string_split(text, '](')) > 5 THEN 'LINK-HEAVY' END,
  CASE WHEN NOT regexp_matches(text, '\p{{L}}') THEN 'NO-PROSE' END], lambda f: f IS NOT NULL), ' ')"""


@query(
    "chunk_dump",
    sql.with_(
        *sql.MD_CHUNKS,
        last=f"""SELECT doc_id, chunk_index, chr(10) || repeat('=', 70) || chr(10)
          || printf('[%4d] %4d chars  ', chunk_index, size)
          || coalesce(nullif({FLAGS.format(200, 100)}, ''), 'ok') || chr(10)
          || 'section: ' || coalesce(nullif(section, ''), '-') || chr(10) || repeat('=', 70) || chr(10)
          || text || chr(10) AS block FROM chunks""",
    ),
)
def chunk_dump(spark, folder):
    return d.dump_block(d.chunk_flags(md_chunks(spark, folder), 200, 100))


LATEST = f"""SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY question, chunk_id
  ORDER BY seq DESC) AS r FROM ({REVIEWS.format(documents='documents', labels='labels')}))
  WHERE r = 1 AND verdict <> 'unjudged'"""


@query(
    "export_reviews",
    f"""SELECT question, chunk_id, '{{"verdict":"' || verdict || '","note":"' || note || '","question":"'
      || question || '","chunk_id":"' || chunk_id || '","section":"' || section || '","similarity":'
      || similarity || ',"match_type":"' || match_type || '","rank":' || rank || '}}' AS json FROM ({LATEST})""",
)
def export_reviews(spark, folder):
    return review_json(latest_reviews(reviews(spark, folder)))


SETTINGS = """doc_id, source AS base, lang = 'en' AS has_key,
  'vendor/' || upper(lang) || '-Embed_Model.V' || CAST(doc_id % 3 AS STRING) || ':free' AS embed_model,
  CAST(200 + n_chars % 5 * 100 AS INT) AS chunk_size, CAST(n_chars % 4 * 50 AS INT) AS overlap,
  doc_id % 2 = 0 AS enable_questions, CAST(doc_id % 6 AS INT) AS questions_per_chunk,
  CAST(40 + n_chars % 3 * 20 AS INT) AS min_chars, n_chars % 2 = 1 AS prepend_section"""


def _settings(spark, folder):
    documents = table(spark, folder, "documents")
    return spark.sql(f"SELECT {SETTINGS} FROM {{documents}}", documents=documents)


@query(
    "config_key",
    f"""SELECT doc_id, base || '__' || CASE WHEN has_key THEN left(regexp_replace(
        lower(replace(split_part(embed_model, '/', -1), ':free', '')), '[^a-z0-9]', '', 'g'), 12)
        ELSE 'hash' END || printf('_c%d_o%d_q%d_m%d_s%d', chunk_size, overlap,
        CASE WHEN enable_questions THEN questions_per_chunk ELSE 0 END, min_chars,
        CAST(prepend_section AS INTEGER)) AS config_key FROM (SELECT {SETTINGS} FROM documents)""",
)
def config_key(spark, folder):
    """One configuration per document, named by all that changes its vectors."""
    settings = _settings(spark, folder)
    return with_config_key(settings).select("doc_id", "config_key")


@query(
    "enable_switch",
    f"""SELECT doc_id, CASE WHEN enable_questions THEN questions_per_chunk ELSE 0 END
      AS questions_per_chunk FROM (SELECT {SETTINGS} FROM documents)""",
)
def enable_switch(spark, folder):
    settings = _settings(spark, folder)
    return with_config_key(settings).select("doc_id", "questions_per_chunk")
