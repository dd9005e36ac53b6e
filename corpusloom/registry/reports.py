"""Diagnostics, cost and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import costs
from corpusloom.operators import diagnostics as d
from corpusloom.operators import reviews as v
from corpusloom.registry import sql
from corpusloom.registry.base import query, table
from corpusloom.registry.chunking import sweep, sweep_sql
from corpusloom.registry.fixtures import md_chunks, md_corpus, reviews
from corpusloom.registry.search import _search
from corpusloom.registry.sources import FLAGS, LATEST

FLAGGED = [
    *sql.MD_CHUNKS,
    ("flagged", f"SELECT *, {FLAGS.format(280, 150)} AS flags FROM chunks"),
]


def _flagged(spark, folder):
    return d.chunk_flags(md_chunks(spark, folder), 280, 150)


@query("chunk_flags", sql.with_(*FLAGGED, last="SELECT doc_id, chunk_id, flags FROM flagged"))
def chunk_flags(spark, folder):
    return _flagged(spark, folder).select(
        "doc_id", "chunk_id", F.array_join("flags", " ").alias("flags")
    )


# Raw turns raise the flags that cleaned chunks no longer raise.
@query(
    "chunk_flags_raw",
    sql.with_(
        sql.MD_CORPUS,
        ("texts", "SELECT doc_id, markdown AS text FROM md_corpus"),
        last=f"SELECT doc_id, {FLAGS.format(1500, 1200)} AS flags FROM texts",
    ),
)
def chunk_flags_raw(spark, folder):
    flags = d.flags_of(F.col("markdown"), 1500, 1200)
    return md_corpus(spark, folder).select("doc_id", F.array_join(flags, " ").alias("flags"))


REPORT = """count(*) AS total, min(size) AS min_chars, CAST(median(size) AS DOUBLE) AS median_chars,
  max(size) AS max_chars, CAST(sum(size) AS BIGINT) AS total_chars, count(DISTINCT section) AS sections"""


@query("chunk_report", sql.with_(*sql.MD_CHUNKS, last=f"SELECT {REPORT} FROM chunks"))
def chunk_report(spark, folder):
    return d.chunk_report(md_chunks(spark, folder))


@query(
    "chunk_report_by_document",
    sql.with_(*sql.MD_CHUNKS, last=f"SELECT doc_id, {REPORT} FROM chunks GROUP BY doc_id"),
)
def chunk_report_by_document(spark, folder):
    return d.chunk_report(md_chunks(spark, folder), by=("doc_id",))


@query(
    "chunk_report_empty",
    """SELECT count(*) AS total, 0 AS min_chars, CAST(0 AS DOUBLE) AS median_chars, 0 AS max_chars,
      CAST(0 AS BIGINT) AS total_chars, count(*) AS sections FROM documents WHERE n_chars < 0""",
)
def chunk_report_empty(spark, folder):
    """A corpus in which no chunk is long enough reports zeros."""
    return d.chunk_report(md_chunks(spark, folder).filter("size < 0"))


COUNTS = ", ".join(
    f"CAST(count(*) FILTER (contains(' ' || flags || ' ', ' {flag} ')) AS BIGINT) AS {flag.lower().replace('-', '_')}"
    for flag in ("OVERSIZED", "TINY", "TABLE", "LINK-HEAVY", "NO-PROSE")
)


@query("flag_counts", sql.with_(*FLAGGED, last=f"SELECT {COUNTS} FROM flagged"))
def flag_counts(spark, folder):
    return d.flag_counts(_flagged(spark, folder))


PREVIEW = """SELECT doc_id, chunk_index, size, flags, left(text, 300) AS preview FROM flagged
  WHERE flags <> ''"""


@query("flagged_chunks", sql.with_(*FLAGGED, last=PREVIEW))
def flagged_chunks(spark, folder):
    return d.flagged_chunks(_flagged(spark, folder))


@query(
    "flagged_preview",
    sql.with_(*FLAGGED, last=f"{PREVIEW} ORDER BY doc_id, chunk_index LIMIT 12"),
)
def flagged_preview(spark, folder):
    """The first flagged chunks, as a preview shows them."""
    return d.flagged_chunks(_flagged(spark, folder), 12)


FILTERED = """SELECT doc_id, chunk_index, text FROM flagged WHERE flags <> '' AND text ILIKE '%SPEAKER%'"""


@query("filter_chunks", sql.with_(*FLAGGED, last=FILTERED))
def filter_chunks(spark, folder):
    """All flagged chunks that hold a word."""
    found = d.filter_chunks(_flagged(spark, folder), "Speaker", only_flagged=True)
    return found.select("doc_id", "chunk_index", "text")


@query(
    "filtered_preview",
    sql.with_(*FLAGGED, last=f"{FILTERED} ORDER BY doc_id, chunk_index LIMIT 200"),
)
def filtered_preview(spark, folder):
    """The first two hundred of them, as a report lists them."""
    found = d.filter_chunks(_flagged(spark, folder), "Speaker", only_flagged=True, show=200)
    return found.select("doc_id", "chunk_index", "text")


@query(
    "report_summary",
    sql.with_(
        *FLAGGED,
        last=f"""SELECT printf('%d chunks across %d sections | min %d | median %.0f | max %d | total ', total, sections,
            min_chars, CAST(round_even(median_chars, 0) AS DOUBLE), max_chars) || format('{{:,}}', total_chars) || ' chars' || chr(10)
          || printf('oversized: %d | tiny: %d | tables: %d | link-heavy: %d | no-prose: %d',
            oversized, tiny, "table", link_heavy, no_prose) AS summary
          FROM (SELECT {REPORT}, {COUNTS.replace(" AS table", ' AS "table"')} FROM flagged)""",
    ),
)
def report_summary(spark, folder):
    return d.report_summary(_flagged(spark, folder))


@query(
    "compare_configs",
    sweep_sql(f"SELECT config_key, {REPORT} FROM sweep GROUP BY config_key"),
)
def compare_configs(spark, folder):
    return d.compare_configs(sweep(spark, folder))


CONFIGS = """SELECT doc_id, CAST(1 + floor(n_chars / 50e0) AS BIGINT) AS chunks,
  CAST(doc_id % 4 AS INT) AS questions_per_chunk FROM {documents}"""
CONFIGS_SQL = CONFIGS.format(documents="documents")
CALLS = """(chunks * (1 + questions_per_chunk) + 15) // 16
  + CASE WHEN questions_per_chunk > 0 THEN chunks ELSE 0 END"""


def _configs(spark, folder):
    """A build planned per document, asking for zero to three questions per chunk."""
    return spark.sql(CONFIGS, documents=table(spark, folder, "documents"))


@query("build_cost", f"SELECT *, CAST({CALLS} AS BIGINT) AS calls FROM ({CONFIGS_SQL})")
def build_cost(spark, folder):
    return costs.build_cost(_configs(spark, folder))


@query(
    "build_minutes",
    f"""SELECT *, CAST(chunks * questions_per_chunk AS BIGINT) AS questions,
      CAST(chunks * (1 + questions_per_chunk) AS BIGINT) AS rows, round(calls / 20, 6) AS minutes
      FROM (SELECT *, CAST({CALLS} AS BIGINT) AS calls FROM ({CONFIGS_SQL}))""",
)
def build_minutes(spark, folder):
    return costs.build_minutes(costs.build_cost(_configs(spark, folder)))


@query(
    "build_cost_exact",
    f"""SELECT doc_id, CAST(sum((least(100, chunks - k * 100) + 15) // 16) AS BIGINT) AS calls
      FROM (SELECT doc_id, chunks, unnest(range(CAST(ceil(chunks / 100) AS BIGINT))) AS k FROM ({CONFIGS_SQL}))
      GROUP BY doc_id""",
)
def build_cost_exact(spark, folder):
    """Calls when rows are written in slices of a hundred; the SQL adds them up slice by slice."""
    return _configs(spark, folder).select(
        "doc_id", costs.build_calls_exact(F.col("chunks")).alias("calls")
    )


FIELDS = "seq, question, chunk_id, verdict, note, section, similarity, match_type, rank"


@query("latest_reviews", f"SELECT {FIELDS} FROM ({LATEST})")
def latest_reviews(spark, folder):
    return v.latest_reviews(reviews(spark, folder))


@query(
    "review_precision",
    f"""SELECT count(*) AS judged, count(*) FILTER (verdict = 'relevant') AS relevant,
      round(count(*) FILTER (verdict = 'relevant') / count(*), 6) AS precision FROM ({LATEST})""",
)
def review_precision(spark, folder):
    return v.review_precision(v.latest_reviews(reviews(spark, folder)))


@query(
    "review_by_question",
    f"""SELECT question, count(*) AS judged, count(*) FILTER (verdict = 'relevant') AS relevant,
      min(rank) FILTER (verdict = 'relevant') AS best_rank,
      ((2 * sum(CAST(round(similarity * 10000) AS BIGINT)) + count(*)) // (2 * count(*))) / 10000 AS mean_similarity
      FROM ({LATEST}) GROUP BY question""",
)
def review_by_question(spark, folder):
    return v.review_by_question(v.latest_reviews(reviews(spark, folder)))


@query(
    "result_header",
    sql.with_(
        *sql.MD_SEARCH,
        (
            "shown",
            "SELECT 'Is ' || ['de', 'en', 'es', 'fr'][1 + query_id % 4] || ' text ' || query_id % 9 || ' of use?' "
            "AS question, similarity FROM hits",
        ),
        ("verdicts", f"SELECT question, count(*) AS n FROM ({LATEST}) WHERE verdict = 'relevant' GROUP BY question"),
        last="""SELECT question, count(*) AS results, round(max(similarity), 3) AS top_similarity,
          coalesce(max(n), 0) AS relevant FROM shown LEFT JOIN verdicts USING (question) GROUP BY question""",
    ),
)
def result_header(spark, folder):
    """Hits filed under the questions that have been judged."""
    shown = _search(spark, folder).selectExpr(
        "'Is ' || array('de', 'en', 'es', 'fr')[query_id % 4] || ' text ' "
        "|| CAST(query_id % 9 AS STRING) || ' of use?' AS question",
        "similarity",
    )
    return v.result_header(shown, v.latest_reviews(reviews(spark, folder)))


@query("sorted_judgements", f"SELECT {FIELDS} FROM ({LATEST}) ORDER BY question, rank, chunk_id")
def sorted_judgements(spark, folder):
    return v.sorted_judgements(v.latest_reviews(reviews(spark, folder)))
