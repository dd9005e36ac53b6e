"""Sectioning and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import splitting
from corpusloom.operators import chunking as k
from corpusloom.operators.cleaning import clean_markdown
from corpusloom.plans.build import chunk_corpus as build_chunks
from corpusloom.registry import sql
from corpusloom.registry.base import query
from corpusloom.registry.fixtures import MD_OPTIONS, documents, md_corpus
from corpusloom.settings import Settings

RAW_SECTIONS = [sql.MD_CORPUS, *sql.sections("md_corpus")]


@query(
    "heading_stack",
    sql.with_(
        *RAW_SECTIONS,
        last="""SELECT h.doc_id, h.pos, string_agg(a.lvl || ':' || a.title, '/' ORDER BY a.pos) AS stack
          FROM h_titled h JOIN h_titled a ON a.doc_id = h.doc_id AND a.pos <= h.pos AND h.pos < a.until_pos
          GROUP BY h.doc_id, h.pos""",
    ),
)
def heading_stack(spark, folder):
    return k.heading_stack(md_corpus(spark, folder))


@query(
    "split_sections",
    sql.with_(*RAW_SECTIONS, last="SELECT doc_id, section_seq, section, body FROM sectioned"),
)
def split_sections(spark, folder):
    return k.split_sections(md_corpus(spark, folder))


@query(
    "breadcrumb",
    sql.with_(
        sql.MD_CORPUS,
        *sql.sections("md_corpus", 40),
        last="SELECT doc_id, pos, section AS path FROM s_paths",
    ),
)
def breadcrumb(spark, folder):
    return k.heading_paths(md_corpus(spark, folder), 40)


PREFIXED = [*RAW_SECTIONS, *sql.prefixed("sectioned", 120, 100)]


@query(
    "section_prefix",
    sql.with_(*PREFIXED, last="SELECT doc_id, section_seq, prefix FROM prefixed"),
)
def section_prefix(spark, folder):
    sections = k.split_sections(md_corpus(spark, folder))
    return sections.select(
        "doc_id", "section_seq", k.section_prefix(F.col("section"), 120).alias("prefix")
    )


@query(
    "body_budget",
    sql.with_(
        *PREFIXED,
        last="""SELECT doc_id, section_seq, CAST(size AS INTEGER) AS size,
          CAST(overlap AS INTEGER) AS overlap FROM prefixed""",
    ),
)
def body_budget(spark, folder):
    sections = k.split_sections(md_corpus(spark, folder))
    prefix = k.section_prefix(F.col("section"), 120)
    return sections.withColumn("size", k.body_budget(120, prefix)).select(
        "doc_id", "section_seq", "size", k.overlap_budget(100, F.col("size")).alias("overlap")
    )


def _doc_bodies(size: int, overlap: int) -> tuple[str, str]:
    return (
        "bodies",
        f"SELECT doc_id, 0 AS section_seq, text AS body, {size} AS size, {overlap} AS overlap FROM documents",
    )


@query(
    "split_body",
    sql.with_(
        _doc_bodies(200, 50),
        *sql.split_bodies("bodies"),
        last="""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS nth,
          piece FROM pieces""",
    ),
)
def split_body(spark, folder):
    pieces = splitting.split_body(F.col("markdown"), F.lit(200), F.lit(50))
    return documents(spark, folder).select(
        "doc_id", F.posexplode_outer(pieces).alias("nth", "piece")
    ).filter("piece IS NOT NULL")


@query(
    "merge_small",
    sql.with_(
        _doc_bodies(200, 50),
        *sql.split_bodies("bodies"),
        *sql.fold_pieces("bodies", 120),
        last="SELECT doc_id, CAST(nth AS INTEGER) AS nth, piece FROM folded",
    ),
)
def merge_small(spark, folder):
    pieces = splitting.split_body(F.col("markdown"), F.lit(200), F.lit(50))
    folded = splitting.merge_small(F.col("pieces"), F.lit(200), F.lit(120))
    return (
        documents(spark, folder)
        .select("doc_id", pieces.alias("pieces"))
        .select("doc_id", F.posexplode_outer(folded).alias("nth", "piece"))
        .filter("piece IS NOT NULL")
    )


def _md_chunks(spark, folder):
    return k.chunk_markdown(clean_markdown(md_corpus(spark, folder)), MD_OPTIONS)


def _from_chunks(columns: str) -> str:
    return sql.with_(*sql.MD_CHUNKS, last=f"SELECT {columns} FROM chunks")


@query("chunk_index", _from_chunks("doc_id, chunk_index, text"))
def chunk_index(spark, folder):
    return _md_chunks(spark, folder).select("doc_id", "chunk_index", "text")


@query("chunk_id", _from_chunks("doc_id, chunk_index, chunk_id"))
def chunk_id(spark, folder):
    return _md_chunks(spark, folder).select("doc_id", "chunk_index", "chunk_id")


@query("chunk_size", _from_chunks("doc_id, chunk_id, size"))
def chunk_size(spark, folder):
    return _md_chunks(spark, folder).select("doc_id", "chunk_id", "size")


@query("chunk_corpus", _from_chunks("doc_id, chunk_index, chunk_id, section, text, size"))
def chunk_corpus(spark, folder):
    return _md_chunks(spark, folder)


DOC_CHUNKS = [
    ("docs", "SELECT doc_id, text AS markdown FROM documents"),
    *sql.clean("docs"),
    *sql.chunk_ctes("cleaned"),
]


@query(
    "chunk_documents",
    sql.with_(*DOC_CHUNKS, last="SELECT doc_id, chunk_index, chunk_id, section, text, size FROM chunks"),
)
def chunk_documents(spark, folder):
    """The plain documents under the default settings."""
    return build_chunks(documents(spark, folder))


SWEEP = [
    Settings(chunk_size=300, chunk_overlap=50, min_chunk_chars=60),
    Settings(chunk_size=600, chunk_overlap=100),
    Settings(chunk_size=200, chunk_overlap=150, prepend_section=False),
]


def sweep_sql(last: str) -> str:
    """Each configuration chunked on its own, as views of one statement."""
    parts = [
        "("
        + sql.with_(
            sql.MD_CORPUS,
            *sql.clean("md_corpus"),
            *sql.chunk_ctes(
                "cleaned", s.chunk_size, s.chunk_overlap, s.min_chunk_chars, s.prepend_section
            ),
            last=f"SELECT '{s.config_key}' AS config_key, * FROM chunks",
        )
        + ")"
        for s in SWEEP
    ]
    return f"WITH sweep AS ({' UNION ALL '.join(parts)}) {last}"


def sweep(spark, folder):
    return k.chunk_sweep(clean_markdown(md_corpus(spark, folder)), SWEEP)


@query(
    "chunk_sweep",
    sweep_sql("SELECT config_key, doc_id, chunk_index, chunk_id, section, text, size FROM sweep"),
)
def chunk_sweep(spark, folder):
    return sweep(spark, folder)
