"""Retrieval and answer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import answering as n
from corpusloom.operators import retrieval as r
from corpusloom.operators.reviews import question_set
from corpusloom.plans.build import embed_queries
from corpusloom.registry import sql
from corpusloom.registry.base import query, table
from corpusloom.registry.chunking import DOC_CHUNKS
from corpusloom.registry.fixtures import (
    asked,
    document_index,
    md_index,
    user_queries,
    vectors,
)
from corpusloom.sources.tables import stage

HIT = (
    "query_id, rank, doc_id, chunk_id, text, similarity, distance, match_type, section, "
    "chunk_index, matched_text"
)


@query(
    "valid_queries",
    f"""SELECT conv_id * 1000000 + turn AS query_id, CASE WHEN role = 'user' THEN text END AS query
      FROM conversations WHERE role = 'user' AND {sql.strip('text')} <> ''""",
)
def valid_queries(spark, folder):
    """Turns with what others than the user said blanked out."""
    turns = table(spark, folder, "conversations").selectExpr(
        "conv_id * 1000000 + turn AS query_id",
        "CASE WHEN role = 'user' THEN text ELSE ' \t' END AS query",
    )
    return r.valid_queries(turns)


# Dense vectors: every given embedding asks for its neighbours among all of them.
DENSE = [
    (
        "sims",
        """SELECT q.vec_id AS query_id, CAST(i.label AS BIGINT) AS doc_id, printf('v%06d', i.vec_id) AS row_id,
          'l' || i.label AS parent_id,
          round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS similarity
        FROM embeddings q, embeddings i""",
    )
]
SCORED = "query_id, doc_id, row_id, parent_id, similarity"


@query(
    "cosine_scores",
    sql.with_(
        *DENSE,
        last=f"""SELECT {SCORED}, round(1 - similarity, 6) AS distance
          FROM ({sql.numbered('sims')}) WHERE rank <= 3""",
    ),
)
def cosine_scores(spark, folder):
    rows = vectors(spark, folder)
    best = r.keep_best(r.candidates(rows, rows.select("query_id", "vector"), 3), 3)
    return best.withColumn("distance", F.round(1 - F.col("similarity"), 6)).drop("rank")


@query(
    "knn_topk",
    sql.with_(*DENSE, last=f"SELECT {SCORED}, rank FROM ({sql.numbered('sims')}) WHERE rank <= 10"),
)
def knn_topk(spark, folder):
    rows = vectors(spark, folder)
    return r.knn_topk(rows, rows.select("query_id", "vector"), 10)


@query(
    "knn_topk_blocked",
    sql.with_(*DENSE, last=f"SELECT {SCORED}, rank FROM ({sql.numbered('sims')}) WHERE rank <= 10"),
)
def knn_topk_blocked(spark, folder):
    """The same with more query vectors than may travel with a task: joined in blocks."""
    rows = vectors(spark, folder)
    scored = r.candidates(rows, rows.select("query_id", "vector"), 10, query_bytes=1)
    return r.keep_best(scored, 10)


@query(
    "collapse_by_parent",
    sql.with_(
        *DENSE,
        ("fetched", f"SELECT * FROM ({sql.numbered('sims', 'place')}) WHERE place <= 30"),
        last=f"SELECT {SCORED} FROM ({sql.COLLAPSE.format('fetched')})",
    ),
)
def collapse_by_parent(spark, folder):
    """The best row per label among the thirty nearest."""
    rows = vectors(spark, folder)
    return r.collapse_by_parent(r.knn_topk(rows, rows.select("query_id", "vector"), 30))


@query(
    "rank_hits",
    sql.with_(
        *DENSE,
        ("collapsed", sql.COLLAPSE.format("sims")),
        last=f"SELECT {SCORED}, rank FROM ({sql.numbered('collapsed')}) WHERE rank <= 4",
    ),
)
def rank_hits(spark, folder):
    """The four labels nearest to each vector, by their nearest vector."""
    rows = vectors(spark, folder)
    scored = r.candidates(rows, rows.select("query_id", "vector"), 4, by_parent=True)
    return r.rank_hits(r.collapse_by_parent(scored), 4)


CELLS = """list_sum([CASE WHEN round(list_sum(list_transform(range(64), lambda i:
    v[i + 1] * (1 - 2 * (bit_count(i & (j + 1)) % 2)))), 9) > 0 THEN 1 << j ELSE 0 END
    FOR j IN range(4)])"""
NEAR = [
    *DENSE,
    ("cells", f"SELECT vec_id, CAST({CELLS} AS BIGINT) AS cell FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"),
    (
        "near",
        """SELECT sims.* FROM sims JOIN cells q ON q.vec_id = query_id
          JOIN cells c ON printf('v%06d', c.vec_id) = row_id WHERE bit_count(xor(q.cell, c.cell)) <= 1""",
    ),
]


@query(
    "search_ann",
    sql.with_(*NEAR, last=f"SELECT {SCORED}, rank FROM ({sql.numbered('near')}) WHERE rank <= 10"),
)
def search_ann(spark, folder):
    rows = vectors(spark, folder)
    return r.search_ann(rows, rows.select("query_id", "vector"), 10)


@query(
    "ann_recall",
    sql.with_(
        *NEAR,
        ("exact", f"SELECT * FROM ({sql.numbered('sims')}) WHERE rank <= 10"),
        ("close", f"SELECT * FROM ({sql.numbered('near')}) WHERE rank <= 10"),
        last="""SELECT e.query_id, count(*) AS expected, count(c.row_id) AS found,
          round(count(c.row_id) / count(*), 6) AS recall
          FROM exact e LEFT JOIN close c ON c.query_id = e.query_id AND c.row_id = e.row_id GROUP BY e.query_id""",
    ),
)
def ann_recall(spark, folder):
    rows = vectors(spark, folder)
    queries = rows.select("query_id", "vector")
    return r.recall_at_k(r.search_ann(rows, queries, 10), r.knn_topk(rows, queries, 10))


# Hash vectors: what users said against the chunks and questions of the markdown corpus.
@query(
    "resolve_parent_text",
    sql.with_(
        *sql.MD_INDEX,
        sql.QUERIES,
        *sql.similarities(),
        *sql.ranked(3, None, collapse=False),
        sql.HITS,
        last="SELECT query_id, rank, doc_id, chunk_id, text FROM hits",
    ),
)
def resolve_parent_text(spark, folder):
    index, queries = md_index(spark, folder), asked(spark, folder)
    ranked = r.knn_topk(index, queries, 3)
    hits = r.resolve_hits(ranked, index, 6 * queries.count())
    return hits.select("query_id", "rank", "doc_id", "chunk_id", "text")


def _search(spark, folder, **options):
    queries = asked(spark, folder)
    return r.search(md_index(spark, folder), queries, n_queries=queries.count(), **options)


@query(
    "hit_projection",
    sql.with_(
        *sql.MD_SEARCH[:-1],
        once=("chunks", "index_rows", "row_weights", "query_weights", "sims", "ranked"),
        last="""SELECT query_id, rank, type AS match_type,
          CASE WHEN type = 'question' THEN document ELSE '' END AS matched_text, section, chunk_index
          FROM ranked JOIN index_rows USING (doc_id, row_id)""",
    ),
)
def hit_projection(spark, folder):
    hits = _search(spark, folder)
    return hits.select("query_id", "rank", "match_type", "matched_text", "section", "chunk_index")


@query("search", sql.with_(*sql.MD_SEARCH, last=f"SELECT {HIT} FROM hits"))
def search(spark, folder):
    return _search(spark, folder)


@query(
    "search_without_dedupe",
    sql.with_(
        *sql.MD_INDEX,
        sql.QUERIES,
        *sql.similarities(),
        *sql.ranked(5, 5, collapse=False),
        sql.HITS,
        last=f"SELECT {HIT} FROM hits",
    ),
)
def search_without_dedupe(spark, folder):
    return _search(spark, folder, dedupe=False)


@query(
    "search_exact",
    sql.with_(
        *sql.MD_INDEX,
        sql.QUERIES,
        *sql.similarities(),
        *sql.ranked(8),
        sql.HITS,
        last=f"SELECT {HIT} FROM hits",
    ),
)
def search_exact(spark, folder):
    queries = asked(spark, folder)
    return r.search_exact(md_index(spark, folder), queries, 8, queries.count())


PER_QUERY_K = "CAST(length(query) % 4 AS INT)"


@query(
    "overfetch",
    sql.with_(
        *sql.MD_INDEX,
        (
            "asked",
            f"SELECT *, coalesce(nullif({PER_QUERY_K}, 0), 5) AS k FROM ({sql.QUERIES[1]})",
        ),
        *sql.similarities(),
        (
            "fetched",
            f"SELECT n.* EXCLUDE (place) FROM ({sql.numbered('sims', 'place')}) n JOIN asked USING (query_id) WHERE place <= 3 * k",
        ),
        ("collapsed", sql.COLLAPSE.format("fetched")),
        (
            "ranked",
            f"SELECT n.* FROM ({sql.numbered('collapsed')}) n JOIN asked USING (query_id) WHERE rank <= k",
        ),
        sql.HITS,
        last="SELECT query_id, rank, doc_id, chunk_id, similarity FROM hits",
    ),
)
def overfetch(spark, folder):
    """Each query with a k of its own; 0 means the default."""
    queries = asked(spark, folder).selectExpr("*", f"{PER_QUERY_K} AS top_k")
    hits = r.search_per_query(md_index(spark, folder), queries)
    return hits.select("query_id", "rank", "doc_id", "chunk_id", "similarity")


@query(
    "search_documents",
    sql.with_(
        *DOC_CHUNKS,
        sql.CHUNK_ROWS_ONLY,
        sql.QUERIES,
        *sql.similarities(),
        *sql.ranked(5, 15),
        sql.HITS,
        last=f"SELECT {HIT} FROM hits",
    ),
)
def search_documents(spark, folder):
    """Flagship: whole documents chunked and embedded, searched for what users said."""
    queries = asked(spark, folder)
    return r.search(document_index(spark, folder), queries, n_queries=queries.count())


QUESTION_SET = f"""SELECT question, min(seq) AS first_seen FROM (
  SELECT {sql.strip('text')} AS question, conv_id * 1000000 + turn AS seq FROM conversations)
  WHERE question <> '' GROUP BY question"""


@query("question_set", QUESTION_SET)
def question_set_(spark, folder):
    return question_set(_turns(spark, folder))


def _turns(spark, folder):
    return table(spark, folder, "conversations").selectExpr(
        "'  ' || text || ' ' AS question", "conv_id * 1000000 + turn AS seq"
    )


@query(
    "search_all",
    sql.with_(
        *sql.MD_INDEX,
        ("asked", f"SELECT first_seen AS query_id, question AS query FROM ({QUESTION_SET})"),
        *sql.similarities(),
        *sql.ranked(2, 6),
        sql.HITS,
        last="SELECT query_id, rank, doc_id, chunk_id, similarity FROM hits",
    ),
)
def search_all(spark, folder):
    """The whole question set in one job."""
    queries = question_set(_turns(spark, folder)).selectExpr(
        "first_seen AS query_id", "question AS query"
    )
    queries = stage(embed_queries(queries))
    hits = r.search(md_index(spark, folder), queries, 2, n_queries=queries.count())
    return hits.select("query_id", "rank", "doc_id", "chunk_id", "similarity")


PACKED = (
    "in_context",
    """SELECT query_id, rank, '[' || rank || '] (' || coalesce(nullif(section, ''), 'document') || ')'
      || chr(10) || left(text, CAST(least(length(text), 700 - before) AS BIGINT)) AS block,
      CAST(least(length(text), 700 - before) AS INTEGER) AS used FROM (
        SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hits) WHERE before < 700""",
)


@query(
    "pack_context",
    sql.with_(*sql.MD_SEARCH, PACKED, last="SELECT query_id, rank, block, used FROM in_context"),
)
def pack_context(spark, folder):
    return n.pack_context(_search(spark, folder), 700)


PROMPTED = (
    "prompted",
    """SELECT query_id, 'Answer the question using ONLY the numbered sources below. Cite the sources you use '
      || 'as [1], [2], and so on. If the sources do not contain the answer, say so plainly.' || chr(10) || chr(10)
      || 'Question: ' || query || chr(10) || chr(10) || 'Sources:' || chr(10)
      || string_agg(block, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Answer:' AS prompt
    FROM asked JOIN in_context USING (query_id) GROUP BY query_id, query""",
)
EVERYONE = ("everyone", "SELECT conv_id * 1000000 + turn AS query_id FROM conversations")
FIXED = "No sources retrieved — nothing to answer from."


def _prompts(spark, folder):
    """All turns ask, but only what users said has been searched for."""
    everyone = table(spark, folder, "conversations").selectExpr(
        "conv_id * 1000000 + turn AS query_id", "text AS query"
    )
    return n.answer_prompts(everyone, n.pack_context(_search(spark, folder), 700))


@query(
    "answer_prompts",
    sql.with_(
        *sql.MD_SEARCH,
        PACKED,
        PROMPTED,
        EVERYONE,
        last=f"""SELECT query_id, prompt, CASE WHEN prompt IS NULL THEN '{FIXED}' END AS fixed_answer
          FROM everyone LEFT JOIN prompted USING (query_id)""",
    ),
)
def answer_prompts(spark, folder):
    return _prompts(spark, folder)


def citing_model(prompts: list[str]) -> list[str]:
    """Stands in for a chat model: cites by the length of the prompt."""
    return [f"As [1] says, and [{len(p) % 9}] too; see [1] again." for p in prompts]


ANSWERED = (
    "answered",
    f"""SELECT query_id, CASE WHEN prompt IS NULL THEN '{FIXED}'
      ELSE 'As [1] says, and [' || length(prompt) % 9 || '] too; see [1] again.' END AS answer
    FROM everyone LEFT JOIN prompted USING (query_id)""",
)


@query(
    "answer",
    sql.with_(
        *sql.MD_SEARCH, PACKED, PROMPTED, EVERYONE, ANSWERED, last="SELECT query_id, answer FROM answered"
    ),
)
def answer(spark, folder):
    return n.answer(_prompts(spark, folder), citing_model).select("query_id", "answer")


@query(
    "answer_without_model",
    sql.with_(
        *sql.MD_SEARCH,
        PACKED,
        PROMPTED,
        EVERYONE,
        last=f"""SELECT query_id, CASE WHEN prompt IS NULL THEN '{FIXED}'
          ELSE 'No model configured — pass one to generate answers.' END AS answer
          FROM everyone LEFT JOIN prompted USING (query_id)""",
    ),
)
def answer_without_model(spark, folder):
    return n.answer(_prompts(spark, folder)).select("query_id", "answer")


@query(
    "citations",
    sql.with_(
        *sql.MD_SEARCH,
        PACKED,
        PROMPTED,
        EVERYONE,
        ANSWERED,
        (
            "cited",
            r"""SELECT DISTINCT query_id, CAST(unnest(regexp_extract_all(answer, '\[([0-9]+)\]', 1)) AS INTEGER) AS cited
            FROM answered""",
        ),
        last="""SELECT c.query_id, cited, h.doc_id, h.chunk_id, h.chunk_id IS NOT NULL AS valid
          FROM cited c LEFT JOIN hits h ON h.query_id = c.query_id AND h.rank = cited""",
    ),
)
def citations(spark, folder):
    hits = stage(_search(spark, folder))
    prompts = n.answer_prompts(user_queries(spark, folder), n.pack_context(hits, 700))
    return n.citations(n.answer(prompts, citing_model), hits)
