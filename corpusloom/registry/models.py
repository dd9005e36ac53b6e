"""Queries on generated questions, embeddings and model responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import vectors as v
from corpusloom.operators import augmentation as a
from corpusloom.operators import embedding as e
from corpusloom.operators import responses as r
from corpusloom.registry import sql
from corpusloom.registry.base import dealt, query, table
from corpusloom.registry.fixtures import (
    documents,
    md_chunks,
    md_completions,
    question_model,
)

from corpusloom.sources.pages import scan_table


@query(
    "question_prompts",
    sql.with_(
        *sql.MD_CHUNKS,
        last="""SELECT doc_id, chunk_id, 'Given the following text, generate 2 concise questions that a user might ask '
          || 'which can be directly answered by this text.' || chr(10) || 'Return ONLY the questions, one per line, '
          || 'without numbering.' || chr(10) || chr(10) || 'Text:' || chr(10) || text AS prompt FROM chunks""",
    ),
)
def question_prompts(spark, folder):
    return a.question_prompts(md_chunks(spark, folder), 2)


RAW = """'1. What does ' || split_part(text, chr(10), 1) || ' say?' || chr(10) || chr(10) || '- '
  || replace(left(text, 50), chr(10), ' ') || chr(10)"""


@query(
    "generate",
    sql.with_(
        *sql.MD_CHUNKS,
        last=f"""SELECT doc_id, chunk_id, CASE WHEN length(text) % 2 = 0 THEN {RAW} END AS raw,
          CASE WHEN length(text) % 2 = 1 THEN 'no answer' END AS error FROM chunks""",
    ),
)
def generate(spark, folder):
    """Every chunk through a stand-in model that fails on texts of odd length."""
    return a.complete(a.question_prompts(md_chunks(spark, folder), 2), question_model)


# Documents read as if they were completions: each line with a list mark put before it.
LISTED = """regexp_replace(text, '(?m)^', CASE WHEN doc_id % 3 = 0 THEN '- ' WHEN doc_id % 3 = 1
  THEN '12) ' ELSE '100 mg ' END)"""


@query(
    "parse_questions",
    rf"""WITH ls AS (SELECT doc_id, unnest(list_filter(list_transform(
        regexp_split_to_array({LISTED.replace("END)", "END, 'g')")}, '{sql.LINE_END}'),
        lambda l: {sql.strip("regexp_replace(" + sql.strip("l") + ", '^([-*•]+" + sql.WS + "*)?([0-9]+[.)]" + sql.WS + "+)?', '')")}),
        lambda l: l <> '')[1:3]) AS question FROM documents)
      SELECT doc_id, question FROM ls""",
)
def parse_questions(spark, folder):
    raw = table(spark, folder, "documents").selectExpr("doc_id", f"{LISTED} AS raw")
    return raw.select("doc_id", F.explode(a.parse_questions(F.col("raw"), 3)).alias("question"))


@query(
    "nonempty_questions",
    sql.with_(
        *sql.MD_CHUNKS,
        *sql.MD_QUESTIONS,
        last="""SELECT doc_id, chunk_id, string_agg(question, chr(10) ORDER BY nth) AS questions
          FROM questions GROUP BY doc_id, chunk_id""",
    ),
)
def nonempty_questions(spark, folder):
    asked = a.chunk_questions(md_completions(spark, folder), 2)
    return asked.withColumn("questions", F.array_join("questions", "\n"))


@query("asymmetric_prefix", "SELECT doc_id, 'passage: ' || text AS document FROM documents")
def asymmetric_prefix(spark, folder):
    return documents(spark, folder).select(
        "doc_id", e.with_prefix(F.col("markdown"), e.DOCUMENT_PREFIX).alias("document")
    )


@query(
    "batch_rows",
    sql.with_(
        *sql.MD_CHUNKS,
        last="""SELECT doc_id, CAST(chunk_index // 4 AS INTEGER) AS batch,
          string_agg(chunk_id, ' ' ORDER BY chunk_index) AS items FROM chunks GROUP BY doc_id, chunk_index // 4""",
    ),
)
def batch_rows(spark, folder):
    batches = e.batch_rows(md_chunks(spark, folder), 4, "doc_id", ["chunk_index"], "chunk_id")
    return batches.withColumn("items", F.array_join("items", " "))


HASHED = sql.with_(
    *sql.weights("documents", "doc_id", "text", "weights"),
    last="SELECT doc_id, bucket, round(weight, 9) AS weight FROM weights",
)


@query("hash_embed", HASHED)
def hash_embed(spark, folder):
    """Non-zero entries of the hash vectors of whole documents."""
    rows = dealt(scan_table(spark, f"{folder}/documents.parquet")).select("doc_id", "text")
    rows = e.embed_hash(rows, "text")
    sparse = v.sparse_entries(rows, ["doc_id"])
    return sparse.withColumn("weight", F.round("weight", 9))


@query(
    "l2_normalize",
    """SELECT vec_id, pos, round(x / CASE WHEN norm > 0 THEN norm ELSE 1 END, 9) AS value FROM (
      SELECT vec_id, pos, x, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS norm FROM (
        SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos,
          CASE WHEN label = 3 THEN 0 ELSE CAST(unnest(embedding) AS DOUBLE) * (1 + label) END AS x FROM embeddings))""",
)
def l2_normalize(spark, folder):
    """Vectors stretched by label, those of one label all zero."""
    stretched = table(spark, folder, "embeddings").withColumn(
        "vector",
        F.transform(
            F.col("embedding").cast("array<double>"),
            lambda x: F.when(F.col("label") == 3, 0.0).otherwise(x * (1 + F.col("label"))),
        ),
    )
    unit = stretched.select("vec_id", F.posexplode(v.l2_normalize(F.col("vector"))).alias("pos", "value"))
    return unit.withColumn("value", F.round("value", 9))


@query(
    "densify",
    """SELECT vec_id, pos, CASE WHEN x > 0 THEN x ELSE 0 END AS value FROM (
      SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos,
        CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)""",
)
def densify(spark, folder):
    """The positive entries of each vector, made dense again."""
    entries = F.filter(
        F.transform(
            F.col("embedding").cast("array<double>"),
            lambda x, at: F.struct(at.alias("bucket"), x.alias("weight")),
        ),
        lambda entry: entry["weight"] > 0,
    )
    rows = table(spark, folder, "embeddings").select("vec_id", v.densify(entries, 64).alias("d"))
    return rows.select("vec_id", F.posexplode("d").alias("pos", "value"))


def _embedding_log(spark, folder):
    """Responses to requests of four inputs, rows in reverse; every fifth lacks one row."""
    request = F.floor(F.col("vec_id") / 4)
    row = F.struct(
        (F.col("vec_id") % 4).cast("int").alias("index"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    answers = (
        table(spark, folder, "embeddings")
        .groupBy(request.alias("request_id"))
        .agg(F.sort_array(F.collect_list(row), asc=False).alias("data"))
    )
    lost = F.when(F.col("request_id") % 5 == 0, 1).otherwise(0)
    return answers.select(
        "request_id",
        (F.size("data") + lost).cast("int").alias("n_inputs"),
        F.lit(200).alias("status"),
        F.to_json(F.struct("data")).alias("body"),
    )


@query(
    "parse_embedding_response",
    """WITH n AS (SELECT vec_id // 4 AS request_id, count(*) AS rows FROM embeddings GROUP BY 1)
      SELECT request_id, CASE WHEN request_id % 5 = 0 THEN printf('Asked for %d embeddings, got %d.', rows + 1, rows)
        ELSE 'ok' END AS status, CASE WHEN request_id % 5 <> 0 THEN CAST(vec_id % 4 AS INTEGER) END AS pos,
        place, CASE WHEN request_id % 5 <> 0 THEN CAST(embedding[place + 1] AS DOUBLE) END AS value
      FROM (SELECT request_id, rows, vec_id, embedding, CAST(unnest(CASE WHEN request_id % 5 = 0
          THEN [NULL] ELSE range(len(embedding)) END) AS INTEGER) AS place
        FROM embeddings JOIN n ON n.request_id = vec_id // 4 WHERE request_id % 5 <> 0 OR vec_id % 4 = 0)""",
)
def parse_embedding_response(spark, folder):
    parsed = r.parse_embedding_response(_embedding_log(spark, folder))
    return parsed.select(
        "request_id", "status", F.posexplode_outer("vectors").alias("pos", "vector")
    ).select("request_id", "status", "pos", F.posexplode_outer("vector").alias("place", "value"))


def _completion_log(spark, folder):
    """Chat responses made of turns: with scratchpad, spent budget, no choice, plain."""
    turns = table(spark, folder, "conversations")
    case = F.col("turn") % 4
    content = F.when(case == 0, F.concat(F.lit("<think>let me\nsee</Think> \n"), "text")).when(
        case == 3, F.concat(F.lit(" "), "text")
    )
    choice = F.struct(
        F.struct(content.alias("content")).alias("message"),
        F.when(case == 1, "length").alias("finish_reason"),
    )
    usage = F.struct(
        F.struct(F.length("text").cast("long").alias("reasoning_tokens")).alias(
            "completion_tokens_details"
        )
    )
    body = F.when(case == 2, F.lit('{"choices":[]}')).otherwise(
        F.to_json(
            F.struct(F.array(choice).alias("choices"), F.when(case == 1, usage).alias("usage"))
        )
    )
    return turns.select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("request_id"),
        F.lit(200).alias("status"),
        body.alias("body"),
    )


@query(
    "parse_completion",
    f"""SELECT conv_id * 1000000 + turn AS request_id,
      CASE WHEN turn % 4 IN (0, 3) THEN {sql.strip('text')} END AS content,
      CASE turn % 4 WHEN 2 THEN 'No choices in response: {{"choices":[]}}'
        WHEN 1 THEN 'Empty reply (finish_reason=''length'', reasoning_tokens=' || length(text)
          || '). Raise max_tokens: reasoning is billed against the same budget.' END AS error
      FROM conversations""",
)
def parse_completion(spark, folder):
    return r.parse_completion(_completion_log(spark, folder))


LOG = """SELECT conv_id * 1000000 + turn AS request_id, CAST(1 + turn % 3 AS INT) AS n_inputs,
  CAST(CASE conv_id % 7 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 400 WHEN 3 THEN 400 WHEN 4 THEN 404
    ELSE 200 END AS INT) AS status,
  CASE conv_id % 7 WHEN 2 THEN '{"error":"Too many inputs"}' WHEN 3 THEN '{"error":"unknown model"}'
    WHEN 4 THEN '{"error":"batch not found"}' WHEN 5 THEN '{"error":"upstream"}' ELSE '{"data":[]}' END AS body
FROM conversations"""


def _log(spark, folder):
    spark_sql = LOG.replace("{", "{{").replace("}", "}}").replace("FROM conversations", "FROM {turns}")
    return spark.sql(spark_sql, turns=table(spark, folder, "conversations"))


OUTCOMES = f"""SELECT request_id, n_inputs, CASE
  WHEN status IN (429, 503) THEN 'retry'
  WHEN status = 400 AND n_inputs > 1 AND body ILIKE '%too many%' THEN 'split'
  WHEN status = 200 AND body NOT LIKE '%error%' THEN 'ok' ELSE 'fail' END AS outcome FROM ({LOG})"""


@query("classify_response", f"SELECT request_id, outcome FROM ({OUTCOMES})")
def classify_response(spark, folder):
    return r.classify_responses(_log(spark, folder)).select("request_id", "outcome")


@query(
    "outcome_counts",
    f"""SELECT outcome, count(*) AS requests, CAST(sum(n_inputs) AS BIGINT) AS inputs
      FROM ({OUTCOMES}) GROUP BY outcome""",
)
def outcome_counts(spark, folder):
    return r.outcome_counts(_log(spark, folder))


@query(
    "split_oversized_batch",
    """SELECT request_id, CAST(half AS INTEGER) AS half, array_to_string(
        CASE WHEN half = 0 AND len(ws) > 1 THEN ws[1:len(ws) // 2] WHEN half = 0 THEN ws
          ELSE ws[len(ws) // 2 + 1:] END, ' ') AS items
      FROM (SELECT conv_id * 1000000 + turn AS request_id, string_split(text, ' ') AS ws FROM conversations),
        (SELECT unnest([0, 1]) AS half) WHERE half = 0 OR len(ws) > 1""",
)
def split_oversized_batch(spark, folder):
    """Turns as rejected batches of words."""
    batches = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("request_id"),
        F.split("text", " ").alias("items"),
    )
    return r.halve_batches(batches).withColumn("items", F.array_join("items", " "))


@query(
    "split_rejected_batches",
    """WITH RECURSIVE parts AS (
        SELECT conv_id * 1000000 + turn AS request_id, '' AS path, string_split(text, ' ') AS ws FROM conversations
        UNION ALL
        SELECT request_id, path || half,
          CASE WHEN half = 0 THEN ws[:len(ws) // 2] ELSE ws[len(ws) // 2 + 1:] END
        FROM parts, (SELECT unnest([0, 1]) AS half)
        WHERE len(ws) > 1 AND length(array_to_string(ws, ' ')) > 40
      )
      SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY path) - 1 AS INTEGER) AS part,
        array_to_string(ws, ' ') AS items
      FROM parts WHERE len(ws) <= 1 OR length(array_to_string(ws, ' ')) <= 40""",
)
def split_rejected_batches(spark, folder):
    """Turns as batches of words, for a service that takes at most forty characters."""
    batches = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("request_id"),
        F.split("text", " ").alias("items"),
    )
    parts = r.split_until_accepted(batches, lambda ws: F.length(F.array_join(ws, " ")) <= 40)
    return parts.withColumn("items", F.array_join("items", " "))


def count_model(texts: list[str]) -> list[list[float]]:
    """Stands in for an embedding model: characters, spaces, and a constant."""
    return [[float(len(text)), float(text.count(" ")), 1.0] for text in texts]


@query(
    "embed_with_model",
    """SELECT doc_id, round(a / n, 9) AS x, round(b / n, 9) AS y, round(1 / n, 9) AS z FROM (
      SELECT *, sqrt(a * a + b * b + 1) AS n FROM (
        SELECT doc_id, CAST(length(text) + 9 AS DOUBLE) AS a,
          CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE) AS b FROM documents))""",
)
def embed_with_model(spark, folder):
    rows = e.embed_with_model(documents(spark, folder), count_model, "markdown")
    at = lambda i: F.round(F.col("vector")[i], 9)
    return rows.select("doc_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
