"""op5: license scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import licenses
from corpusloom.llm.tables import read


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    base = licenses.phrase_places(docs)
    found = licenses.template_blocks(docs).groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("containment")
    )
    found = found.select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "found", "containment"
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", none)))
    return base.join(found, same, "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0)
        .otherwise(F.coalesce("containment", F.lit(0.0)))
        .alias("score"),
    )


_TEMPLATES = ", ".join(
    f"('{label}', {sorted(set(text.split()))})" for label, text in licenses.TEMPLATES.items()
)
SQL = rf"""
WITH templates(label, t) AS (VALUES {_TEMPLATES}),
docs AS (
    SELECT row_number() OVER () AS id, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                        'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), places AS (
    SELECT *,
      list_filter(range(len(w)), lambda i: w[i+1] = 'mit' AND w[i+2] = 'license') AS mit,
      list_filter(range(len(w)), lambda i: w[i+1] = 'apache' AND w[i+2] = 'license') AS apache,
      list_filter(range(len(w)), lambda i: w[i+1] = 'general' AND w[i+2] = 'public'
                                           AND w[i+3] = 'license') AS gpl
    FROM docs
), blocks AS (
    SELECT id, list_distinct(w[{licenses.STRIDE} * k + 1 : {licenses.STRIDE} * (k + 2)]) AS b
    FROM (SELECT id, w, unnest(range(len(w) // {licenses.STRIDE} + 1)) AS k FROM docs)
), found AS (
    SELECT id, label, max(len(list_intersect(t, b)) / len(t)) AS share
    FROM blocks, templates
    WHERE len(list_intersect(t, b)) >= ceil({licenses.LEAST} * len(t))
    GROUP BY id, label
), by_doc AS (
    SELECT id, list(label) AS labels, max(share) AS share FROM found GROUP BY id
), base AS (
    SELECT *, list_concat(mit, apache, gpl) AS spots,
           list_filter(['apache', 'gpl', 'mit'],
               lambda x: CASE x WHEN 'apache' THEN len(apache) WHEN 'gpl' THEN len(gpl)
                              ELSE len(mit) END > 0) AS names
    FROM places
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(spots)::BIGINT AS n_base,
       list_min(spots)::BIGINT AS first_word, list_max(spots)::BIGINT AS last_word,
       array_to_string(names, ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(names, coalesce(labels, [])))), ',')
           AS labels,
       CASE WHEN len(spots) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM base LEFT JOIN by_doc USING (id)
"""

QUERIES = {"op5_template_containment": (op5, SQL)}
