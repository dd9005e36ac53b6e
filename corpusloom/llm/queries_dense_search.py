"""op13: ranked lexical search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import dense_search
from corpusloom.llm.tables import read


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_search.search(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 10
    )


SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), lengths AS (
    SELECT doc_id, len(terms) AS n FROM d WHERE len(terms) > 0
), corpus AS (
    SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM lengths
), tf AS (
    SELECT doc_id, term, count(*) AS tf
    FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY doc_id, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus
), asked AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM benchmark)
    GROUP BY item_id, term
), scored AS (
    SELECT item_id, doc_id,
           sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT
               AS score
    FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), corpus
    GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank,
           doc_id, score
    FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

QUERIES = {"op13_dense_tiles": (op13, SQL)}
