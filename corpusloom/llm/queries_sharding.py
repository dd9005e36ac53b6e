"""op11: sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import sharding
from corpusloom.llm.tables import read

SHARDS = 8


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed, _ = sharding.shard_rows(docs, docs.columns, SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


SQL = r"""
WITH RECURSIVE crc_table AS (  -- the 256 remainders of one byte
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1
                THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
    FROM range(256) r(i)
), octets AS (
    SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                  lambda h: ('0x' || h)::BIGINT) AS b
    FROM documents
), numbered AS (
    SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_number
    FROM (SELECT doc_id, len(b) + 1 AS size,
                 xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]),
                                 4294967295), 4294967295) AS text_crc32
          FROM octets, crc_table)
), grid AS (
    SELECT n, w, (n + w - 1) // w AS h
    FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS w FROM documents)
), halves AS (
    SELECT row_number AS start, 0 AS turn, row_number // h AS l, row_number % h AS r FROM numbered, grid
    UNION ALL
    SELECT start, turn,
           CASE WHEN k % 2 = 0 THEN (l + d) % w ELSE l END,
           CASE WHEN k % 2 = 0 THEN r ELSE (r + d) % h END
    FROM (SELECT *, turn % 8 AS k, turn + 1 AS turn,
                 ('0x' || left(md5(concat_ws(':', 17, turn % 8,
                      CASE WHEN turn % 2 = 0 THEN r ELSE l END)), 13))::BIGINT AS d
          FROM (SELECT * FROM halves), grid
          WHERE turn = 0 OR turn % 8 <> 0 OR l * h + r >= n) s(start, old, l, r, n, w, h, k, turn, d)
), places AS (
    SELECT start, arg_min(l * h + r, turn) AS place
    FROM halves, grid
    WHERE turn > 0 AND turn % 8 = 0 AND l * h + r < n
    GROUP BY start
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % 8)::INTEGER AS shard,
       place // 8 AS slot, NULL::INTEGER AS grown_shard, row_number
FROM numbered JOIN places ON row_number = start
"""

QUERIES = {"op11_feistel_shards": (op11, SQL)}
