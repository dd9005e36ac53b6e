"""op12: conversation prefix trie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import prefix_trie
from corpusloom.llm.tables import read, stage

FAMILY, LENT = 5, 9


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations that begin like the first of their family of five."""
    turns = stage(prefix_trie.ordered_turns(conversations))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns(
        {"h": shared, "base": F.col("conv_id") - F.col("conv_id") % FAMILY}
    )
    sizes = stage(sizes)
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    lent = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = stage(
        sizes.join(base, "base", "left").select(
            "conv_id", "base", "h", lent.alias("lent"),
            (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        )
    )
    own = turns.filter(F.col("pos") >= shared).join(plan, "conv_id").select(
        "conv_id", (F.col("lent") + F.col("pos") - F.col("h") + 1).alias("d"), "length", "digest", "bytes"
    )
    borrowed = (
        turns.filter(F.col("pos") < LENT - 1)  # at most so many turns of a conversation are lent
        .withColumnRenamed("conv_id", "base")
        .join(plan, "base")
        .filter("pos < h")
        .select("conv_id", (F.col("pos") + 1).alias("d"), "length", "digest", "bytes")
    )
    return own.unionByName(borrowed), plan.select("conv_id", "length")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(*rebuilt(read(spark, sf_dir, "conversations")))


SQL = r"""
WITH ordered AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
           {'role': role, 'text': text} AS said
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
          FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
    SELECT conv_id, list(said ORDER BY pos) AS own,
           (xor(list_reduce(list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'),
                                           lambda x: ('0x' || x)::BIGINT),
                lambda c, x: list_reduce(range(8), lambda r, k: CASE WHEN r & 1 = 1
                    THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, x)), 4294967295),
                4294967295) % 9)::INTEGER AS h
    FROM ordered GROUP BY conv_id
), rebuilt AS (
    SELECT c.conv_id, coalesce(b.own[:c.h], []) || c.own[c.h + 1:] AS turns
    FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5
), members AS (
    SELECT conv_id, d, turns[:d] AS path, len(turns) = d AS ends
    FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
           CASE WHEN d = 0 THEN 0 ELSE strlen(path[d].text) END AS size
    FROM members GROUP BY d, path
), children AS (
    SELECT d - 1 AS d, path[:d - 1] AS path, count(*) AS n_children
    FROM nodes WHERE d > 0 GROUP BY ALL
), filled AS (
    SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (d, path)
), above AS (
    SELECT u.path[:k] AS path, k AS d, count(*) FILTER (u.n_children = 0) AS n_leaves,
           sum((u.n_convs - 1) * u.size)::BIGINT AS saved_tokens
    FROM (SELECT *, unnest(range(d + 1)) AS k FROM filled) u GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, a.n_leaves,
       a.saved_tokens, n.ends_sha256
FROM filled n JOIN above a USING (d, path)
LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.path = n.path[:n.d - 1]
"""

QUERIES = {"op12_centroid_trie": (op12, SQL)}
