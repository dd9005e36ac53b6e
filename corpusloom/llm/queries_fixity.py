"""op6: fixity audit of a damaged replica of the pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import fixity
from corpusloom.llm.tables import read, stage


def damaged() -> Column:
    """What a replica holds of a page: of 101 pages one has another character in its middle, and
    one lost its second half.
    """
    html, left = F.col("html"), F.col("page_id") % 101
    half = F.floor(F.length(html) / 2).cast("int")
    rotten = F.when(F.substr(html, half + 1, F.lit(1)) == "#", "%").otherwise("#")
    rot = F.concat(F.left(html, half), rotten, F.substr(html, half + 2))
    return (
        F.when((left == 7) & (F.length(html) > 0), rot)
        .when(left == 8, F.left(html, half))
        .otherwise(html)
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    expected = stage(fixity.archive(pages))
    replica = fixity.archive(pages.withColumn("stored", damaged()), "stored")
    found = stage(replica.filter("page_id IS NULL OR page_id % 101 <> 9"))
    return fixity.audit(expected, found)


SQL = """
WITH a AS (
    SELECT page_id, html, url,
        'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
        || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
        || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
        || 'Content-Length: ' AS head,
        CASE WHEN page_id % 101 = 7 AND length(html) > 0
             THEN html[1 : length(html) // 2]
                  || CASE WHEN html[length(html) // 2 + 1] = '#' THEN '%' ELSE '#' END
                  || html[length(html) // 2 + 2 :]
             WHEN page_id % 101 = 8 THEN html[1 : length(html) // 2]
             ELSE html END AS bad
    FROM pages
), r AS (
    SELECT page_id, page_id // 512 AS volume,
        head || strlen(coalesce(html, '')) || repeat(chr(13) || chr(10), 2) || coalesce(html, '')
             || repeat(chr(13) || chr(10), 2) AS good,
        head || strlen(coalesce(html, '')) || repeat(chr(13) || chr(10), 2) || coalesce(bad, '')
             || repeat(chr(13) || chr(10), 2) AS bad
    FROM a
), placed AS (
    SELECT *, coalesce(sum(strlen(good)) OVER (PARTITION BY volume ORDER BY page_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
    FROM r
)
SELECT page_id, volume, 0::BIGINT AS part, "offset",
       CASE WHEN page_id % 101 = 9 THEN 'missing' ELSE 'changed' END AS kind,
       sha256(good) AS expected_sha256,
       CASE WHEN page_id % 101 <> 9 THEN sha256(bad) END AS found_sha256,
       strlen(good)::BIGINT AS expected_length,
       CASE WHEN page_id % 101 <> 9 THEN strlen(bad)::BIGINT END AS found_length
FROM placed
WHERE page_id % 101 = 9 OR good <> bad
"""

QUERIES = {"op6_merkle_fixity": (op6, SQL)}
