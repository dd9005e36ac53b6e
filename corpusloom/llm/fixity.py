"""Fixity audit of WARC replicas by Merkle trees.

Pages are written as WARC records into volumes, one after another. A record's leaf is the SHA-256 of
its bytes; the records that begin in an offset range make a node, some neighbouring ranges the next,
up to a volume's root, and volumes are joined likewise up to the replica's root. Two replicas are
compared from the root down: only children of nodes that differ are looked at, and in the end only
the records of ranges that differ. Bytes that rot, are cut off or lost keep other offsets as they
are, so the damage shows in its own branch only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.tables import stage

#: Page ids of a volume, rows of a volume at most (but for equal rows), bytes of a range, children.
IDS, ROWS, RANGE, FANOUT = 512, 4096, 1 << 16, 16


def record(page_id: Column, url: Column, html: Column, held: Column | None = None) -> Column:
    """A WARC record as text; nulls are empty. ``held`` is what stands where ``html`` should."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        text(page_id),
        F.lit(">\r\nWARC-Target-URI: "),
        text(url),
        F.lit("\r\nContent-Length: "),
        F.octet_length(text(html)).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, text(html if held is None else held), F.lit("\r\n\r\n"))


def archive(pages: DataFrame, stored: str | None = None) -> DataFrame:
    """Where each page's record stands: volume, part, offset, length, page_id, digest.

    ``pages`` is (page_id, url, html); nulls are written as empty, a null page_id goes to volume
    -1. A volume takes the pages of an id range; one with many rows (an id that repeats) is cut into
    parts by digest. Repeated rows are records of their own. Other columns are ignored; an empty
    table has no records. Texts are hashed where they are read, only digests are moved.

    ``stored`` names the column with what a replica holds at the place of ``html``: places follow
    ``html``, lengths and digests what is held.
    """
    written = record(F.col("page_id"), F.col("url"), F.col("html"))
    held = written if stored is None else record(F.col("page_id"), F.col("url"), F.col("html"), F.col(stored))
    known = pages.select("page_id", written.alias("w"), held.alias("h")).select(
        "page_id",
        F.coalesce(F.floor(F.col("page_id") / IDS), F.lit(-1)).alias("volume"),
        F.octet_length("w").cast("long").alias("room"),
        F.sha2("w", 256).alias("name"),
        F.octet_length("h").cast("long").alias("length"),
        F.sha2("h", 256).alias("digest"),
    )
    known = stage(known)
    parts = known.groupBy("volume").agg(F.ceil(F.count("*") / ROWS).alias("parts"))
    part = F.conv(F.substring("name", 1, 8), 16, 10).cast("long") % F.col("parts")
    before = (
        W.partitionBy("volume", "part")
        .orderBy("page_id", "name", "digest")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        known.join(parts, "volume")
        .withColumn("part", part)
        .withColumn("offset", F.coalesce(F.sum("room").over(before), F.lit(0)))
        .select("volume", "part", "offset", "length", "page_id", "digest")
    )


def tree(records: DataFrame, ranges: int, volumes: int) -> list[DataFrame]:
    """Nodes (volume, part, place, hash) of each level, the offset ranges first, the root last.

    ``ranges`` and ``volumes`` bound the numbers of ranges of a volume and of volumes. Hashes cover
    places, so nothing can change places unseen. A node has at most as many children as a range
    holds records, or ``FANOUT``.
    """
    leaf = F.struct(
        "offset", F.concat_ws(":", "offset", "length", F.coalesce("digest", F.lit(""))).alias("h")
    )
    level = (
        records.withColumn("place", F.floor(F.col("offset") / RANGE))
        .groupBy("volume", "part", "place")
        .agg(_hash(leaf))
    )
    levels = [stage(level)]
    while ranges > 1:
        ranges = -(-ranges // FANOUT)
        child = F.struct("place", F.concat_ws(":", "place", "hash").alias("h"))
        level = (
            levels[-1]
            .withColumn("up", F.floor(F.col("place") / FANOUT))
            .groupBy("volume", "part", "up")
            .agg(_hash(child))
            .withColumnRenamed("up", "place")
        )
        levels.append(stage(level))
    while True:
        child = F.struct(
            "volume", "part", F.concat_ws(":", "volume", "part", "hash").alias("h")
        )
        level = (
            levels[-1]
            .withColumn("up", F.floor(F.col("volume") / FANOUT))
            .groupBy("up")
            .agg(_hash(child))
            .select(
                F.col("up").alias("volume"),
                F.lit(0).cast("long").alias("part"),
                F.lit(0).cast("long").alias("place"),
                "hash",
            )
        )
        levels.append(stage(level))
        if volumes <= 1:
            return levels
        volumes = -(-volumes // FANOUT)


def _hash(child: Column) -> Column:
    ordered = F.transform(F.sort_array(F.collect_list(child)), lambda x: x["h"])
    return F.sha2(F.array_join(ordered, "\n"), 256).alias("hash")


def audit(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Records in which a replica ``found`` differs from ``expected`` (both as from ``archive``).

    Returns page_id, volume, part, offset, kind (changed, missing, extra), expected_sha256,
    found_sha256, expected_length, found_length. Equal replicas give no rows; an empty replica is
    missing all.
    """
    both = expected.select("volume", "offset").unionByName(found.select("volume", "offset"))
    size = both.agg(
        F.max("offset").alias("offset"),
        F.max("volume").alias("high"),
    ).first()
    ranges = (size["offset"] or 0) // RANGE + 1
    # Volume -1 (no id) falls into a group of its own, one more at each level.
    volumes = (size["high"] or 0) + 1
    left, right = (tree(x, ranges, volumes) for x in (expected, found))
    node = ["volume", "part", "place"]
    differ = None
    for depth in range(len(left) - 1, -1, -1):
        a, b = left[depth], right[depth]
        if differ is not None:
            a, b = (_below(x, differ, depth, ranges) for x in (a, b))
        b = b.withColumnRenamed("hash", "other")
        differ = a.join(b, node, "full").filter(~F.col("hash").eqNullSafe(F.col("other")))
        differ = stage(differ.select(*node))
    at = F.floor(F.col("offset") / RANGE)
    a, b = (
        x.withColumn("place", at).join(differ, node, "left_semi").drop("place")
        for x in (expected, found)
    )
    b = b.select(
        "volume",
        "part",
        "offset",
        F.col("page_id").alias("found_id"),
        F.col("length").alias("found_length"),
        F.col("digest").alias("found_sha256"),
    )
    kind = (
        F.when(F.col("found_sha256").isNull(), "missing")
        .when(F.col("digest").isNull(), "extra")
        .otherwise("changed")
    )
    return (
        a.join(b, ["volume", "part", "offset"], "full")
        .filter(~F.col("digest").eqNullSafe(F.col("found_sha256")))
        .select(
            F.coalesce("page_id", "found_id").alias("page_id"),
            "volume",
            "part",
            "offset",
            kind.alias("kind"),
            F.col("digest").alias("expected_sha256"),
            "found_sha256",
            F.col("length").alias("expected_length"),
            "found_length",
        )
    )


def _below(nodes: DataFrame, differ: DataFrame, depth: int, ranges: int) -> DataFrame:
    """The nodes of a level whose parents differ."""
    up = F.floor(F.col("place") / FANOUT)
    spans = 1
    while ranges > 1:
        ranges = -(-ranges // FANOUT)
        spans += 1
    if depth < spans - 1:
        parent = {"volume_": F.col("volume"), "part_": F.col("part"), "place_": up}
    else:
        zero = F.lit(0).cast("long")
        parent = {"volume_": F.floor(F.col("volume") / FANOUT), "part_": zero, "place_": zero}
    above = differ.select(*[F.col(c).alias(f"{c}_") for c in differ.columns])
    return nodes.withColumns(parent).join(above, list(parent), "left_semi").drop(*parent)
