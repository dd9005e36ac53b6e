"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Sources get targets (by weight, none above ``most`` times its size, the excess shared by weight
again). The sum of targets, cut into blocks of equal length, of which the smallest target holds some
(so no source is too small for one), is dealt to sources by the highest
quotients weight / (2 seats + 1); a source's blocks are dealt to its shards the same way. A shard's
documents stand in an order given by the seed; as many passes over all its blocks as the quota
holds are taken whole, and the rest is one cyclic run of blocks that starts at a seeded place. So
nearly all documents are taken whole or not at all in each pass.

Everything is column functions. Only ids and sizes move, unless ``keep`` names columns to carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.tables import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Blocks that the smallest target holds at least, down to blocks of one word.
LEAST_BLOCKS = 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_number(digest: Column) -> Column:
    """The first eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def apportion(units: DataFrame, by: list[str], order: list[Column], weight: str, seats: str):
    """Adds ``quota``: Sainte-Laguë shares of the ``seats`` of a group ``by`` by ``weight``.

    The M-th highest quotient lies between sum / (M + k / 2) and sum / (M - k / 2) for k units, so
    all but about two seats a unit are settled by a division; the others are ranked by quotient
    (ties by ``order``). Nothing depends on the number of seats. Null or zero weights get none.
    """
    group = W.partitionBy(*by)
    total, k = F.sum(weight).over(group), F.count("*").over(group)
    share = lambda m: F.coalesce(F.col(weight) * m / total, F.lit(0.0))
    known = units.withColumns(
        {
            "sure": F.greatest(F.floor(share(F.col(seats) - k / 2) + 0.5) - 1, F.lit(0)),
            "most": F.greatest(F.floor(share(F.col(seats) + k / 2) + 0.5) + 1, F.lit(1)),
        }
    ).withColumn("left", F.col(seats) - F.sum("sure").over(group))
    tried = known.select(
        "*", F.explode(F.sequence(F.col("sure"), F.col("most"))).alias("had")
    ).withColumn("quotient", F.coalesce(F.col(weight), F.lit(0.0)) / (2 * F.col("had") + 1))
    rank = F.row_number().over(group.orderBy(F.desc("quotient"), *order, "had"))
    keys = units.columns
    return (
        tried.withColumn("won", (rank <= F.col("left")) & (F.col("quotient") > 0))
        .groupBy(*keys, "sure")
        .agg(F.sum(F.col("won").cast("long")).alias("won"))
        .select(*keys, (F.col("sure") + F.col("won")).alias("quota"))
    )


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2
) -> DataFrame:
    """Adds ``target`` to (source, source_size): ``share`` of all sizes by weight, capped.

    Sources in code point order, null last, take ``weights`` in turn. With caps sorted by cap /
    weight, the level at which the rest is shared is the first that does not reach its own cap.
    A row is a source, so the windows here hold one row for each source.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumns(
        {
            "weight": F.get(F.array(*map(F.lit, weights)), turn % len(weights)),
            "cap": most * F.col("source_size"),
        }
    ).withColumn("ratio", F.col("cap") / F.col("weight"))
    ordered = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    return (
        weighed.withColumns(
            {
                "full": F.coalesce(F.sum("cap").over(before), F.lit(0)),
                "light": F.coalesce(F.sum("weight").over(before), F.lit(0)),
                "asked": share * F.sum("source_size").over(whole),
                "heavy": F.sum("weight").over(whole),
            }
        )
        .withColumn("level", (F.col("asked") - F.col("full")) / (F.col("heavy") - F.col("light")))
        .withColumn(
            "level",
            F.min_by(
                F.when(F.col("level") <= F.col("ratio"), F.col("level")),
                F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "light")),
            ).over(whole),
        )
        .select(
            "source",
            "source_size",
            F.least(
                F.col("cap").cast("double"),
                F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double")),
            ).alias("target"),
        )
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    block: int = 64,
    shard_words: int = 1 << 20,
    seed: int = 17,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The mix of ``docs`` (doc_id, text, source).

    Returns doc_id, source, size, source_size, target, taken, passes (over the whole document) and
    ranges (of words, from 0, taken once more), and ``row`` (a struct of the columns in ``keep``).

    A null text has size 0; documents of size 0 take nothing and stay. A null source is a source.
    Repeated rows are documents of their own; rows that are equal in doc_id, source and size may
    change places. An empty table gives an empty result. Other columns are ignored. Hot sources are
    cut into shards of about ``shard_words`` words, and documents without words are never gathered.
    Blocks have ``block`` words, or fewer if the smallest positive target would hold fewer than
    ``LEAST_BLOCKS`` of them; all sources have blocks of the same length.
    """
    row = F.struct(*keep) if keep else F.lit(None).cast("string")
    sized = stage(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row.alias("row"))
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).withColumn("one", F.lit(1))
    all_sources = W.partitionBy("one")
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(all_sources)
    fine = F.floor(F.coalesce(smallest, F.lit(float(block))) / LEAST_BLOCKS)
    targets = stage(
        apportion(
            targets.withColumn("block", F.greatest(F.least(F.lit(block), fine), F.lit(1))).withColumn(
                "blocks", F.round(F.sum("target").over(all_sources) / F.col("block"))
            ),
            ["one"],
            [F.col("source").asc_nulls_last()],
            "target",
            "blocks",
        ).withColumn(
            "n_shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
        )
    )
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id")).cast("binary"))
    same = sized["source"].eqNullSafe(targets["source"])
    placed = (
        sized.join(targets, same)
        .select(
            *[sized[c] for c in sized.columns],
            "source_size",
            "target",
            "n_shards",
            "quota",
            "block",
            digest.alias("digest"),
        )
        .withColumn("shard", hex_number(F.col("digest")) % F.col("n_shards"))
    )
    full = placed.filter("size > 0")
    shards = (
        full.groupBy("source", "shard")
        .agg(
            F.sum("size").alias("shard_size"),
            F.max("quota").alias("source_quota"),
            F.max("block").alias("block"),
        )
        .withColumn("weight", F.col("shard_size").cast("double"))
    )
    shards = apportion(shards, ["source"], [F.col("shard")], "weight", "source_quota").select(
        F.col("source").alias("of"),
        F.col("shard").alias("part"),
        "shard_size",
        F.greatest(F.round(F.col("weight") / F.col("block")), F.lit(1)).cast("long").alias("n"),
        F.col("quota").cast("long").alias("q"),
    )
    start = F.md5(F.concat_ws(":", F.lit(seed), "of", "part").cast("binary"))
    shards = (
        shards.withColumn("q", F.least("q", most * F.col("n")))
        .withColumns({"first": hex_number(start) % F.col("n"), "rest": F.col("q") % F.col("n")})
        .withColumns(
            {
                "passes": F.expr("q div n"),
                "run_from": F.expr("first * shard_size div n"),
                "run_to": F.expr("least(first + rest, n) * shard_size div n"),
                "wrap_to": F.expr("greatest(first + rest - n, 0) * shard_size div n"),
            }
        )
    )
    here = W.partitionBy("source", "shard").orderBy(
        F.substring("digest", 9, 24), "doc_id", "size"
    )
    laid = full.withColumn(
        "begin", F.sum("size").over(here.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    ).join(shards, full["source"].eqNullSafe(F.col("of")) & (F.col("shard") == F.col("part")))
    ranges = F.expr(
        """filter(array(
            struct(greatest(run_from - begin, 0) AS first,
                   least(run_to - begin, size) - greatest(run_from - begin, 0) AS words),
            struct(0L AS first, least(wrap_to - begin, size) AS words)), x -> x.words > 0)"""
    )
    taken = F.expr("passes * size + aggregate(ranges, 0L, (a, x) -> a + x.words)")
    result = ["doc_id", "source", "size", "source_size", "target"]
    chosen = laid.withColumn("ranges", ranges).select(
        *[full[c] for c in result], taken.alias("taken"), "passes", "ranges", full["row"]
    )
    none = placed.filter("size = 0").select(
        *result,
        F.lit(0).cast("long").alias("taken"),
        F.lit(0).cast("long").alias("passes"),
        F.expr("filter(array(struct(0L AS first, 0L AS words)), x -> x.words > 0)").alias("ranges"),
        "row",
    )
    return chosen.unionByName(none)
