"""Global row numbers in the order of columns, by one range shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.tables import column_like, stage

#: ``monotonically_increasing_id`` counts rows of a partition in its lower 33 bits.
_WITHIN = 33


def row_numbers(df: DataFrame, order: list[str], name: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``name``: 0, 1, 2, … in ascending order of ``order``.

    Nulls come first. Rows that are equal in ``order`` follow one another in any order. Rows are dealt
    by ranges of the order and of a tie-breaker of their own, so neither a value that a third of all
    rows hold nor repeated rows meet in one task. A task knows its rows' places within it; what
    lies before it is a sum over tasks, one row each. An empty table stays empty.
    """
    tie, at, part, before = (column_like(c, df.columns) for c in ("_tie", "_at", "_part", "_before"))
    kept = df.columns if keep is None else keep
    placed = stage(
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(*[F.col(c).asc_nulls_first() for c in order], tie)
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order], tie)
        .select(*kept, F.monotonically_increasing_id().alias(at))
    ).withColumn(part, F.shiftright(at, _WITHIN))
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, 0))
    # As many rows as tasks wrote the stage.
    offsets = F.broadcast(sizes.select(part, (so_far - F.col("n")).alias(before)))
    within = F.col(at).bitwiseAND((1 << _WITHIN) - 1)
    return placed.join(offsets, part).select(*kept, (F.col(before) + within).alias(name))
