"""Sharding by a Feistel permutation of global row numbers (column functions only).

A row's number is its place in the order of given columns. The permutation scatters the numbers
0 … n - 1 over themselves: a number is a pair (left, right) of digits in a grid of about sqrt(n)
by sqrt(n), and every round adds a digest of one digit to the other. The grid has at most sqrt(n) places too many; a number
that lands there is permuted again until it is below n (cycle walking). Shard and slot are remainder and
quotient of the result, so shards differ by one row at most, slots have no gaps, and both directions
are arithmetic: no table is needed to know where a row is, or which row stands at a place.
A new seed gives another shuffle of the same row numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.numbering import row_numbers
from corpusloom.llm.tables import column_like, stage

ROUNDS = 4
SEED = 17


def _digest(seed: int, turn: Column, digit: Column) -> Column:
    """13 hexadecimal digits of an MD5 as a number, the same on every engine."""
    text = F.concat_ws(":", F.lit(seed), turn, digit).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 … n - 1; ``walks`` is how often a number outside must be permuted."""

    n: int
    seed: int = SEED
    walks: int = 0

    @classmethod
    def of(cls, spark: SparkSession, n: int, seed: int = SEED) -> "Permutation":
        """With as many walks as any number can need.

        A job over the places outside (at most sqrt(n)) walks them, twice as far each time, until as many are
        left outside as before: these only lead to one another, and no number leads to them.
        """
        found, before = cls(n, seed, 0), None
        outside = spark.range(n, found.left * found.right)
        while True:
            stays = [
                F.count_if(found._walked(F.col("id"), once) >= n)
                for once in (found._forth, found._back)
            ]
            now = outside.agg(*stays).first()
            if now == before or not any(now):
                return found
            found, before = cls(n, seed, 2 * found.walks or 1), now

    @property
    def left(self) -> int:
        return isqrt(max(self.n - 1, 0)) + 1

    @property
    def right(self) -> int:
        return -(-self.n // self.left) or 1

    def _rounds(self, number: Column, turns: range, sign: int) -> Column:
        """Every turn adds to one digit what a digest of the other gives (or takes it away again)."""

        def turn(s: Column, t: Column) -> Column:
            own = t % 2 == 0  # whether it is the left digit that changes
            by = sign * _digest(self.seed, t, F.when(own, s["r"]).otherwise(s["l"]))
            return F.struct(
                F.when(own, F.pmod(s["l"] + by, F.lit(self.left))).otherwise(s["l"]).alias("l"),
                F.when(own, s["r"]).otherwise(F.pmod(s["r"] + by, F.lit(self.right))).alias("r"),
            )

        digits = F.struct(
            F.call_function("div", number, F.lit(self.right)).alias("l"),
            (number % self.right).cast("long").alias("r"),
        )
        done = F.aggregate(F.array(*map(F.lit, turns)), digits, turn)
        return done["l"] * F.lit(self.right).cast("long") + done["r"]

    def _forth(self, number: Column) -> Column:
        return self._rounds(number, range(2 * ROUNDS), 1)

    def _back(self, number: Column) -> Column:
        return self._rounds(number, range(2 * ROUNDS)[::-1], -1)

    def _walked(self, number: Column, once) -> Column:
        if not self.walks:
            return number
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(self.walks)),
            number,
            lambda x, _: F.when(x < self.n, x).otherwise(once(x)),
        )

    def place(self, number: Column) -> Column:
        """Where the row of a number stands in the shuffle."""
        return self._walked(self._forth(number), self._forth)

    def number(self, place: Column) -> Column:
        """The inverse: which row stands at a place."""
        return self._walked(self._back(place), self._back)


def shard_rows(
    rows: DataFrame,
    order: list[str],
    shards: int = 8,
    seed: int = SEED,
) -> tuple[DataFrame, Permutation]:
    """``rows`` with row_number (from 0, in ascending ``order``), shard and slot, and the permutation.

    Every row is a row of its own: repeated rows take successive numbers, null values come first,
    and rows that are equal in ``order`` may change places on a rerun if other columns tell them
    apart. Shards hold as many rows as one another, give or take one; slots count from 0 without a gap. A
    column that is called like a result keeps its values under the name with an underscore before it.
    An empty table stays empty. Values of ``rows`` all move once; pass ids alone to place them without
    their texts.
    """
    results = ["row_number", "shard", "slot"]
    taken = [*rows.columns, *results]
    given = {c: column_like(c, taken) for c in rows.columns if c.lower() in results}
    rows = stage(rows.withColumnsRenamed(given))
    numbered = row_numbers(rows, [given.get(c, c) for c in order], "row_number")
    permutation = Permutation.of(rows.sparkSession, rows.count(), seed)
    place = permutation.place(F.col("row_number"))
    placed = numbered.withColumn(column_like("place", taken), place)
    place = F.col(placed.columns[-1])
    return (
        placed.select(
            *numbered.columns,
            (place % shards).cast("int").alias("shard"),
            F.call_function("div", place, F.lit(shards)).alias("slot"),
        ),
        permutation,
    )


def row_at(permutation: Permutation, shard: Column, slot: Column, shards: int = 8) -> Column:
    """The number of the row in a slot of a shard."""
    return permutation.number(slot.cast("long") * shards + shard)


def write_shards(placed: DataFrame, path: str) -> None:
    """A folder for each shard, its files and rows in the order of slots."""
    (
        placed.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
