from __future__ import annotations

import hashlib
from math import isqrt

import pytest
from cases import documents
from pyspark.sql import functions as F

from corpusloom.llm import sharding
from corpusloom.llm.numbering import row_numbers


def slow_place(x: int, n: int, seed: int) -> int:
    """The permutation, number by number."""
    left = isqrt(max(n - 1, 0)) + 1
    right = -(-n // left) or 1
    while True:
        pair = [x // right, x % right]
        for turn in range(2 * sharding.ROUNDS):
            own = turn % 2
            text = f"{seed}:{turn}:{pair[1 - own]}"
            digest = int(hashlib.md5(text.encode()).hexdigest()[:13], 16)
            pair[own] = (pair[own] + digest) % (left, right)[own]
        x = pair[0] * right + pair[1]
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 50, 257, 1000])
def test_permutation_equals_brute_force_and_its_inverse_undoes_it(spark, n):
    p = sharding.Permutation.of(spark, n, 5)
    rows = spark.range(n).withColumn("place", p.place(F.col("id")))
    got = dict(rows.withColumn("again", p.number(F.col("place"))).select("id", "place").collect())
    assert got == {i: slow_place(i, n, 5) for i in range(n)}
    assert sorted(got.values()) == list(range(n))
    back = rows.filter(p.number(F.col("place")) != F.col("id"))
    assert back.count() == 0


def test_numbers_beyond_doubles_are_exact(spark):
    n = (1 << 61) + 12345
    p = sharding.Permutation(n, 3, 4)
    row = spark.range(n - 1, n).select(p.place(F.col("id")).alias("p")).first()
    assert row["p"] == slow_place(n - 1, n, 3)
    back = spark.range(1).select(p.number(F.lit(row["p"])).alias("i")).first()
    assert back["i"] == n - 1


def test_shards_of_odd_rows(spark):
    docs = documents(spark).select("doc_id", "text", F.lit(9).alias("shard"), F.lit("s").alias("slot"))
    docs = docs.unionByName(docs.limit(20)).unionByName(docs.withColumn("doc_id", F.lit(None)).limit(5))
    placed, p = sharding.shard_rows(docs, ["doc_id", "text"], 3)
    got = placed.toPandas()
    assert len(got) == docs.count() == p.n
    assert set(got["_shard"]) == {9} and set(got["_slot"]) == {"s"}
    assert sorted(got["row_number"]) == list(range(len(got)))
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    for _, slots in got.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    order = got.sort_values("row_number")["doc_id"].tolist()
    assert all(x != x for x in order[:5])  # null ids come first
    assert order[5:] == sorted(order[5:])
    where = placed.withColumn("n", sharding.row_at(p, F.col("shard"), F.col("slot"), 3))
    assert where.filter("n <> row_number").count() == 0
    again, _ = sharding.shard_rows(docs.repartition(7), ["doc_id", "text"], 3)
    key = ["doc_id", "text", "shard", "slot"]
    assert sorted(again.select(key).toPandas().astype(str).values.tolist()) == sorted(
        got[key].astype(str).values.tolist()
    )
    other, _ = sharding.shard_rows(docs, ["doc_id", "text"], 3, seed=99)
    assert other.select("row_number", "slot").exceptAll(placed.select("row_number", "slot")).count() > 0


def test_empty_table_and_one_row(spark):
    docs = documents(spark).select("doc_id")
    assert sharding.shard_rows(docs.limit(0), ["doc_id"])[0].count() == 0
    one = sharding.shard_rows(docs.limit(1), ["doc_id"])[0].collect()
    assert [(r["row_number"], r["shard"], r["slot"]) for r in one] == [(0, 0, 0)]


def test_rows_of_one_value_spread_over_tasks(spark):
    same = spark.range(0, 4000, 1, 8).select(F.lit(1).alias("v"))
    numbered = row_numbers(same, ["v"], "n")
    assert sorted(r["n"] for r in numbered.collect()) == list(range(4000))


def test_written_shards_are_in_order(spark, tmp_path):
    placed, _ = sharding.shard_rows(documents(spark).select("doc_id", "text"), ["doc_id"], 2)
    sharding.write_shards(placed, f"{tmp_path}/out")
    for shard in (0, 1):
        files = spark.read.parquet(f"{tmp_path}/out/shard={shard}").coalesce(1)
        slots = [r["slot"] for r in files.sort("slot").collect()]
        assert slots == list(range(len(slots)))
