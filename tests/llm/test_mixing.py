from __future__ import annotations

import re
from fractions import Fraction

from cases import documents, texts
from pyspark.sql import functions as F

from corpusloom.llm import mixing


def targets(sizes: dict, weights=(5, 2, 1)):
    """The excess of capped sources is shared again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, done = Fraction(3 * sum(sizes.values()), 2), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return done | {s: weight[s] * level for s in open_}
        for s in over:
            done[s] = Fraction(2 * sizes[s])
            left -= done[s]
        open_ -= over
    return done


def seats(weights: dict, n: int) -> dict:
    got = dict.fromkeys(weights, 0)
    for _ in range(n):
        best = max(sorted(weights), key=lambda u: Fraction(weights[u]) / (2 * got[u] + 1))
        got[best] += 1
    return got


def test_targets_and_quotas(spark):
    docs = documents(spark)
    got = mixing.mix(docs, block=16).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    assert got["size"].tolist() == [size(t) for t in got["text"]]
    sizes = {}
    for s, n in zip(got["source"], got["size"], strict=True):
        sizes[s] = sizes.get(s, 0) + n
    want = targets(sizes)
    for r in got.itertuples():
        assert r.source_size == sizes[r.source]
        assert abs(r.target - float(want[r.source])) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == r.passes * r.size + sum(x["words"] for x in r.ranges)
        assert all(x["first"] >= 0 and x["first"] + x["words"] <= r.size for x in r.ranges)
    for s, n in got.groupby("source", dropna=False)["taken"].sum().items():
        assert abs(n - float(want[None if s != s else s])) <= 32
    again = mixing.mix(docs.repartition(5), block=16).toPandas()
    key = ["doc_id", "taken"]
    assert sorted(again[key].itertuples(index=False)) == sorted(got[key].itertuples(index=False))


def test_highest_quotients(spark):
    for weights, n in (({1: 10.0, 2: 7.0, 3: 5.0, 4: 1.0}, 23), ({1: 1.0, 2: 1.0, 3: 1.0}, 2),
                       ({1: 1000.0, 2: 1.0}, 7), ({1: 3.0, 2: 0.0}, 5), ({i: i + 0.5 for i in range(60)}, 11)):
        units = spark.createDataFrame(list(weights.items()), "u long, w double")
        units = units.withColumns({"g": F.lit(1), "n": F.lit(n)})
        got = mixing.apportion(units, ["g"], [F.col("u")], "w", "n").collect()
        assert {r["u"]: r["quota"] for r in got} == seats(weights, n)


def test_small_sources_get_their_share(spark):
    """Targets of a few words, beside a source of many."""
    rows = [(i, "w " * 50, "a") for i in range(400)]
    rows += [(1000, "one two three four five", "b"), (1001, "w " * 10, "c"), (1002, "w " * 100, "d")]
    rows += [(1003, "one", None), (1004, "", "e"), (1005, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for some in (docs, docs.filter("doc_id >= 1000")):
        got = mixing.mix(some).toPandas()
        assert (got["taken"] <= 2 * got["size"]).all()
        by = got.groupby("source", dropna=False).agg({"taken": "sum", "target": "first"})
        assert (abs(by["taken"] - by["target"]) <= 1 + by["target"] / mixing.LEAST_BLOCKS).all()
        assert (by["taken"][by["target"] > 0] > 0).all()


def test_many_shards_repeats_and_empty_table(spark):
    docs = documents(spark, [t for t in texts()[:60]] * 2, list(range(60)) * 2)
    got = mixing.mix(docs, shard_words=500, block=16).toPandas()
    assert len(got) == 120
    by = got.groupby("source", dropna=False).agg({"taken": "sum", "target": "first"})
    assert (abs(by["taken"] - by["target"]) <= 0.02 * by["target"] + 64).all()
    assert mixing.mix(docs.limit(0)).count() == 0
