from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import pivots, topk
from corpusloom.llm.vectors import usable

SCHEMA = "vec_id long, embedding array<float>, label int, score long, links long, cell int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, 2, 3) for i, v, y in rows], SCHEMA).repartition(3)


def vectors(n=300, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype(np.float32)
    x[n // 3 : n // 2] = x[0] + 0.08 * x[n // 3 : n // 2]  # near one another
    x[n // 2 : n // 2 + 20] = x[1]  # copies
    rows = [(i, [float(c) for c in v], i % 7 % 3) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * dims, [nan] * dims, [1.0, None], [inf, 1.0], rows[1][1], rows[1][1][:5]]
    return rows + [(n + i, v, 1) for i, v in enumerate(odd)] + [(n + 50, rows[1][1], None), (5, rows[5][1], 2)]


def test_top_k_is_exact(spark):
    rows = vectors()
    df = table(spark, rows).filter(usable(F.col("embedding")))
    scaled = df.select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    queries = scaled.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    old = topk.ROWS, topk.QUERIES
    topk.ROWS, topk.QUERIES = 64, 4  # many blocks
    try:
        got = topk.top_k(scaled, queries, 10).collect()
    finally:
        topk.ROWS, topk.QUERIES = old
    good = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v, _ in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for q, v in good:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:10]
            mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
            assert mine == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]


def test_top_k_large_numbers_few_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(i, [(1 << 29) + i, -(1 << 28)]) for i in range(5)], "vec_id long, vector array<bigint>")
    queries = rows.withColumnRenamed("vec_id", "query_id").filter("query_id = 2")
    got = topk.top_k(rows, queries, 10).orderBy("rank").collect()
    want = sorted((-(((1 << 29) + 2) * ((1 << 29) + i) + (1 << 56)), i) for i in range(5) if i != 2)
    assert [(r["score"], r["vec_id"]) for r in got] == [(-s, i) for s, i in want]
    assert topk.top_k(rows.limit(0), queries, 10).count() == 0
    assert topk.top_k(rows, queries.limit(0), 10).count() == 0


def brute(rows):
    good = {}
    for k, (i, v, y) in enumerate(rows):
        if v and y is not None and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            good[k] = (i, x / np.linalg.norm(x), y)
    links = {k: set() for k in range(len(rows))}
    for a, (_, x, y) in good.items():
        for b, (_, w, z) in good.items():
            if a != b and y == z and len(x) == len(w) and x @ w >= 0.93:
                links[a].add(b)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        low = min(rows[s][0] for s in seen)
        out.append((i, len(links[k]), low, i == low))
    return sorted(out)


def test_pivot_links_against_brute_force(spark):
    rows = vectors()
    old = pivots.CHUNK
    pivots.CHUNK = 16  # lists in many chunks
    try:
        got = pivots.near_duplicates(table(spark, rows)).collect()
    finally:
        pivots.CHUNK = old
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got)
    want = brute(rows)
    assert len(got) == len(want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want) > 0
    # A component that lost a link may fall apart, never grow.
    assert all(g[2] >= w[2] for g, w in zip(got, want, strict=True))


def dense(n=1800, dims=64, cosine=0.95, seed=3):
    """A third of the vectors are near one another; half of the others have a near copy."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[: n // 3] = cosine**0.5 * x[0] + (1 - cosine) ** 0.5 * x[: n // 3]
    x[2 * n // 3 :] = x[n // 3 : 2 * n // 3] + 0.3 / dims**0.5 * rng.standard_normal((n // 3, dims))
    return x.astype(np.float32)


def test_links_in_a_dense_group_row_by_row(spark):
    for cosine in (0.92, 0.97):
        x = dense(cosine=cosine)
        rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
        got = pivots.near_duplicates(table(spark, rows)).collect()
        got = dict((r["vec_id"], (r["n_links"], r["component_id"])) for r in got)
        y = x.astype(np.float64)
        y /= np.linalg.norm(y, axis=1)[:, None]
        near = y @ y.T >= 0.93
        low = np.arange(len(x))
        while True:  # the smallest row that links reach
            new = np.where(near, low, len(x)).min(axis=1)
            if (new == low).all():
                break
            low = new
        want = list(zip(near.sum(axis=1) - 1, low))
        third = len(x) // 3
        assert all(got[i] == want[i] for i in range(third))
        assert sum(got[i] == w for i, w in enumerate(want)) >= 0.98 * len(x)


def test_rows_against_brute_force(spark):
    got = pivots.near_duplicates(table(spark, vectors())).collect()
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got)
    want = brute(vectors())
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.9 * len(want)


def test_pivots_are_not_near_one_another():
    x = pivots.unit(dense().astype(np.float64))
    points = pivots.thinned(x, 64)
    cosines = points @ points.T - np.eye(len(points))
    assert len(points) == 64 and cosines.max() < pivots.APART


def test_pivots_empty_table(spark):
    assert pivots.near_duplicates(table(spark, vectors()).limit(0)).count() == 0
    only = pivots.near_duplicates(table(spark, [(3, None, 1), (4, [1.0, 0.0], 1)])).collect()
    assert sorted(tuple(r) for r in only) == [(3, 0, 3, True), (4, 0, 4, True)]
