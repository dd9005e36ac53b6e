"""Retrieval against brute force, with copies, skewed parents and tight budgets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.vectors import hash_vector
from corpusloom.operators import retrieval as r
from corpusloom.operators.answering import NO_SOURCES, answer, answer_prompts, citations, pack_context
from corpusloom.operators.indexing import index_rows, index_stats, upsert_index

SCHEMA = "doc_id long, row_id string, parent_id string, vector array<double>"


@pytest.fixture(scope="module")
def skewed(spark):
    """600 rows: a third are copies of one vector, half of all belong to one parent."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        vector = np.ones(16) if i % 3 == 0 else rng.normal(size=16)
        vector = vector / np.linalg.norm(vector)
        parent = "hot" if i % 2 else f"p{i % 37}"
        rows.append((i % 5, f"r{i:04d}", parent, vector.tolist()))
    queries = [(q, (np.ones(16) if q == 0 else rng.normal(size=16)).tolist()) for q in range(9)]
    index = spark.createDataFrame(rows, SCHEMA).repartition(7).cache()
    return index, spark.createDataFrame(queries, "query_id long, vector array<double>"), rows, queries


def brute(rows, queries, n, by_parent=False):
    found = set()
    for query, q in queries:
        length = np.linalg.norm(q)
        scored = [(-round(float(np.dot(q, v) / length), 6), d, row, p) for d, row, p, v in rows]
        if by_parent:
            best = {}
            for entry in sorted(scored):
                best.setdefault((entry[1], entry[3]), entry)
            scored = list(best.values())
        found |= {(query, d, row, rank) for rank, (_, d, row, _) in enumerate(sorted(scored)[:n], 1)}
    return found


def ids(hits):
    return {(h.query_id, h.doc_id, h.row_id, h["rank"]) for h in hits.collect()}


@pytest.mark.parametrize("n", [1, 4, 25, 1000])
def test_topk_is_brute_force(skewed, n):
    index, queries, rows, asked = skewed
    assert ids(r.knn_topk(index, queries, n)) == brute(rows, asked, n)


@pytest.mark.parametrize("n", [1, 4, 60])
def test_parents_are_collapsed_before_the_limit(skewed, n):
    index, queries, rows, asked = skewed
    scored = r.candidates(index, queries, n, by_parent=True)
    hits = r.rank_hits(r.collapse_by_parent(scored), n)
    assert ids(hits) == brute(rows, asked, n, by_parent=True)


@pytest.mark.parametrize("by_parent", [False, True])
def test_blocks_give_the_same(skewed, monkeypatch, by_parent):
    index, queries, rows, asked = skewed
    monkeypatch.setattr(r, "ROW_BLOCK", 50)
    monkeypatch.setattr(r, "QUERY_BLOCK", 2)
    scored = r.candidates(index, queries, 6, by_parent, query_bytes=1)
    hits = r.rank_hits(r.collapse_by_parent(scored) if by_parent else scored, 6)
    assert ids(hits) == brute(rows, asked, 6, by_parent)


def test_more_queries_than_a_task_keeps_rows_for_are_scanned_for_in_blocks(skewed, monkeypatch):
    index, queries, rows, asked = skewed
    scan, sizes = r._scan, []
    monkeypatch.setattr(r, "KEPT_ROWS", 12)
    monkeypatch.setattr(r, "_blocked", None)  # which copies every row for each block of queries
    monkeypatch.setattr(r, "_scan", lambda a, b, *c: sizes.append(b.num_rows) or scan(a, b, *c))
    assert ids(r.knn_topk(index, queries, 6)) == brute(rows, asked, 6)
    assert sum(sizes) == len(asked) and max(sizes) <= 2


def test_candidates_grow_with_the_cores_and_not_with_the_parts_of_the_index(spark, skewed):
    index, queries, rows, asked = skewed
    found = r.candidates(index.repartition(200), queries, 3)
    assert found.count() <= 2 * spark.sparkContext.defaultParallelism * len(asked) * 3


def test_small_batches_give_the_same(spark, skewed):
    index, queries, rows, asked = skewed
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert ids(r.knn_topk(index, queries, 5)) == brute(rows, asked, 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def ranked_in_process(rows, asked, n, by_parent):
    """(query, doc, row) of what one task returns, in the order of its best."""
    ids = {"doc_id": [x[0] for x in rows], "row_id": [x[1] for x in rows], "parent_id": [x[2] for x in rows]}
    table = pa.table({**ids, "vector": [x[3] for x in rows]})
    ranker = r._Ranker(n, by_parent, pa.int64(), pa.int64())
    matrix = np.array([vector for _, vector in asked])
    found = ranker.run(table.to_batches(max_chunksize=13), [query for query, _ in asked], matrix)
    key = [("query_id", "ascending"), ("similarity", "descending"), ("doc_id", "ascending"), ("row_id", "ascending")]
    hits, counts = set(), {}
    for hit in found.sort_by(key).to_pylist():
        counts[hit["query_id"]] = rank = counts.get(hit["query_id"], 0) + 1
        hits.add((hit["query_id"], hit["doc_id"], hit["row_id"], rank))
    return hits


@pytest.mark.parametrize("by_parent", [False, True])
@pytest.mark.parametrize("n", [1, 3, 40])
@pytest.mark.parametrize("tiles", [(7, 3, 500), (64, 4, 20_000)])
def test_many_slabs_and_tiles_give_the_same(skewed, monkeypatch, n, by_parent, tiles):
    _, _, rows, asked = skewed
    shuffled = [rows[i] for i in np.random.default_rng(3).permutation(len(rows))]
    for name, value in zip(("ROW_TILE", "QUERY_TILE", "SLAB_BYTES"), tiles):
        monkeypatch.setattr(r, name, value)
    monkeypatch.setattr(r, "PAIRS", 50)
    monkeypatch.setattr(r, "CELLS", 100)
    asked = [*asked, (99, [0.0] * 16)]  # to which all rows are equally near
    assert ranked_in_process(shuffled, asked, n, by_parent) == brute_or_zero(rows, asked, n, by_parent)


def brute_or_zero(rows, asked, n, by_parent):
    some = [(query, vector) for query, vector in asked if any(vector)]
    zero = [(query, [1.0]) for query, vector in asked if not any(vector)]
    flat = [(d, row, p, [0.0]) for d, row, p, _ in rows]
    return brute(rows, some, n, by_parent) | brute(flat, zero, n, by_parent)


def test_copies_of_a_vector_are_scored_once(skewed, monkeypatch):
    _, _, rows, asked = skewed
    product, columns = np.matmul, []
    monkeypatch.setattr(r.np, "matmul", lambda a, b, **kw: columns.append(b.shape[1]) or product(a, b, **kw))
    assert ranked_in_process(rows, asked, 4, False) == brute(rows, asked, 4)
    assert sum(columns) == len({tuple(vector) for *_, vector in rows})


def test_blocks_scan_tasks_of_as_many_rows_each(spark, skewed, monkeypatch):
    index, queries, rows, asked = skewed
    scan, sizes = r._scan, []

    def watched(rows_, *rest):
        parts = rows_.coalesce(spark.sparkContext.defaultParallelism).groupBy(F.spark_partition_id()).count()
        sizes.append([row["count"] for row in parts.collect()])
        return scan(rows_, *rest)

    monkeypatch.setattr(r, "KEPT_ROWS", 12)
    monkeypatch.setattr(r, "_scan", watched)
    heavy = index.withColumn("part", F.when(F.col("doc_id") < 4, 0).otherwise(F.col("doc_id") + F.hash("row_id")))
    uneven = heavy.repartition(40, "part").drop("part")
    assert ids(r.knn_topk(uneven, queries, 6)) == brute(rows, asked, 6)
    cores = spark.sparkContext.defaultParallelism
    assert all(len(found) == cores and max(found) <= 2 * len(rows) / cores for found in sizes)


def test_all_cells_make_the_approximate_search_exact(skewed):
    index, queries, rows, asked = skewed
    found = r.search_ann(index, queries, 5, bits=1)
    assert ids(found) == brute(rows, asked, 5)
    some = r.search_ann(index, queries, 5, bits=6)
    recall = r.recall_at_k(some, r.knn_topk(index, queries, 5)).collect()
    assert all(0 <= row.recall <= 1 and row.expected == 5 for row in recall)


def chunk_table(spark):
    chunks = spark.createDataFrame(
        [(1, i, f"c{i}", "S" if i else "", f"sun moon text {i}") for i in range(4)],
        "doc_id long, chunk_index int, chunk_id string, section string, text string",
    )
    questions = spark.createDataFrame(
        [(1, "c0", ["sun moon", "sun moon sun", "moon sun moon", "sun", "moon"])],
        "doc_id long, chunk_id string, questions array<string>",
    )
    rows = index_rows(chunks, questions).withColumn("vector", hash_vector(F.col("document")))
    return rows.cache()


def queries_of(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    return r.valid_queries(rows).withColumn("vector", hash_vector(F.col("query")))


def test_question_rows_point_at_their_chunk(spark):
    rows = chunk_table(spark)
    assert rows.count() == 9
    assert {(x.type, x.rows) for x in index_stats(rows).collect()} == {("chunk", 4), ("question", 5)}
    asked = rows.filter("type = 'question'").collect()
    assert {x.row_id for x in asked} == {f"c0-q{i}" for i in range(5)}
    assert {(x.parent_id, x.chunk_index) for x in asked} == {("c0", 0)}


def test_questions_can_use_up_what_is_fetched(spark):
    rows, asked = chunk_table(spark), queries_of(spark, "sun moon", "  ")
    assert r.search(rows, asked, 2).count() == 1  # all six rows fetched are of one chunk
    assert r.search_exact(rows, asked, 2).count() == 2
    plain = r.search(rows, asked, 3).orderBy("rank").collect()
    assert [(h["rank"], h.chunk_id) for h in plain] == [(1, "c0"), (2, "c1"), (3, "c2")]
    best = plain[0]
    assert best.match_type == "question" and best.matched_text == "sun moon"
    assert best.text == "sun moon text 0" and best.similarity == 1.0
    assert plain[1].match_type == "chunk" and plain[1].matched_text == ""
    assert r.search(rows, asked, 3, dedupe=False).count() == 3


def test_lost_parent_leaves_the_question_text(spark):
    rows = chunk_table(spark).filter("row_id <> 'c0'")
    assert r.search(rows, queries_of(spark, "sun moon"), 1).head().text == "sun moon"


def test_each_query_may_have_its_own_k(spark):
    rows = chunk_table(spark)
    asked = queries_of(spark, "sun moon", "moon text", "text").withColumn("top_k", F.col("query_id").cast("int"))
    found = r.search_per_query(rows, asked, default_k=3).groupBy("query_id").count().collect()
    assert {x.query_id: x["count"] for x in found} == {0: 3, 1: 1, 2: 2}


def test_upsert_is_idempotent(spark):
    rows = chunk_table(spark)
    once = upsert_index(rows.limit(0), rows)
    assert upsert_index(once, rows).count() == rows.count()
    changed = rows.filter("row_id = 'c1'").withColumn("row_id", F.lit("c1-new"))
    assert upsert_index(rows, changed).count() == 10
    assert upsert_index(rows, changed, replace_docs=True).count() == 1


def hits_of(spark, *lengths):
    return spark.createDataFrame(
        [(7, i, 1, f"c{i}", "x" * n, "S" if i % 2 else "") for i, n in enumerate(lengths, 1)],
        "query_id long, rank int, doc_id long, chunk_id string, text string, section string",
    )


@pytest.mark.parametrize(
    "lengths,used", [((5, 5), [5, 5]), ((10, 5), [10]), ((6, 9, 3), [6, 4]), ((0, 12), [0, 10])]
)
def test_context_stops_at_its_budget(spark, lengths, used):
    packed = pack_context(hits_of(spark, *lengths), 10).orderBy("rank").collect()
    assert [p.used for p in packed] == used
    assert packed[0].block.startswith("[1] (S)\nx" if lengths[0] else "[1] (S)\n")
    assert len(packed) < 2 or packed[1].block.startswith("[2] (document)\n")


def test_answers_and_citations(spark):
    hits = hits_of(spark, 3, 4)
    asked = spark.createDataFrame([(7, "why?"), (8, "how?")], "query_id long, query string")
    prompts = answer_prompts(asked, pack_context(hits))
    answers = answer(prompts, lambda texts: ["see [2], [5] and [2]" for _ in texts]).cache()
    assert {a.query_id: a.answer for a in answers.collect()} == {7: "see [2], [5] and [2]", 8: NO_SOURCES}
    prompt = {p.query_id: p.prompt for p in prompts.collect()}
    assert prompt[8] is None and "Question: why?" in prompt[7] and "[1] (S)\nxxx\n\n[2]" in prompt[7]
    found = {(c.cited, c.chunk_id, c.valid) for c in citations(answers, hits).collect()}
    assert found == {(2, "c2", True), (5, None, False)}
    offline = {a.query_id: a.answer for a in answer(prompts).collect()}
    assert offline[7].startswith("No model") and offline[8] == NO_SOURCES


def test_a_scan_has_at_most_one_task_for_each_core(spark):
    rows = spark.range(200).selectExpr(
        "id AS doc_id", "concat('r', id) AS row_id", "concat('r', id) AS parent_id",
        "array(cast(id AS DOUBLE), 1D) AS vector", "id AS query_id",
    ).repartition(40)
    found = r.candidates(rows, rows.select("query_id", "vector"), 3)
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
