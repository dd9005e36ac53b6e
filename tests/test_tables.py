"""Index tables on storage, builds, the stream of pages, exports and reports."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import costs
from corpusloom.operators.diagnostics import (
    chunk_flags,
    chunk_report,
    filter_chunks,
    flag_counts,
    flagged_chunks,
    report_summary,
    write_dump,
)
from corpusloom.operators.reviews import (
    export_reviews,
    latest_reviews,
    question_set,
    review_by_question,
    review_precision,
)
from corpusloom.packaging import ship
from corpusloom.plans.build import build, build_rows, chunk_corpus, search_index
from corpusloom.registry import base
from corpusloom.settings import Settings
from corpusloom.sources import tables
from corpusloom.sources.tables import (
    index_count,
    list_indexes,
    read_index,
    reset_index,
    upsert_table,
)
from corpusloom.streaming.ingest import ingest, read_pages

SMALL = Settings(chunk_size=200, chunk_overlap=30, min_chunk_chars=20, enable_questions=False)


def docs(spark, n=12, extra=""):
    rows = [
        (i, f"# Book\n\n## Plant {i}\n\nplant number{i} likes sun and sand{extra}\n\n### More\n\nwater it weekly")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "doc_id long, markdown string")


def test_build_skips_forces_and_searches(spark, tmp_path):
    path = f"{tmp_path}/index"
    ask = lambda prompts: ["Which plant?\nHow often?" for _ in prompts]
    with_questions = SMALL.with_(enable_questions=True, questions_per_chunk=2)
    first = build(spark, docs(spark), path, SMALL).head()
    assert (first.chunks, first.questions, first.rows_indexed, first.skipped) == (24, 0, 24, False)
    again = build(spark, docs(spark, 3), path, SMALL).head()
    assert again.skipped and again.rows_indexed == 24
    assert again.summary == f"'{SMALL.config_key}' already indexed (24 rows)."
    asked = build(spark, docs(spark), path, with_questions, ask=ask).head()
    assert (asked.chunks, asked.questions, asked.rows_indexed) == (24, 48, 72)
    forced = build(spark, docs(spark, 3), path, SMALL, force=True).head()
    assert forced.rows_indexed == 6
    found = {r.config_key: r.rows for r in list_indexes(spark, path).collect()}
    assert found == {SMALL.config_key: 6, with_questions.config_key: 72}

    queries = spark.createDataFrame([(1, "plant number2 sand"), (2, " ")], "query_id long, query string")
    found = search_index(spark, path, queries, SMALL.with_(top_k=2, index_buckets=5))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    hits = found.orderBy("rank").collect()
    assert hits[0].doc_id == 2 and hits[0].section == "Plant 2" and len(hits) == 2
    exact = search_index(spark, path, queries, with_questions.with_(top_k=30), exact=True)
    assert exact.count() == 24

    reset_index(spark, path, SMALL.config_key)
    assert index_count(spark, path, SMALL.config_key) == 0
    assert index_count(spark, path, with_questions.config_key) == 72


def test_a_rebuild_keeps_old_rows_until_new_ones_are_there(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/index"
    build(spark, docs(spark), path, SMALL)

    def fail(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as stopped:
        stopped.setattr(tables, "write_index", fail)
        with pytest.raises(RuntimeError):
            build(spark, docs(spark, 3), path, SMALL, force=True)
    assert index_count(spark, path, SMALL.config_key) == 24
    build(spark, docs(spark, 3), path, SMALL, force=True)
    left = read_index(spark, path, SMALL.config_key)
    assert left.count() == 6 and {r.doc_id for r in left.collect()} == {0, 1, 2}


def test_upsert_touches_only_what_comes(spark, tmp_path):
    path = f"{tmp_path}/index"
    rows = lambda *a: build_rows(chunk_corpus(docs(spark, *a), SMALL), SMALL)
    assert read_index(spark, path) is None
    assert upsert_table(spark, rows(), path) == 24
    assert upsert_table(spark, rows(), path) == 24
    assert index_count(spark, path, SMALL.config_key) == 24
    before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    upsert_table(spark, rows(1, ", indeed"), path)
    assert index_count(spark, path, SMALL.config_key) == 25  # the edited chunk has a new id
    kept = [p for p, at in before.items() if p.exists() and p.stat().st_mtime_ns == at]
    assert len(kept) > len(before) / 2
    upsert_table(spark, rows(1, ", indeed"), path, replace_docs=True)
    assert index_count(spark, path, SMALL.config_key) == 24


def test_stream_of_pages_is_built_once_however_often_it_comes(spark, tmp_path):
    def page(i, word):
        body = f"<h2>Plant {i}</h2><p>{word} " + "likes sun and sand. " * 60 + "</p>"
        return (i, f"http://g.example/{i}", f"<html><body>{body}</body></html>")

    def arrive(*rows):
        new = spark.createDataFrame(list(rows), "page_id long, url string, html string")
        new.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        query = ingest(read_pages(spark, f"{tmp_path}/in"), f"{tmp_path}/ix", f"{tmp_path}/cp", SMALL)
        query.awaitTermination()
        return read_index(spark, f"{tmp_path}/ix", SMALL.config_key)

    arrive(page(1, "rose"), page(2, "fern"))
    first = run().count()
    arrive(page(2, "fern"))
    assert run().count() == first
    arrive(page(2, "moss"), page(3, "ivy"))
    table = run()
    assert table.filter("document LIKE '%fern%'").count() == 0
    assert {r.doc_id for r in table.select("doc_id").distinct().collect()} == {1, 2, 3}
    arrive(page(1, "oak"))
    arrive(page(1, "elm"), (3, "http://g.example/3", "<p>short</p>"))
    table = run()
    assert table.filter("document LIKE '%oak%' OR document LIKE '%rose%'").count() == 0
    assert table.filter("document LIKE '%elm%'").count() > 0
    assert {r.doc_id for r in table.select("doc_id").distinct().collect()} == {1, 2}


def test_bucket_number_stays(spark, tmp_path):
    path = f"{tmp_path}/index"
    rows = build_rows(chunk_corpus(docs(spark), SMALL), SMALL)
    upsert_table(spark, rows, path, buckets=4)
    upsert_table(spark, rows, path, buckets=9)
    assert index_count(spark, path, SMALL.config_key) == 24
    assert read_index(spark, path).select("bucket").distinct().count() <= 4


def chunks(spark, *texts):
    rows = [(1, i, f"c{i}", "s" if i else "", t, len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id long, chunk_index int, chunk_id string, section string, text string, size int"
    )


def test_flags_and_reports(spark, tmp_path):
    links = "[a](1) [b](2) [c](3) [d](4) [e](5)"
    flagged = chunk_flags(
        chunks(spark, "x" * 200, "short", links, "fine enough text here", "| 1 | 2 | 3 | 4 | 5 |", "12"),
        100, 20,
    ).cache()
    found = {r.chunk_index: r.flags for r in flagged.collect()}
    assert found == {
        0: ["OVERSIZED"], 1: ["TINY"], 2: ["LINK-HEAVY"], 3: [], 4: ["TABLE", "NO-PROSE"],
        5: ["TINY", "NO-PROSE"],
    }
    counts = flag_counts(flagged).head()
    assert (counts.oversized, counts.tiny, counts.no_prose) == (1, 2, 2)
    report = chunk_report(flagged).head()
    assert (report.total, report.min_chars, report.median_chars, report.sections) == (6, 2, 21.0, 2)
    assert chunk_report(flagged.limit(0)).head().asDict() == {
        "total": 0, "min_chars": 0, "median_chars": 0.0, "max_chars": 0, "total_chars": 0,
        "sections": 0,
    }
    assert [r.chunk_index for r in flagged_chunks(flagged, 2).collect()] == [0, 1]
    assert filter_chunks(flagged, "ENOUGH").count() == 1
    assert filter_chunks(flagged, "enough", only_flagged=True).count() == 0
    assert report_summary(flagged).head().summary.startswith("6 chunks across 2 sections | min 2")
    write_dump(flagged, f"{tmp_path}/dump")
    dump = "".join(p.read_text() for p in sorted((tmp_path / "dump").glob("part-*")))
    assert "[   0]  200 chars  OVERSIZED\nsection: -\n" in dump and "  ok\nsection: s" in dump


@pytest.mark.parametrize("rows,estimate,exact", [(288, 18, 20), (1152, 72, 81), (0, 0, 0)])
def test_build_calls(spark, rows, estimate, exact):
    row = spark.createDataFrame([(rows,)], "n long").select(
        costs.build_calls(F.col("n"), 0).alias("e"), costs.build_calls_exact(F.col("n")).alias("x")
    )
    assert tuple(row.head()) == (estimate, exact)


def test_build_minutes(spark):
    rows = spark.createDataFrame([(288, 3), (288, 0)], "chunks long, questions_per_chunk int")
    full, bare = costs.build_minutes(costs.build_cost(rows), 20).collect()
    assert (full.calls, full.rows, full.minutes) == (360, 1152, 18.0)
    assert (bare.calls, bare.questions) == (18, 0)


def test_reviews(spark, tmp_path):
    def row(seq, question, chunk, verdict, similarity, rank):
        return (seq, question, chunk, verdict, "n", "s", similarity, "chunk", rank)

    rows = [
        row(1, "a", "c1", "relevant", 0.5, 1), row(2, "a", "c1", "not relevant", 0.5, 1),
        row(3, "a", "c2", "relevant", 0.25, 2), row(4, "b", "c1", "relevant", 0.1, 3),
        row(5, "b", "c1", "unjudged", 0.1, 3), row(6, "c", "c9", "not relevant", 0.3, 1),
    ]
    judged = latest_reviews(
        spark.createDataFrame(
            rows,
            "seq long, question string, chunk_id string, verdict string, note string, "
            "section string, similarity double, match_type string, rank int",
        )
    ).cache()
    assert tuple(review_precision(judged).head()) == (3, 1, 0.333333)
    found = {r.question: tuple(r)[1:] for r in review_by_question(judged).collect()}
    assert found == {"a": (2, 1, 2, 0.375), "c": (1, 0, None, 0.3)}
    empty = review_precision(judged.limit(0)).head()
    assert (empty.judged, empty.relevant, empty.precision) == (0, 0, None)
    export_reviews(judged, f"{tmp_path}/reviews")
    lines = "".join(p.read_text() for p in (tmp_path / "reviews").glob("part-*")).splitlines()
    assert sorted(json.loads(line)["chunk_id"] for line in lines) == ["c1", "c2", "c9"]


def test_question_set_keeps_first_places(spark):
    rows = spark.createDataFrame([(1, " q "), (2, "p"), (3, "q"), (4, "  ")], "seq long, question string")
    found = {r.question: r.first_seen for r in question_set(rows).collect()}
    assert found == {"q": 1, "p": 2}


def test_batches_of_long_texts_are_cut_by_their_bytes(spark):
    """Registered queries work on whole texts, and 10,000 of them may be much more than a worker should hold."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    ship(spark)
    texts = spark.range(0, 200, 1, 1).selectExpr("repeat('word ', 20000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"mb": [batch.nbytes >> 20]})

    assert max(row.mb for row in texts.mapInArrow(sizes, "mb long").collect()) <= 8


def test_many_given_rows_are_dealt_to_more_tasks_than_cores(spark, monkeypatch):
    monkeypatch.setattr(base, "TASK_ROWS", 10, raising=False)
    assert base.dealt(spark.range(1000)).rdd.getNumPartitions() == 100
    assert base.dealt(spark.range(5)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
