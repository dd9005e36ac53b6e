"""Questions, embeddings, response logs, settings."""

from __future__ import annotations

import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.vectors import densify, hash_counts, hash_vector, l2_normalize
from corpusloom.operators.augmentation import (
    chunk_questions,
    complete,
    parse_questions,
    question_prompts,
)
from corpusloom.operators.embedding import batch_rows, embed_with_model
from corpusloom.operators.responses import (
    classify_responses,
    halve_batches,
    parse_completion,
    parse_embedding_response,
    split_until_accepted,
)
from corpusloom.plans.build import build_rows
from corpusloom.settings import Settings


def test_questions_lose_bullets_and_numbers(spark):
    raw = "1. What is sedum?\n- Is it hardy?\n\n* How much sun?\n• 2) And shade?\n100 mg of it?\n-\n"
    row = spark.createDataFrame([(raw,)], "raw string")
    every = row.select(parse_questions(F.col("raw")).alias("q")).head().q
    assert every == [
        "What is sedum?", "Is it hardy?", "How much sun?", "And shade?", "100 mg of it?"
    ]
    assert row.select(parse_questions(F.col("raw"), 2).alias("q")).head().q == every[:2]


def test_a_failing_prompt_has_no_questions_and_fails_nothing_else(spark):
    chunks = spark.createDataFrame(
        [(1, "c0", "good one"), (1, "c1", "bad one"), (2, "c0", "blank")],
        "doc_id long, chunk_id string, text string",
    )

    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return ["\n" if "blank" in p else "- First?\n- Second?\n- Third?" for p in prompts]

    done = complete(question_prompts(chunks, 2), model).cache()
    assert {(r.doc_id, r.chunk_id): r.error for r in done.collect()}[(1, "c1")] == "no"
    asked = chunk_questions(done, 2).collect()
    assert [(r.doc_id, r.chunk_id, r.questions) for r in asked] == [(1, "c0", ["First?", "Second?"])]
    assert question_prompts(chunks, 0).count() == 0


def test_hash_vectors_are_unit_and_ignore_case_and_marks(spark):
    rows = spark.createDataFrame([("Sun, sun SUN! moon",), ("!!! ...",), ("",)], "s string")
    sun, none, empty = [r.v for r in rows.select(hash_vector(F.col("s")).alias("v")).collect()]
    assert len(sun) == 256 and math.isclose(sum(x * x for x in sun), 1.0)
    assert sorted(x for x in sun if x) == pytest.approx([1 / 10**0.5, 3 / 10**0.5])
    assert not any(none) and not any(empty)
    assert hash_counts("a_b ab", 256).max() == 2


def test_normalize_and_densify(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    unit = [r.n for r in rows.select(l2_normalize(F.col("v")).alias("n")).collect()]
    assert unit == [[0.6, 0.8], [0.0, 0.0]]
    entries = F.array(F.struct(F.lit(2).alias("bucket"), F.lit(0.5).alias("weight")))
    assert spark.range(1).select(densify(entries, 4).alias("d")).head().d == [0, 0, 0.5, 0]


def test_model_gets_prefixed_batches_and_vectors_come_back_unit(spark):
    rows = spark.createDataFrame([(i, f"chunk {i}") for i in range(5)], "id long, document string")

    def model(texts):
        assert len(texts) <= 2 and all(t.startswith("passage: ") for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    found = embed_with_model(rows.coalesce(1), model, batch_size=2).collect()
    assert len(found) == 5
    assert all(math.isclose(sum(x * x for x in r.vector), 1.0) for r in found)
    with pytest.raises(Exception, match="asked for 2 vectors, got 1"):
        embed_with_model(rows.coalesce(1), lambda texts: [[1.0]], batch_size=2).collect()


def test_batches_keep_order_within_a_document(spark):
    rows = spark.createDataFrame([(d, i, f"{d}-{i}") for d in (1, 2) for i in range(5)], "d long, i long, v string")
    found = {(r.d, r.batch): r["items"] for r in batch_rows(rows, 2, "d", ["i"], "v").collect()}
    assert found[(1, 0)] == ["1-0", "1-1"] and found[(2, 2)] == ["2-4"] and len(found) == 6


def log(spark, *rows):
    return spark.createDataFrame(
        [(i, n, status, body) for i, (n, status, body) in enumerate(rows)],
        "request_id long, n_inputs int, status int, body string",
    )


def test_embedding_rows_come_back_in_input_order(spark):
    data = [{"index": i, "embedding": [float(i), 0.0]} for i in (2, 0, 1)]
    body = json.dumps({"data": data})
    unnumbered = json.dumps({"data": [{"embedding": [9.0]}, {"embedding": [8.0]}]})
    rows = log(spark, (3, 200, body), (4, 200, body), (2, 200, unnumbered), (1, 200, "{}"))
    found = parse_embedding_response(rows).orderBy("request_id").collect()
    assert found[0].vectors == [[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]]
    assert found[1].status == "Asked for 4 embeddings, got 3." and found[1].vectors is None
    assert found[2].vectors == [[9.0], [8.0]]
    assert found[3].status == "Asked for 1 embeddings, got 0."


def test_completions(spark):
    bodies = [
        {"choices": [{"message": {"content": "ok "}}]},
        {"choices": [{"message": {"content": "<think>h\nm</think> What?"}}]},
        {
            "choices": [{"message": {"content": None}, "finish_reason": "length"}],
            "usage": {"completion_tokens_details": {"reasoning_tokens": 39}},
        },
        {"choices": []},
    ]
    rows = log(spark, *[(1, 200, json.dumps(b)) for b in bodies])
    ok, thought, spent, none = parse_completion(rows).orderBy("request_id").collect()
    assert (ok.content, thought.content) == ("ok", "What?")
    assert spent.content is None and "reasoning_tokens=39" in spent.error
    assert "finish_reason='length'" in spent.error and "max_tokens" in spent.error
    assert none.error.startswith("No choices in response")


def test_outcomes(spark):
    rows = log(
        spark,
        (1, 200, "{}"), (1, 200, '{"error":{"message":"x"}}'), (1, 429, ""), (1, 503, ""),
        (2, 400, "Batch too large"), (1, 400, "Batch too large"), (2, 400, "unknown model"),
        (2, 404, "limit"),
    )
    found = [r.outcome for r in classify_responses(rows).orderBy("request_id").collect()]
    assert found == ["ok", "fail", "retry", "retry", "split", "fail", "fail", "fail"]


def test_rejected_batches_are_halved(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["d"])], "request_id long, items array<string>")
    found = [(r.request_id, r.half, r["items"]) for r in halve_batches(rows).collect()]
    assert found == [(1, 0, ["a"]), (1, 1, ["b", "c"]), (2, 0, ["d"])]


def test_settings():
    keyed, off = Settings(has_key=True), Settings(enable_questions=False)
    assert "__llamanemotro_" in keyed.config_key and "__hash_" in off.config_key
    assert "_q3_" in keyed.config_key and "_q0_" in off.config_key
    assert off.with_(questions_per_chunk=5).questions == 0
    assert len(keyed.config_key) <= 63


def test_another_number_of_answers_is_a_failed_batch(spark):
    def short(prompts):
        return [p.upper() for p in prompts if p != "none"]

    rows = spark.createDataFrame([(1, "a"), (2, "none"), (3, "b")], "id long, prompt string")
    found = {r.id: (r.raw, r.error) for r in complete(rows.coalesce(1), short).collect()}
    assert found[1] == ("A", None) and found[3] == ("B", None)
    assert found[2] == (None, "0 answers to 1 prompts")


def test_batches_are_halved_until_they_are_accepted(spark):
    words = [[f"w{i}" for i in range(n)] for n in (0, 1, 2, 7, 64)] + [["long" * 30, "a", "b"], None]
    batches = spark.createDataFrame(list(enumerate(words)), "request_id long, items array<string>")

    def slow(items):
        if len(items) <= 1 or len("".join(items)) <= 12:
            return [items]
        return slow(items[: len(items) // 2]) + slow(items[len(items) // 2 :])

    parts = split_until_accepted(batches, lambda a: F.length(F.array_join(a, "")) <= 12)
    found = {}
    for r in sorted(parts.collect(), key=lambda r: (r.request_id, r.part)):
        found.setdefault(r.request_id, []).append(r["items"])
    assert found == {i: slow(w) for i, w in enumerate(words) if w is not None}
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()


def test_key_follows_what_makes_the_vectors(spark):
    rows = spark.createDataFrame([(1, 0, "c", "s", "text")], "doc_id long, chunk_index int, chunk_id string, section string, text string")
    embed = lambda texts: [[1.0] for _ in texts]
    for settings in (Settings(), Settings(has_key=True)):
        assert "__hash_" in build_rows(rows, settings).head().config_key
        assert "__llamanemotro_" in build_rows(rows, settings, embed=embed).head().config_key


def test_completions_leave_in_the_frames_they_came_in(spark):
    """A frame for each small batch of prompts took longer than the model."""

    class Prompts:
        schema = spark.range(0).selectExpr("id", "'' AS prompt").schema

        def mapInPandas(self, run, fields):
            return run

    frame = pd.DataFrame({"id": range(50), "prompt": [f"p{i}" for i in range(50)]})
    done = list(complete(Prompts(), lambda texts: [t.upper() for t in texts])(iter([frame])))
    assert [len(part) for part in done] == [50]
    assert done[0]["raw"].tolist() == [f"P{i}" for i in range(50)]
