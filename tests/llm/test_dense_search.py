from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from cases import documents, prose, texts

from corpusloom.llm import dense_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def slow_search(docs, items, k=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    N, L = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 25 + (75 * n * N) // L
            score = sum(
                math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms(text)
                if t in c
            )
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_terms_keep_other_letters_and_lower_ascii_only():
    text = "Ab-É1_x\x00ÀB\x7f z 😀9 \x80a"
    assert [t.decode() for t in dense_search.terms(text.encode())] == terms(text)
    assert dense_search.terms(None) == dense_search.terms(b"-- ..") == []


ASKED = [
    (1, "karebe losod Mitif lof"),
    (2, texts()[2][:400]),
    (3, "One one ONE"),
    (4, None),
    (5, ""),
    (6, "neverseen"),
    (7, "été ÉTÉ 1 2"),
    (8, texts()[0] * 3),
    (None, "one"),
    (3, "One one ONE"),
]


def items(spark, asked=ASKED):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in asked], "item_id long, text string, doc_id int, score string")


@pytest.mark.parametrize("block_bytes", [8 << 20, 600])
def test_equals_brute_force(spark, block_bytes):
    made = documents(spark)
    docs = [(r["doc_id"], r["text"]) for r in made.collect()]
    asked = sorted({a for a in ASKED if a[0] is not None}, key=str)
    want = slow_search(docs, asked)
    got = dense_search.search(made, items(spark), 10, block_bytes)
    assert rows(got) == want
    assert any(s == t for (_, _, _, s), (_, _, _, t) in zip(want, want[1:]))  # with ties among them


def test_ties_at_the_end_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(dense_search, "DOCS", 4)
    made = documents(spark, ["same words here"] * 40 + ["other"], [*range(100, 60, -1), None])
    got = rows(dense_search.search(made, items(spark, [(1, "words")]), 3))
    assert [d for _, _, d, _ in got] == [61, 62, 63]


def test_empty_tables_and_texts_without_terms(spark):
    made = documents(spark)
    assert dense_search.search(made.limit(0), items(spark)).count() == 0
    assert dense_search.search(made, items(spark).limit(0)).count() == 0
    assert dense_search.search(documents(spark, ["--", None, ""]), items(spark)).count() == 0


def test_tiles_stay_exact_and_add_up_to_all_weights():
    rng = np.random.default_rng(1)
    at, ids = np.nonzero(rng.random((10, 50)) < 0.4)
    weights = rng.integers(1, 40, len(at))
    exact = 60 * dense_search.IMPACT + 1
    seen = np.zeros((10, 50), np.int64)
    for n, tile in enumerate(dense_search.item_tiles(np.arange(10), at, ids, weights, 4, 7, exact)):
        for own, part in tile.parts:
            assert len(own) <= 7
            assert (part.sum(axis=0) * dense_search.IMPACT < exact).all()
            for column, item in enumerate(tile.item_ids):
                seen[item, own] += part[:, column].astype(np.int64)
    want = np.zeros((10, 50), np.int64)
    want[at, ids] = weights
    assert (seen == want).all()


def test_very_long_text(spark):
    import random

    long = prose(random.Random(4), 60_000)
    made = documents(spark, [long, "karebe", *texts()[:5]])
    docs = [(r["doc_id"], r["text"]) for r in made.collect()]
    asked = [(1, "karebe losof"), (2, long[:3000])]
    assert rows(dense_search.search(made, items(spark, asked))) == slow_search(docs, asked)
