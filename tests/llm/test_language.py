from __future__ import annotations

import random

import numpy as np
import pytest
from cases import documents
from pyspark.sql import functions as F

from corpusloom.llm import language

STEMS = {"aa": ["thar", "ingo", "whel", "ough"], "bb": ["éaux", "ment", "ionç"], "cc": ["keit", "ßung", "äche"]}


def corpus(seed: int, n: int):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(list(STEMS))
        words = ["".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 150))]
        yield i, " ".join(words), lang


@pytest.fixture(scope="module")
def net(spark):
    rows = [*corpus(1, 400), (None, None, "aa"), (None, "thar", None)]
    return language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out_accuracy(spark, net):
    rows = spark.createDataFrame(list(corpus(2, 200)), "doc_id long, text string, lang string")
    got = language.predict(rows, net).toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_whole_text_counts(spark, net):
    long = "thar " * 200 + "keit ßung " * 4000
    got = language.predict(documents(spark, [long]), net).first()
    assert got["lang_pred"] == "cc"


def test_null_empty_and_no_letters(spark, net):
    docs = documents(spark, [None, "", " 12 ?!", "thar ingo"])
    got = {r["doc_id"]: r for r in language.predict(docs, net).collect()}
    assert [got[i]["lang_pred"] for i in range(4)] == ["und", "und", "und", "aa"]
    assert [got[i]["_score"] for i in range(3)] == [0, 0, 0]  # the table has a score already
    assert [got[i]["score"] for i in range(4)] == [1.0] * 4
    assert language.predict(docs.limit(0), net).count() == 0


def test_nothing_to_learn_from(spark):
    docs = documents(spark, ["abc"]).withColumn("lang", F.lit(None).cast("string"))
    assert language.learn(docs) is None
    assert language.predict(docs, None).first()["lang_pred"] == "und"


def test_sample_is_bounded_and_copies_count_once(spark):
    rows = [(i, "thar ingo", "aa") for i in range(3000)] + list(corpus(3, 300))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.sample(docs, 50, 2).toPandas()
    assert len(got) <= 2 * 50 * 2 * 3
    assert len({(r.lang, bytes(r.bytes)) for r in got.itertuples()}) == len(got)


def test_a_language_of_copies_is_learned(spark):
    """Three texts, thousands of times each: all of them are in the sample."""
    few = ["éaux ment ionç " * n for n in (2, 5, 9)]
    rows = [(i, few[i % 3], "bb") for i in range(3000)] + [(i, "thar ingo", "aa") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.sample(docs, 50, 2).toPandas()
    assert {bytes(b) for b in got["bytes"][got["lang"] == "bb"]} == {t.encode()[:512] for t in few}
    assert "bb" in language.learn(docs, rows=50).languages


def slow_prediction(net, text: bytes):
    """One position of one filter of one window at a time, and the vote over all windows."""
    windows = [text[i : i + 512] for i in range(0, max(1, len(text)), 512)]
    total = np.zeros(len(net.languages))
    for window in windows:
        vectors = [net.embedding[b] for b in window.ljust(512, b"\0")]
        vectors += [np.zeros(language.DEPTH)] * 4
        features = []
        for w in language.WIDTHS:
            for f in range(net.filters[w].shape[1]):
                weights = net.filters[w][:, f]
                heard = [np.concatenate(vectors[i : i + w]) @ weights for i in range(512)]
                features.append(max(0.0, max(heard) + net.bias[w][f]))
        x = np.array(features) @ net.out + net.out_bias
        total += x - x.max() - np.log(np.exp(x - x.max()).sum())
    mean = total / len(windows) ** 0.5
    p = np.exp(mean - mean.max())
    return net.languages[int(p.argmax())], p.max() / p.sum()


def test_predictions_are_a_slow_forward_pass_s(spark, net):
    rows = ["thar ingo whel", "éaux ment keit ßung äche " * 30, "ough keit " * 120, "äche"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in language.predict(docs, net).collect():
        lang, score = slow_prediction(net, r["text"].encode())
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3


def test_gradients_are_differences():
    rng = np.random.default_rng(0)
    net = language.Network.new(["x", "y", "z"], rng)
    x, y = rng.integers(0, 256, (6, 20)).astype(np.uint8), rng.integers(0, 3, 6)
    weight = np.ones(6, np.float32)

    def loss():
        return -net.log_probabilities(x)[np.arange(6), y].astype(np.float64).mean()

    for a, g in zip(net.arrays(), language.gradients(net, x, y, weight), strict=True):
        places = np.argsort(-np.abs(g).ravel())[:4]
        for p in places:
            i = np.unravel_index(p, a.shape)
            kept, step = a[i], 1e-2
            a[i] = kept + step
            high = loss()
            a[i] = kept - step
            low = loss()
            a[i] = kept
            assert abs((high - low) / (2 * step) - g[i]) < 0.05 * abs(g[i]) + 2e-3


def test_windows_cover_the_text():
    x, counts = language.cut([b"", b"a" * 512, b"b" * 513])
    assert counts.tolist() == [1, 1, 2]
    assert [(w > 0).sum() for w in x] == [0, 512, 512, 1]
