from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
from cases import documents, texts

from corpusloom.llm import kneser_ney
from corpusloom.llm.shingles import word_hashes


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def model_of(training):
    pairs = Counter()
    for t in training:
        for a, b in zip(["start", *t], t):
            pairs[a, b] += 1
    context, followed, before = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (a, b), n in pairs.items():
        context[a] += n
        followed[a][min(n, 3) - 1] += 1
        before[b] += 1

    def discounts(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        if not min(n):
            return [0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) for k in (1, 2, 3)]

    high, low = discounts(pairs.values()), discounts(before.values())
    left = sum(low[min(n, 3) - 1] for n in before.values()) / len(pairs)

    def p(a, b):
        q = left / (len(before) + 1)
        if before[b]:
            q += max(before[b] - low[min(before[b], 3) - 1], 0) / len(pairs)
        if not context[a]:
            return q
        n = pairs[a, b]
        own = max(n - high[min(n, 3) - 1], 0) if n else 0
        return (own + sum(x * y for x, y in zip(followed[a], high)) * q) / context[a]

    return p, before


def check(spark, rows, train_rows):
    docs = documents(spark, rows)
    model = kneser_ney.train(documents(spark, train_rows))
    given = docs.select("doc_id", "text", "source")
    got = {r["doc_id"]: r for r in kneser_ney.score(given, model).collect()}
    training = [tokens(t) for t in train_rows]
    counts = Counter(w for t in training for w in t)
    n, v = sum(counts.values()), len(counts)
    p, _ = model_of(training)
    for i, text in enumerate(rows):
        t = tokens(text)
        r = got[i]
        assert (r["n_tokens"], r["train_tokens"]) == (len(t), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        score = sum(math.log10(p(a, b)) for a, b in zip(["start", *t], t))
        assert math.isclose(r["score"], score, rel_tol=1e-9)
    return model


def test_scores_against_brute_force(spark):
    rows = texts()
    check(spark, rows, rows[:70] + [rows[0]] * 30)


def test_many_shards_and_frequent_contexts(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", 3000)
    monkeypatch.setattr(kneser_ney, "FREQUENT", 150)
    monkeypatch.setattr(kneser_ney, "BLOCK", 2000)
    monkeypatch.setattr(kneser_ney, "SCORED", 1000)
    rows = texts() + ["common " * 3000, "common one common two"]
    model = check(spark, rows, rows)
    assert model.shards > 5 and len(model.frequent[0]) > 1


def test_probabilities_sum_to_one(spark):
    rows = texts()[:60]
    model = kneser_ney.train(documents(spark, rows))
    known = np.unique(np.concatenate([kneser_ney.tokens(t) for t in rows]))
    unseen = word_hashes("neverseen")
    for context in [kneser_ney.START, *known[:5], unseen[0]]:
        after = np.r_[known, unseen]
        logs, _ = kneser_ney.probabilities(model, np.full(len(after), context), after)
        assert math.isclose((10.0**logs).sum(), 1.0, rel_tol=1e-9)


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = documents(spark, ["a b", None])
    model = kneser_ney.train(docs.limit(0))
    got = {r["doc_id"]: r for r in kneser_ney.score(docs.select("doc_id", "text"), model).collect()}
    assert (got[0]["n_tokens"], got[0]["n_known"], got[1]["n_tokens"]) == (3, 0, 1)
    assert got[0]["score"] == 0.0  # every token is the unseen word
    assert kneser_ney.score(docs.select("doc_id", "text").limit(0), model).count() == 0


def test_files_of_many_shards_are_mapped_once(tmp_path, monkeypatch):
    shards = 900
    names = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 20_000).astype(np.uint64))
    shard = kneser_ney.shard_of(names, shards)
    for k in range(shards):
        for keys, values, width in (("words", "seen", 2), ("pairs", "counts", 1), ("contexts", "followed", 3)):
            kneser_ney.saved(str(tmp_path), f"{keys}-{k}", names[shard == k])
            numbers = np.arange(len(names))[shard == k]
            kneser_ney.saved(str(tmp_path), f"{values}-{k}", np.stack([numbers] * width, 1))
    load, loaded = np.load, []
    monkeypatch.setattr(np, "load", lambda path, **kw: loaded.append(path) or load(path, **kw))
    for _ in range(2):
        for keys, values, width in (("words", "seen", 2), ("pairs", "counts", 1), ("contexts", "followed", 3)):
            found = kneser_ney.looked_up(str(tmp_path), keys, values, names[::3], shard[::3], width)
            assert (found == np.arange(len(names))[::3, None]).all()
    assert len(loaded) == len(set(loaded)) == 6 * shards
    kneser_ney._mapped.cache_clear()
