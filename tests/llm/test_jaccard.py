from __future__ import annotations

import random
from itertools import combinations, permutations

import numpy as np
import pytest
from cases import documents, prose, texts

from corpusloom.llm import jaccard
from corpusloom.llm.graph import components
from corpusloom.llm.shingles import shingle_set, shingle_sets


def brute(rows):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        k = min(5, len(words))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            low[find(b)] = find(a) if find(a) < find(b) else low[find(b)]
            x, y = sorted((find(a), find(b)))
            low[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {
        r["doc_id"]: (r["n_shingles"], r["component_id"])
        for r in jaccard.near_duplicates(documents(spark)).collect()
    }
    assert got == brute(rows)


def test_group_of_near_copies_and_chains(spark):
    rng = random.Random(4)
    words = prose(rng, 300).split()
    rows, chain = [], list(words)
    for i in range(60):  # each a few words further from the first
        chain[(i * 5) % 300] = f"new{i}"
        rows.append(" ".join(chain))
    ids = [1000 - i for i in range(len(rows))]
    got = {r["doc_id"]: r["component_id"] for r in
           jaccard.near_duplicates(documents(spark, rows, ids)).collect()}
    assert got == {i: c for i, (_, c) in brute(zip(ids, rows, strict=True)).items()}
    assert len(set(got.values())) < 10


def test_repeats_null_ids_and_empty_table(spark):
    docs = documents(spark, ["a b c d e f"] * 3 + [None, None], [7, 7, None, 9, 9])
    got = sorted(
        (r["doc_id"] or 0, r["n_shingles"], r["component_id"])
        for r in jaccard.near_duplicates(docs).collect()
    )
    assert got == [(0, 2, 7), (7, 2, 7), (7, 2, 7), (9, 0, 9), (9, 0, 9)]
    assert jaccard.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 5, 63, 64, 90, 300, 3000])
def test_similar_sets_share_signatures(n):
    """Whatever is frequent, the worst pairs at the threshold share what is asked for."""
    rng = np.random.default_rng(n)
    for _ in range(20):
        whole = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
        gone = rng.integers(0, n // 4 + 1)
        a = np.sort(whole[:n])
        b = np.sort(np.r_[a[gone:], whole[n : n + min(gone // 7, n)]]) if n > 1 else a
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        frequent = np.sort(rng.choice(whole, len(whole) // 2, replace=False))
        for known in (np.zeros(0, np.uint64), frequent, np.sort(whole)):
            one, two = (jaccard.signatures(s, known) for s in (a, b))
            assert len(np.intersect1d(one, two)) > min(len(a), len(b)) // jaccard.PER_SIGNATURE


def test_shingles_of_short_texts():
    assert len(shingle_set(None)) == len(shingle_set(" \n")) == 0
    assert len(shingle_set("one two")) == 1
    assert list(shingle_set("ONE two")) == list(shingle_set("one\x0btwo"))
    assert len(shingle_set("a b c d e f")) == 2


def test_components_of_a_hub_a_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 300)]
    edges += [(5, 5), (7, 200), (200, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in
           components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(200, 300)]}
    assert got == want


def alike(n=150, words=200):
    """Texts of one origin, most pairs of them below the threshold."""
    rng = random.Random(9)
    base = prose(rng, words).split()
    out = []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(words), rng.choice([4, 9, 12, 15])):
            text[at] = f"new{i}x{at}"
        out.append(" ".join(text))
    return out


def test_families_that_meet_in_most_pairs_are_one(spark, monkeypatch):
    rows = [(k, i, 50, i, i) for i in range(140) for k in range(i % 2, 8, 2)]
    rows += [(k, i, 50, 0, i) for i in range(0, 140, 9) for k in (0, 1)]  # they meet in two keys
    rows += [(100, 500, 50, 500, 500), (100, 3, 50, 3, 3)]  # met once
    placed = spark.createDataFrame(rows, "key long, name long, n int, pivot long, component long")
    members = spark.createDataFrame(
        [(i, i, 1000 + i % 2) for i in range(140)] + [(500, 500, 1500)],
        "name long, component long, family long",
    )
    got = {r["name"]: r["family"] for r in jaccard.merged(placed, members).collect()}
    assert len(got) == 141 and got[500] == 1500
    assert len({got[i] for i in range(140)}) == 2  # 16 of 4900 pairs and more, below MERGED
    monkeypatch.setattr(jaccard, "MERGED", 1)
    rows = [(k, i, 50, i, i) for i in range(140) for k in range(3)]
    placed = spark.createDataFrame(rows, placed.schema)
    got = {r["name"]: r["family"] for r in jaccard.merged(placed, members.filter("name < 140")).collect()}
    assert set(got.values()) == {1001}


@pytest.mark.parametrize("least", [1, 1 << 40])
def test_merged_families_give_all_links(spark, monkeypatch, least):
    monkeypatch.setattr(jaccard, "MERGED", least)
    monkeypatch.setattr(jaccard, "FAMILY_BLOCK", 40)
    rows = alike()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           jaccard.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute(enumerate(rows))


def test_sets_of_many_texts_are_those_of_each():
    rows = [*texts(), "x" * 600_000 + " y", "tail"]
    together = list(shingle_sets(rows))
    assert len(together) == len(rows)
    for text, found in zip(rows, together, strict=True):
        assert list(found) == list(shingle_set(text))
        words = (text or "").encode().lower().split()
        k = min(5, len(words))
        want = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
        assert len(found) == len(want)


def test_words_of_the_same_letters_differ():
    words = ["".join(p) for p in permutations("abcdefg")] + ["a" * n for n in range(1, 3000)]
    sets = list(shingle_sets(words))
    assert len({int(s[0]) for s in sets}) == len(words)
