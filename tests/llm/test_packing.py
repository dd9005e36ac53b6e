from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import documents, texts
from tokenizers import Tokenizer

from corpusloom.llm import packing
from corpusloom.llm.tokens import TermHashes, WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "Don't 'S we're x's", "ſtraße İstanbul ΣΑΣ Σ. ŉa",
    "áb é, ≠ x≠", "<|endoftext|> a<|startoftext|>b",
    "\x1c\x1da b\x1f c d\xa0e", "日本語 abc123,,, 1.5e3 ", "", "   ",
    "it's_me 'll ' '' ab'", "Ǆ ǅ ƻǀ ǃ ʼn \xd7\xf7 a\xd7b",
    "x﻿y​z", "ꙮ \U0001d538\U0001d539 ①②", "word,word;WORD... (Word)",
]


def encoded(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_tokenizer_s(text):
    known = WordTokenizer(PATH)
    for _ in range(2):  # learned, then remembered
        assert known.ids(known.numbers([text])[0]).tolist() == encoded(text)


def test_every_id_once_without_padding(spark):
    got = packing.pack(documents(spark), PATH, with_ids=True).toPandas()
    want = dict(enumerate([*encoded(t), 2] for t in texts()))
    assert set(got["doc_id"]) == set(want)
    for doc, pieces in got.sort_values("start").groupby("doc_id"):
        ids = b"".join(pieces["ids"])
        assert np.frombuffer(ids, "<u4").tolist() == want[doc]
        assert (pieces["start"] == pieces["length"].cumsum() - pieces["length"]).all()
        assert (pieces["doc_tokens"] == len(want[doc])).all()
        assert [zlib.crc32(i) for i in pieces["ids"]] == pieces["ids_crc32"].tolist()
    for _, pieces in got.sort_values("offset").groupby("sequence_id"):
        total = pieces["length"].sum()
        assert total <= 4096 and total & (total - 1) == 0
        assert (pieces["offset"] == pieces["length"].cumsum() - pieces["length"]).all()


def test_nearest_unused_documents_come_first():
    terms = [np.array(t) for t in ([1, 2, 3], [9, 8, 7], [1, 2, 4], [9, 8, 5], [6])]
    index = packing.Index(terms)
    pieces = list(packing.fill(np.full(5, 8), lambda d: np.argsort(-index.scores(d), kind="stable"), 16))
    windows = {}
    for doc, _, _, sequence, _ in pieces:
        windows.setdefault(sequence, []).append(doc)
    assert windows[0] == [0, 2] and windows[1] == [1, 3]


def test_scores_are_bm25():
    rng = np.random.default_rng(0)
    terms = [rng.integers(0, 30, rng.integers(0, 40)) for _ in range(25)]
    index = packing.Index(terms)
    mean = np.mean([len(t) for t in terms])
    for seed in range(25):
        want = []
        for t in terms:
            s = 0.0
            for term in set(terms[seed].tolist()):
                df = sum(term in x for x in terms)
                tf = (t == term).sum()
                if df > 1 and tf:
                    idf = np.log1p((25 - df + 0.5) / (df + 0.5))
                    norm = packing.K1 * (1 - packing.B + packing.B * len(t) / mean)
                    s += np.rint(4096 * idf * tf * (packing.K1 + 1) / (tf + norm))
            want.append(s)
        assert np.array_equal(index.scores(seed), want)


def test_term_hashes_are_the_tokenizer_s():
    known = WordTokenizer(PATH)
    for text in ODD:
        want = known.hashes(known.terms(known.numbers([text])[0]))
        assert TermHashes().of([text])[0].tolist() == want.tolist()


def topics(n=40, docs=8):
    """Documents about ``n`` things, all with the same frequent words too."""
    rng = np.random.default_rng(5)
    common = [f"w{chr(97 + i)}x" for i in range(26)]
    name = lambda k, i: "t" + "".join(chr(97 + int(c)) for c in f"{k:02d}{i}")
    return [
        " ".join([*rng.choice(common, 30), *[name(k, i) for i in range(5)]])
        for _ in range(docs)
        for k in range(n)
    ]


def test_neighbours_meet_in_a_shard(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 32)  # ten shards and more
    got = packing.pack(documents(spark, topics()), PATH).toPandas()
    got["shard"], got["topic"] = got["sequence_id"] // (1 << 32), got["doc_id"] % 40
    assert got["shard"].nunique() > 5
    assert (got.groupby("topic")["shard"].nunique() == 1).all()


def test_frequent_terms_are_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 16)
    got = packing.pack(documents(spark, ["one two"] * 200), PATH).toPandas()
    rows = got.groupby(got["sequence_id"] // (1 << 32))["doc_id"].nunique()
    assert rows.sum() >= 200 and len(rows) > 5 and rows.max() < 60


def test_statistics_are_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "FILE_TERMS", 20)
    rows = [t or "" for t in texts()[:70]]
    docs = documents(spark, rows).selectExpr("coalesce(text, '') text")
    known = packing.statistics(docs)
    encoder = WordTokenizer(PATH)
    terms = [encoder.terms(p) for p in encoder.numbers(rows)]
    assert known.files > 1 and known.n == 70
    assert known.mean == sum(map(len, terms)) / 70
    names = np.unique(np.concatenate(terms))
    df, held = known.of(encoder.hashes(names))
    size = np.array([len(t.encode()) for t in rows])
    for name, n, b in zip(names, df, held):
        has = np.array([name in t for t in terms])
        assert n == has.sum() and (n == 1 or b == size[has].sum())
    # A shard of two documents ranks by the counts of all.
    pair = [encoder.hashes(t) for t in terms[:2]]
    whole = packing.Index([encoder.hashes(t) for t in terms])
    part = packing.Index(pair, known)
    both = np.intersect1d(*pair)
    assert len(both) and part.scores(0)[1] == whole.scores(0)[1] != packing.Index(pair).scores(0)[1]


def test_runs_go_on_over_batches_and_nothing_is_remembered_after_them():
    import pandas as pd

    shard = [0, 0, 1, 1, 1, 4, 9, 9]
    rows = pd.DataFrame({"shard": shard, "x": range(8)})
    for size in (1, 2, 3, 8):
        got = list(packing.runs((rows[i : i + size] for i in range(0, 8, size)), "shard"))
        assert [at for at, _ in got] == [0, 1, 4, 9]
        assert [r["x"].tolist() for _, r in got] == [[0, 1], [2, 3, 4], [5], [6, 7]]
    assert list(packing.runs(iter([rows[:0]]), "shard")) == []
    known = WordTokenizer(PATH)
    known.numbers(ODD)
    known.forget()
    assert not known._piece and known.ids(known.numbers([ODD[0]])[0]).tolist() == encoded(ODD[0])


def test_partitions_do_not_matter_and_repeats_and_empty_tables(spark):
    docs = documents(spark, ["a b c"] * 3 + [None, None], [1, 1, None, 2, 2])
    first, second = (
        packing.pack(d, PATH).drop("ids").toPandas().sort_values(["sequence_id", "offset"])
        for d in (docs, docs.repartition(7))
    )
    assert first.reset_index(drop=True).equals(second.reset_index(drop=True))
    assert first["length"].sum() == 3 * 4 + 2
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_a_task_remembers_terms_and_not_each_way_they_are_written():
    hashes, known = TermHashes(), WordTokenizer(PATH)
    ways = ["word", "Word,", "WORD.", "word;)", "wORD!?", " word \t word\n"]
    first, *rest = hashes.of(ways)
    assert set(hashes._known) - {""} == {"word"} and all((r == first[0]).all() for r in rest) and len(rest[-1]) == 2
    for text, pieces in zip(ways, known.numbers(ways)):
        assert known.ids(pieces).tolist() == encoded(text)
    # The empty part, the core, and five tails.
    assert len(known._part) == 6
    known.room()
    assert not known._piece and len(known._part) == 6


def test_texts_with_separators_among_others():
    rows = ["a b", "\x1ca\x1f b", "", "  a  b  ", "b"]
    known = WordTokenizer(PATH)
    assert [known.ids(p).tolist() for p in known.numbers(rows)] == [encoded(t) for t in rows]
    assert [len(t) for t in TermHashes().of(rows)] == [2, 2, 0, 2, 1]
    assert TermHashes().of([]) == [] == known.numbers([])


def test_a_text_is_split_once(spark):
    got = packing.pack(documents(spark), PATH)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ids-" in got.inputFiles()[0] and "text" not in plan.split("ReadSchema")[-1]
    assert "octet_length" not in plan and "MapInArrow encode" not in plan


def test_terms_are_the_ids_of_words(spark):
    rows = ["Straße, straße; (Straße) été ÉTÉ! été", "", "!!! ,", "été x9 x9, strabe", "it's  an'd an", "été"]
    docs = documents(spark, [*rows, *texts()[:40]]).selectExpr("doc_id", "coalesce(text, '') text")
    split = packing.split(docs, PATH).toPandas().sort_values("doc_id")
    ids = [np.frombuffer(i, "<u2") for i in split["ids"]]
    assert [i.tolist() for i in ids[: len(rows)]] == [[*encoded(t), 2] for t in rows]
    found = packing.terms_of(ids, list(split["begins"]), list(split["inner"]))
    # As the words are told apart by their hashes, up to the names.
    known = WordTokenizer(PATH)
    want = [known.terms(p) for p in known.numbers([*rows, *(t or "" for t in texts()[:40])])]
    assert [len(t) for t in found] == [len(t) for t in want]
    pairs = set(zip(np.concatenate(found).tolist(), np.concatenate(want).tolist()))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert found[5].tolist() == found[0][3:4].tolist()


def test_letters_of_other_alphabets_are_those_of_the_tokenizer():
    letters = [chr(c) for c in range(0xC0, 0x250) if chr(c).isalpha()]
    rows = [" ".join(f"{a}{b}{c}" for a in letters) for b in ("", "x", "É") for c in ("", "!", "),")]
    known = WordTokenizer(PATH)
    for text, pieces in zip(rows, known.numbers(rows)):
        assert known.ids(pieces).tolist() == encoded(text)
