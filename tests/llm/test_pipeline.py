from __future__ import annotations

import zlib

import corpus_pipeline
import public_tokenizers
from cases import documents, texts
from tokenizers import Tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_after_another(spark):
    rows = texts()
    docs = documents(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "mix", "pack"]

    told = stages["language"](spark, docs, "")
    assert told.columns == COLUMNS
    ids = {r["doc_id"] for r in told.collect()}
    letters = {i for i, t in enumerate(rows) if t and any(c.isalpha() for c in t)}
    assert ids <= letters and len(ids) > 0.8 * len(letters)

    from test_jaccard import brute

    single = stages["near_duplicates"](spark, docs, "")
    assert single.columns == COLUMNS
    assert {r["doc_id"] for r in single.collect()} == {i for i, (_, c) in brute(enumerate(rows)).items() if i == c}

    mixed = stages["mix"](spark, docs, "")
    assert mixed.columns == COLUMNS
    taken = {}
    for r in mixed.collect():
        words = [w.decode() for w in r["text"].encode().split()]
        assert r["n_chars"] == len(r["text"])
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(words)
        assert r["text"].strip() and (r["text"] == rows[r["doc_id"]] or words[0] in rows[r["doc_id"]])
    from corpusloom.llm.mixing import mix

    assert taken == {r["doc_id"]: r["taken"] for r in mix(docs).collect() if r["taken"]}

    packed = stages["pack"](spark, docs, "").toPandas()
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    for doc, pieces in packed.groupby("doc_id"):
        ids = [*encode(rows[doc] or "", add_special_tokens=False).ids, 2]
        assert sum(pieces["length"]) == len(ids)
        for p in pieces.itertuples():
            part = b"".join(i.to_bytes(4, "little") for i in ids[p.start : p.start + p.length])
            assert zlib.crc32(part) == p.ids_crc32


def test_stages_on_an_empty_table_and_rows_without_id(spark):
    docs = documents(spark, ["a b c d e f g h i"] * 4, [None, None, 3, 3])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 0, 3]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
