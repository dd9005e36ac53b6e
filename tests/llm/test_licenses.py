from __future__ import annotations

import math
import re

from cases import documents, texts

from corpusloom.llm import licenses

EXTRA = [
    "x MIT\n license, and mit license mit licensed", "General Public, License general public license v3",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files.",
    "word " * 31 + "licensed under the apache license, version 2.0 " + "word " * 40,
    "licensed under something", "under the license released mit", "mit", "MIT LICENSE", "Apache-License",
    "mit license " * 3, " ".join(f"w{i}" for i in range(60_000)) + " released under the MIT license.",
]


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_phrases(spark):
    rows = texts() + EXTRA
    got = {r["doc_id"]: r for r in licenses.phrase_places(documents(spark, rows)).collect()}
    for i, text in enumerate(rows):
        w, at, names = words(text), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += found
            names |= {label} if found else set()
        want = (len(w), len(at), min(at, default=None), max(at, default=None), sorted(names))
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base"]) == want


def test_blocks_against_brute_force(spark):
    rows = texts() + EXTRA
    for least in (0.5, 0.8, 1.0):
        got = licenses.template_blocks(documents(spark, rows), least=least).collect()
        want = []
        for i, text in enumerate(rows):
            w = words(text)
            for label, t in licenses.TEMPLATES.items():
                t = set(t.split())
                for k in range(0, len(w), licenses.STRIDE):
                    b = set(w[k : k + 2 * licenses.STRIDE])
                    if len(b & t) >= math.ceil(least * len(t)):
                        want.append((i, label, k, len(b & t) / len(t)))
        mine = [(r["doc_id"], r["label"], r["first_word"], r["containment"]) for r in got]
        assert sorted(mine) == sorted(want)


def test_only_column_functions(spark, capsys):
    licenses.template_blocks(documents(spark)).explain("simple")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_empty_table(spark):
    docs = documents(spark).limit(0)
    assert licenses.template_blocks(docs).count() == licenses.phrase_places(docs).count() == 0
