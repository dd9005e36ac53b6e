"""License scans by an exact set-similarity join of text blocks with templates (column functions).

A block is a run of words, half of which it shares with the next, so any run of ``stride`` words
lies in one. A block matches a template when it holds the share ``least`` of the template's
distinct words. Template words are ordered by their frequency in all texts, rare ones first:

- prefix filter: a block that holds o of a template's words holds one of its rarest |T| - o + 1;
- length filter: a block has at least o distinct words;
- positional filter: of the template words that a block holds, at least o are as frequent as the
  rarest prefix word found, or more.

The templates are parameters and few; texts are neither exploded nor shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import ascii_lower

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that name a license wherever their words stand one after another.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words of public license notices. Fixed values.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification "
    "are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of "
    "this software and associated documentation files",
    "mit-release": "released under the mit license",
}
LEAST, STRIDE = 0.8, 32


def words_of(text: Column) -> Column:
    """Words of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def frequencies(docs: DataFrame, words: set[str]) -> dict[str, int]:
    """How often each of a few words stands in all texts."""
    found = docs.select(F.explode(words_of(F.col("text"))).alias("w"))
    rows = found.filter(F.col("w").isin(*sorted(words))).groupBy("w").count().collect()
    return {w: 0 for w in words} | {r["w"]: r["count"] for r in rows}


def template_blocks(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    least: float = LEAST,
    stride: int = STRIDE,
) -> DataFrame:
    """Every block of ``docs`` (doc_id, text) that matches a template.

    Returns doc_id, text_hash, label, first_word (from 0), n_words, containment. A null or empty
    text has no blocks; a text shorter than a block is one. Repeated rows are searched each on its
    own and return equal rows. A null doc_id stays null. Other columns are ignored; an empty table
    or no templates give no rows.
    """
    sets = {
        label: sorted(set(text.split())) for label, text in (templates or TEMPLATES).items()
    }
    sets = {label: words for label, words in sets.items() if words}
    count = frequencies(docs, {w for words in sets.values() for w in words})
    ranked = {
        label: sorted(words, key=lambda w: (count[w], w)) for label, words in sets.items()
    }
    needed = {label: max(1, math.ceil(least * len(words))) for label, words in ranked.items()}
    words = F.col("words")
    texts = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words")
    )
    matches = [
        _matches(words, label, tokens, needed[label], stride) for label, tokens in ranked.items()
    ]
    kind = "array<struct<label:string,first_word:bigint,containment:double>>"
    empty = F.array().cast(kind)
    found = F.flatten(F.array(*[F.coalesce(m.cast(kind), empty) for m in matches], empty))
    return texts.select(
        "doc_id", "text_hash", F.size(words).alias("total"), F.explode(found).alias("m")
    ).select(
        "doc_id",
        "text_hash",
        "m.label",
        "m.first_word",
        F.least(F.lit(2 * stride), F.col("total") - F.col("m.first_word")).alias("n_words"),
        "m.containment",
    )


def _literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _matches(words: Column, label: str, tokens: list[str], o: int, stride: int) -> Column:
    """The blocks of ``words`` that hold ``o`` of a template's ``tokens`` (rarest first)."""
    prefix = tokens[: len(tokens) - o + 1]
    places = F.filter(
        F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(*prefix)
    )
    # A place is in the block that begins in its stride, and in the one before.
    blocks = F.array_distinct(
        F.flatten(
            F.transform(
                places,
                lambda i: F.array(
                    F.floor(i / stride), F.greatest(F.floor(i / stride) - 1, F.lit(0))
                ),
            )
        )
    )
    held = F.transform(
        blocks,
        lambda k: F.struct(
            k.alias("k"),
            F.array_distinct(F.slice(words, (k * stride + 1).cast("int"), 2 * stride)).alias("b"),
        ),
    )

    def may_match(x: Column) -> Column:
        met = F.transform(_literal(prefix), lambda t: F.array_contains(x["b"], t))
        rarest = F.array_position(met, True)
        later = F.slice(_literal(tokens), rarest.cast("int"), len(tokens))
        return (F.size(x["b"]) >= o) & (F.size(F.array_intersect(later, x["b"])) >= o)

    def match(x: Column) -> Column:
        both = F.size(F.array_intersect(_literal(tokens), x["b"]))
        return F.struct(
            F.lit(label).alias("label"),
            (x["k"] * stride).alias("first_word"),
            (both / len(tokens)).alias("containment"),
        )

    return F.when(
        F.arrays_overlap(words, _literal(prefix)), F.transform(F.filter(held, may_match), match)
    )


def phrase_places(docs: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, text_hash, n_words, n_base, first_word, last_word, base (labels) of each document.

    Places are where a phrase's words stand one after another; a null text is empty. Repeated rows
    stay; other columns are ignored.
    """
    phrases = PHRASES if phrases is None else phrases
    lower = ascii_lower(F.col("text"))
    texts = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        lower.alias("lower"),
        words_of(F.col("text")).alias("words"),
    )
    rarest = sorted({max(p.split(), key=len) for p in phrases})
    maybe = F.lit(False)
    for word in rarest:
        maybe = maybe | F.contains("lower", F.lit(word))
    line = F.when(maybe, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    texts = texts.select(
        "doc_id", "text_hash", F.size("words").alias("n_words"), F.coalesce(line, F.lit("")).alias("s")
    )
    # The number of a word is the number of spaces before it, less one.
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    firsts, lasts, counts, labels = [], [], [], []
    for phrase, label in phrases.items():
        at = F.instr("s", f" {phrase} ")
        behind = F.instr(F.reverse("s"), f" {phrase[::-1]} ")
        size = len(phrase.split())
        firsts.append(F.when(at > 0, spaces(F.left("s", at)) - 1))
        lasts.append(
            F.when(at > 0, F.col("n_words") - size - (spaces(F.left(F.reverse("s"), behind)) - 1))
        )
        counts.append(F.regexp_count("s", F.lit(f" {phrase}(?= )")))
        labels.append(F.when(at > 0, F.lit(label)))
    return texts.select(
        "doc_id",
        "text_hash",
        F.col("n_words").cast("long").alias("n_words"),
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.array_min(F.array(*firsts)).cast("long").alias("first_word"),
        F.array_max(F.array(*lasts)).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
    )
