"""Splitting against a plain restatement on strings instead of offsets."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.functions.splitting import SEPARATORS, fold_small, split_spans, split_text


def pieces_of(text: str, separator: str) -> list[str]:
    first, *rest = text.split(separator)
    return [part for part in [first, *(separator + part for part in rest)] if part]


def pack(parts: list[str], size: int, overlap: int) -> list[str]:
    out, window = [], []
    for part in parts:
        if window and sum(map(len, window)) + len(part) > size:
            out.append("".join(window))
            while window and (
                sum(map(len, window)) > overlap or sum(map(len, window)) + len(part) > size
            ):
                del window[0]
        window.append(part)
    return out + ["".join(window)]


def plain(text: str, size: int, overlap: int, separators=(*SEPARATORS, "")) -> list[str]:
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    separator, finer = separators[at], separators[at + 1 :]
    parts = pieces_of(text, separator) if separator else list(text)
    out, short = [], []
    for part in parts:
        if len(part) < size or not finer:
            short.append(part)
            continue
        if short:
            out += pack(short, size, overlap)
            short = []
        out += plain(part, size, overlap, finer)
    return out + (pack(short, size, overlap) if short else [])


TEXTS = st.text(alphabet="abé1 .\n", min_size=1, max_size=200)


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(2, 60), st.integers(0, 60))
def test_spans_are_those_of_the_restatement(text, size, overlap):
    overlap = min(overlap, size // 2)
    expected = [piece.strip() for piece in plain(text, size, overlap) if piece.strip()]
    assert split_text(text, size, overlap) == expected


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(2, 60), st.integers(0, 60))
def test_spans_fit_and_cover_the_text(text, size, overlap):
    spans = split_spans(text, size, min(overlap, size // 2))
    assert all(0 < end - start <= size for start, end in spans)
    covered = set()
    for start, end in spans:
        covered.update(range(start, end))
    assert covered == set(range(len(text)))


def test_long_text_without_separator():
    text = "".join(random.Random(1).choices("xyz", k=5_000))
    assert split_text(text, 600, 100) == plain(text, 600, 100)


def test_fragments_lean_on_a_neighbour_that_has_room():
    assert fold_small(["long enough", "tiny"], 20, 6) == ["long enough\ntiny"]
    assert fold_small(["long enough", "tiny"], 12, 6) == ["long enough", "tiny"]
    assert fold_small(["tiny", "long enough"], 20, 6) == ["tiny\nlong enough"]
    assert fold_small(["---", "long enough", "| |"], 20, 6) == ["long enough"]
    assert fold_small(["a", "b", "c"], 3, 2) == ["a\nb", "c"]
    assert fold_small([], 10, 5) == []
