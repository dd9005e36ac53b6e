"""Size-bounded splitting of one section body, as an Arrow batch function.

Splitting is the one step whose state (where the last piece ended, what it may overlap)
runs along the text, so it is done inside the task on whole Arrow batches. Everything
is kept as offsets into the body: a piece is a ``[start, end)`` span between two
separator positions, which turns greedy packing into two binary searches per piece.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Separators from coarse to fine; below the last one, single characters.
SEPARATORS = ("\n\n", "\n", " ")
PIECES = ArrayType(StringType())
CHUNKS = ArrayType(
    ArrayType(
        StructType([StructField("section", StringType()), StructField("text", StringType())])
    )
)
_ALNUM = re.compile(r"[^\W_]")


def _pack(bounds: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy spans over consecutive boundaries, each at most ``size`` long."""
    spans = []
    first, last = 0, len(bounds) - 1
    while True:
        stop = bisect_right(bounds, bounds[first] + size) - 1
        end = bounds[stop]
        spans.append((bounds[first], end))
        if stop == last:
            return spans
        upcoming = bounds[stop + 1] - end
        # The next span may reach back over `overlap` characters, as long as the
        # upcoming piece still fits behind them.
        first = bisect_left(bounds, max(end - overlap, end + upcoming - size), first, stop)


def split_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of ``text`` no longer than ``size``, cut at the coarsest separator."""
    spans: list[tuple[int, int]] = []
    todo = [(0, len(text), 0)]
    while todo:
        lo, hi, level = todo.pop()
        if level < 0:  # boundaries already known: a run of short pieces
            spans.extend(_pack(lo, size, overlap))
            continue
        while level < len(SEPARATORS) and text.find(SEPARATORS[level], lo, hi) < 0:
            level += 1
        if level == len(SEPARATORS):
            step = size - overlap
            count = max(1, -(-(hi - lo - overlap) // step))
            spans.extend((lo + k * step, min(lo + k * step + size, hi)) for k in range(count))
            continue
        cuts = [m.start() for m in re.compile(SEPARATORS[level]).finditer(text, lo, hi)]
        bounds = [lo, *(cut for cut in cuts if cut > lo), hi]
        work, run = [], [lo]
        for start, end in zip(bounds, bounds[1:]):
            if end - start < size:
                run.append(end)
                continue
            if len(run) > 1:
                work.append((run, None, -1))
            work.append((start, end, level + 1))
            run = [end]
        if len(run) > 1:
            work.append((run, None, -1))
        todo.extend(reversed(work))  # keep text order on the stack
    return spans


def split_text(text: str, size: int, overlap: int) -> list[str]:
    pieces = (text[start:end].strip() for start, end in split_spans(text, size, overlap))
    return [piece for piece in pieces if piece]


def _opening(widths: list[int], budget: int, least: int) -> list[int]:
    """Which pieces open a chunk, by the pieces' widths alone.

    A running width either takes a short piece in (and grows past the piece's own width) or
    starts again with it. A short first chunk has none before it and takes in the second.
    """

    def grow(width: int, piece: int) -> int:
        joined = width + 1 + piece
        return joined if piece < least and joined <= budget else piece

    running = list(accumulate(widths, grow))
    opening = [i for i, width in enumerate(running) if i == 0 or width == widths[i]]
    closing = [running[i - 1] for i in [*opening[1:], len(widths)]]
    if closing[1:] and closing[0] < least and closing[0] + 1 + closing[1] <= budget:
        del opening[1]
    return opening


def fold_small(pieces: list[str], budget: int, min_chars: int) -> list[str]:
    """Join fragments below ``min_chars`` to a neighbour where the budget allows."""
    worded = [piece for piece in pieces if _ALNUM.search(piece)]
    if not worded:
        return []
    opening = _opening([len(piece) for piece in worded], budget, min_chars)
    return ["\n".join(worded[i:j]) for i, j in zip(opening, [*opening[1:], len(worded)])]


@arrow_udf(PIECES)
def _split(body: pa.Array, size: pa.Array, overlap: pa.Array) -> pa.Array:
    rows = zip(body.to_pylist(), size.to_pylist(), overlap.to_pylist())
    return pa.array([split_text(*row) for row in rows], pa.list_(pa.string()))


@arrow_udf(PIECES)
def _fold(pieces: pa.Array, budget: pa.Array, min_chars: pa.Array) -> pa.Array:
    rows = zip(pieces.to_pylist(), budget.to_pylist(), min_chars.to_pylist())
    return pa.array([fold_small(*row) for row in rows], pa.list_(pa.string()))


@arrow_udf(CHUNKS)
def _chunk(sections: pa.Array, settings: pa.Array) -> pa.Array:
    out = []
    for parts, variants in zip(sections.to_pylist(), settings.to_pylist()):
        lists = []
        for variant in variants:
            chunks = []
            for part, limit in zip(parts, variant["limits"], strict=True):
                size = limit["size"]
                pieces = split_text(part["body"], size, limit["overlap"])
                chunks += [
                    {"section": part["section"], "text": limit["prefix"] + piece}
                    for piece in fold_small(pieces, size, variant["least"])
                ]
            lists.append(chunks)
        out.append(lists)
    chunk = pa.struct([("section", pa.string()), ("text", pa.string())])
    return pa.array(out, pa.list_(pa.list_(chunk)))


def split_body(body: Column, size: Column, overlap: Column) -> Column:
    """ARRAY<STRING> of stripped pieces, in text order."""
    return _split(body, size, overlap)


def merge_small(pieces: Column, budget: Column, min_chars: Column) -> Column:
    return _fold(pieces, budget, min_chars)


def chunk_sections(sections: Column, settings: Column) -> Column:
    """A document's ARRAY<STRUCT<section_seq, section, body>>, and for each setting its least size and the
    (prefix, size, overlap) of every section, to a list of chunks (section, text) for each setting.
    """
    return _chunk(sections, settings)
