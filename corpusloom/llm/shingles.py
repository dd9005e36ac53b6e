"""Sets of word shingles of whole texts, as sorted 63-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

WORDS = 5
_REMEMBERED = 200_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case (bytes are split and
    lowered by ASCII rules, which are just these).
    """
    if len(_hashes) > _REMEMBERED:
        _hashes.clear()
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


#: Words of many texts are hashed together: each byte, A-Z in lower case, has a number, and a word's
#: hash is the sum of its bytes' numbers times powers of ``_STEP``, mixed. Powers have inverses
#: modulo 2^64 (the step is odd, and 5 modulo 8 for a period of 2^62), so places do not matter.
_STEP = 0xD1342543DE82EF95
_BLOCK = 1 << 18  # bytes of texts hashed together, or one text
_NUMBERS = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
_NUMBERS[ord("A") : ord("Z") + 1] = _NUMBERS[ord("a") : ord("z") + 1]
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True


def _powers(step: int, n: int) -> np.ndarray:
    out = np.full(n, step & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS, _INVERSES = (_powers(s, 2 * _BLOCK) for s in (_STEP, pow(_STEP, -1, 2**64)))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words of each."""
    # White space around each text, so that edges are a word's first byte and the one after it.
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    space = _SPACES[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    first, last = edges[::2] + 1, edges[1::2]
    powers, inverses = _POWERS, _INVERSES
    if len(data) > len(powers):
        powers, inverses = (_powers(s, len(data)) for s in (_STEP, pow(_STEP, -1, 2**64)))
    sums = np.cumsum(_NUMBERS[data] * powers[: len(data)])
    hashes = mixed((sums[last] - sums[first - 1]) * inverses[first])
    ends = np.searchsorted(first, np.cumsum(sizes + 1))
    return hashes, np.diff(ends, prepend=0)


def _sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    h, counts = _words(texts)
    begins = np.cumsum(counts) - counts
    sizes = np.where(counts < words, np.minimum(counts, 1), counts - words + 1)
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) + np.repeat(begins - (ends - sizes), sizes)
    rolled = np.full(len(at), words, np.uint64)
    long = np.repeat(counts >= words, sizes)
    whole = at[long]
    values = rolled[long]
    for i in range(words):
        values = values * _BASE + h[whole + i]
    rolled[long] = values
    for t in np.flatnonzero((counts > 0) & (counts < words)):
        value = counts[t : t + 1].astype(np.uint64)
        for i in range(counts[t]):
            value = value * _BASE + h[begins[t] + i]
        rolled[ends[t] - 1] = value[0]
    rolled = mixed(rolled) >> np.uint64(1)
    parts = np.split(rolled, ends[:-1])
    for part in parts:
        part.sort()
    new = np.ones(len(rolled), bool)
    new[1:] = rolled[1:] != rolled[:-1]
    new[(ends - sizes)[sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])[ends]
    return np.split(rolled[new], kept[:-1])


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles of words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower
    case; a shorter text is one shingle, a text without words has none.
    """
    block, size = [], 0
    for text in texts:
        block.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(block[-1]) + 1
        if size > _BLOCK:
            yield from _sets(block, words)
            block, size = [], 0
    if block:
        yield from _sets(block, words)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    return next(shingle_sets([text], words))
