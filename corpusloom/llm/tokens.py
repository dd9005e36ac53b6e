"""Token ids of whole texts by a public tokenizer, with the pieces between white space remembered.

The tokenizer's normaliser and pre-tokenizer never join text across white space, so the ids of a
text are those of its pieces one after another. Most pieces are letters and punctuation after
them, which the pre-tokenizer parts and whose case it ignores, so a piece is kept as two parts, a
core and a tail. A core is one word to the pre-tokenizer, so it goes to the merges directly.

Texts are split, and pieces told apart and parted, as Arrow arrays; only distinct cores and tails of a
call become Python strings.
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from tokenizers import Tokenizer

#: str.split() also splits at these, the tokenizer's white space does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[^\\S\x1c-\x1f]+")
#: Latin letters whose lower case does not depend on their neighbours, then ASCII punctuation;
#: an apostrophe may begin a token of its own with the letters after it.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-įĲ-ɏ]"
_PUNCTUATION = string.punctuation.replace("'", "")
#: Parts of pieces that a task remembers, some 200 bytes each.
_REMEMBERED = 300_000


def _distinct(texts: list[str] | pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct pieces of all texts, and the places of each text's pieces among them."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    if pc.any(pc.match_substring_regex(texts, _SEPARATORS.pattern)).as_py():
        lists = pa.array(_pieces(texts.to_pylist()), pa.list_(pa.string()))
    else:
        lists = pc.utf8_split_whitespace(texts)
    coded = lists.values.dictionary_encode()
    places, ends = coded.indices.to_numpy(), lists.offsets.to_numpy()[1:]
    none = pc.index(coded.dictionary, "").as_py()
    if none >= 0:  # before white space that a text begins with, and after its last
        real = places != none
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        places = places[real]
    return coded.dictionary, np.split(places, ends[:-1])[: len(texts)]


def _parted(pieces: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray, np.ndarray]:
    """Cores and tails of pieces, and which of the pieces are letters and punctuation after them;
    others are cores without a tail.
    """
    bare = pc.ascii_rtrim(pieces, characters=_PUNCTUATION)
    plain = pc.ascii_is_alpha(bare)  # most of them, without a match
    cores = pc.if_else(plain, pc.ascii_lower(bare), pieces)
    tails = pc.if_else(plain, pc.ascii_ltrim(pieces, characters=string.ascii_letters), "")
    other = pc.invert(plain)
    rest, plain = pieces.filter(other), plain.to_numpy(zero_copy_only=False).copy()
    if len(rest):
        bare = bare.filter(other)
        letters = pc.match_substring_regex(bare, f"^{_LETTERS}+$")
        longer = pc.not_equal(pc.binary_length(rest), pc.binary_length(bare))
        after = pc.replace_substring_regex(rest.filter(longer), f"^{_LETTERS}+", "")
        after = pc.replace_with_mask(pc.if_else(longer, rest, ""), longer, after)
        cores = pc.replace_with_mask(cores, other, pc.if_else(letters, pc.utf8_lower(bare), rest))
        tails = pc.replace_with_mask(tails, other, pc.if_else(letters, after, ""))
        plain[~plain] = letters
    return cores.dictionary_encode(), tails.dictionary_encode(), plain


class _Hashes(dict):
    """The hash of a term, worked out when first asked for."""

    def __missing__(self, term: str) -> int:
        h = self[term] = xxhash.xxh3_64_intdigest(term)
        return h


class WordTokenizer:
    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        # The byte-level alphabet: printable Latin-1 stands for itself, other bytes for the
        # characters from 256 on.
        others = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)]
        self._letters = np.arange(256, dtype="<u4")
        self._letters[others] = np.arange(256, 256 + len(others))
        self.forget()

    def forget(self) -> None:
        """Drop all pieces; numbers given before are void then."""
        self._piece = 0  # pieces with a number
        self._cores = np.zeros(1 << 12, np.int64)
        self._tails = np.zeros(1 << 12, np.int64)
        self._part: dict[str, int] = {"": 0}
        self._starts = np.zeros(1 << 12, np.int64)
        self._lengths = np.zeros(1 << 12, np.int64)
        self._ids = np.zeros(1 << 16, np.int32)
        self._used = 0

    def _encode(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _add(self, parts: list[str], found: Iterable[list[int]]) -> None:
        n = len(self._part)
        ids, lengths = array("i"), array("q")
        for of in found:
            ids.extend(of)
            lengths.append(len(of))
        lengths = np.asarray(lengths)
        total = len(ids)
        self._ids = _room(self._ids, self._used + total)
        self._starts = _room(self._starts, n + len(parts))
        self._lengths = _room(self._lengths, n + len(parts))
        self._ids[self._used : self._used + total] = ids
        self._starts[n : n + len(parts)] = self._used + np.cumsum(lengths) - lengths
        self._lengths[n : n + len(parts)] = lengths
        self._used += total
        self._part.update(zip(parts, range(n, n + len(parts)), strict=True))

    def _learn(self, words: list[str], others: list[str]) -> None:
        """Look up distinct parts that are not known: ``words`` of letters, and ``others``."""
        if words:
            tokenize, table = self._tokenizer.model.tokenize, self._letters
            wide = [w for w in words if not w.isascii()]
            words = wide + [w for w in words if w.isascii()]
            # As bytes in one go; a line end is one of the characters for other bytes.
            spelt = table[np.frombuffer("\n".join(wide).encode(), np.uint8)]
            spelt = spelt.tobytes().decode("utf-32-le").split(chr(table[ord("\n")])) if wide else []
            self._add(words, ([t.id for t in tokenize(w)] for w in chain(spelt, words[len(wide) :])))
        if others:
            self._add(others, map(self._encode, others))

    def _numbered(self, parts: list[str], word: np.ndarray) -> np.ndarray:
        """The numbers of distinct ``parts``, learned if they are not known; those of letters are ``word``."""
        known = self._part
        found = np.fromiter(map(known.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(found < 0)
        if len(new):
            letters = word[new]
            self._learn(*([parts[i] for i in new[of].tolist()] for of in (letters, ~letters)))
            found[new] = [known[parts[i]] for i in new.tolist()]
        return found

    def room(self) -> None:
        """Forget all parts if there are many, and all pieces; numbers given before are void then."""
        self._piece = 0
        if len(self._part) > _REMEMBERED:
            self.forget()

    def numbers(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The numbers of each text's pieces."""
        pieces, places = _distinct(texts)
        cores, tails, plain = _parted(pieces)
        word = np.zeros(len(cores.dictionary), bool)
        word[cores.indices.to_numpy()[plain]] = True
        begin = self._piece
        self._piece += len(pieces)
        self._cores, self._tails = _room(self._cores, self._piece), _room(self._tails, self._piece)
        for of, parts, letters in (
            (self._cores, cores, word),
            (self._tails, tails, np.zeros(len(tails.dictionary), bool)),
        ):
            # By way of numpy, which makes strings much faster than to_pylist.
            strings = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
            numbers = self._numbered(strings, letters)
            of[begin : self._piece] = numbers[parts.indices.to_numpy()]
        return [at.astype(np.int64) + begin for at in places]

    def terms(self, numbers: np.ndarray) -> np.ndarray:
        """What stands for the pieces' words, whatever their case and the punctuation after them."""
        return self._cores[numbers]

    def hashes(self, terms: np.ndarray) -> np.ndarray:
        """64-bit hashes of terms, the same in every task."""
        names = list(self._part)
        found = (xxhash.xxh3_64_intdigest(names[at]) for at in terms.tolist())
        return np.fromiter(found, np.uint64, len(terms)).view(np.int64)

    def counts(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each piece, without the punctuation after it, and of that."""
        return self._lengths[self._cores[numbers]], self._lengths[self._tails[numbers]]

    def id_type(self) -> str:
        """What holds any id."""
        return "<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The token ids of pieces."""
        parts = np.stack([self._cores[numbers], self._tails[numbers]], axis=1).ravel()
        lengths = self._lengths[parts]
        ends = np.cumsum(lengths)
        at = np.repeat(self._starts[parts] - (ends - lengths), lengths)
        return self._ids[at + np.arange(len(at))]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    while len(array) < size:
        array = np.concatenate([array, np.zeros_like(array)])
    return array


def _pieces(texts: list[str]) -> list[list[str]]:
    return [
        [w for w in _SPACE.split(t) if w] if _SEPARATORS.search(t) else t.split() for t in texts
    ]


class TermHashes:
    """The hashes of texts' terms as ``WordTokenizer`` has them, without learning token ids.

    A task makes its own, which ends with it.
    """

    def __init__(self):
        self._known = _Hashes()

    def of(self, texts: list[str]) -> list[np.ndarray]:
        if len(self._known) > _REMEMBERED:
            self._known = _Hashes()
        pieces, places = _distinct(texts)
        cores, _, _ = _parted(pieces)
        names = cores.dictionary.to_numpy(zero_copy_only=False).tolist()
        hashes = np.fromiter(map(self._known.__getitem__, names), np.uint64, len(names)).view(np.int64)
        hashes = hashes[cores.indices.to_numpy()]
        return [hashes[at] for at in places]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
