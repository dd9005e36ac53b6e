"""Packing by lexical retrieval: windows are filled with the nearest unused documents of a shard.

Splitting. Every text is split and looked up once. Its token ids are stored, with two bits each that
tell where words begin and what is punctuation after them. No later step reads a text: a term is
the ids of a word, without that punctuation.

Statistics. In how many documents and bytes each term is, the number of documents and their mean
length are counted once over all documents. Terms of several documents are sorted hash arrays in the
shared folder, which workers map; nothing of them passes through the driver.

Placing. A document goes where the term does that weighs most in it by BM25, among those that other
documents have too and whose documents fit half a shard, so documents about the same things meet.
If it has only more frequent ones, the heaviest of them counts and its documents are split by hash.

Filling. One shuffle moves the ids into shards. A task builds a shard's BM25 inverted index with the
statistics of all documents, and fills window after window: a window begins with what is left of a
cut document, or the first unused one; the index ranks the unused documents of the shard for it, and
they follow, best first, until the window is full. The document at a window's end is cut there. What
is left at a shard's end is cut at powers of two, so no sequence needs padding.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.kneser_ney import looked_up, mapped_folder, saved, shard_of
from corpusloom.llm.shingles import mixed
from corpusloom.llm.tables import stage, staging_folder
from corpusloom.llm.tokens import TermHashes, word_tokenizer

WINDOW = 4096
END = 2
K1, B = 1.2, 0.75
SHARD_BYTES, SHARD_ROWS = 4 << 20, 8192
#: Terms of a file of statistics.
FILE_TERMS = 1 << 20
#: Of a document: a hash of the row, the text's bytes, its ids and the end id, and a bit for each id: whether a
#: word begins there, and whether it is of a word.
IDS = "ids binary, begins binary, inner binary"
SPLIT = f"doc_id long, row long, bytes long, {IDS}"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long, ids binary"
)


@dataclass(frozen=True)
class Statistics:
    """Counts over all documents, and where those of terms are."""

    folder: str
    files: int
    n: int
    mean: float  # terms of a document, repeated ones too

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In how many documents each of the hashed ``terms`` is, and their bytes."""
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where = shard_of(terms.view(np.uint64), self.files)
        found = looked_up(self.folder, "terms", "documents", terms.view(np.uint64), where, 2)
        # Terms of one document are not kept.
        return np.maximum(found[:, 0], 1), found[:, 1]

    def idf(self, df: np.ndarray) -> np.ndarray:
        return np.log1p((self.n - df + 0.5) / (df + 0.5))

    def weights(self, df: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """BM25 weights of terms in documents of ``sizes`` terms."""
        long = K1 * (1 - B + B * sizes / max(1.0, self.mean))
        # Whole numbers, so that sums do not depend on the order of terms.
        return np.rint(4096 * self.idf(df) * tf * (K1 + 1) / (tf + long))


def counted(terms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of each distinct term of each document, by document and term."""
    none = np.zeros(0, np.int64)
    found = [np.unique(t, return_counts=True) for t in terms]
    doc = np.repeat(np.arange(len(terms)), [len(t) for t, _ in found])
    return doc, np.concatenate([none, *[t for t, _ in found]]), np.concatenate([none, *[n for _, n in found]])


def split(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` (doc_id, text, not null) as ``SPLIT`` has them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokenizer(tokenizer)
        kind = encoder.id_type()
        try:
            for batch in batches:
                encoder.room()
                pieces = encoder.numbers(batch.column("text").cast(pa.string()))
                every = np.concatenate([np.zeros(0, np.int64), *pieces])
                cores, tails = encoder.counts(every)
                to = np.r_[0, np.cumsum(cores + tails)]
                ends = to[np.cumsum([len(p) for p in pieces], dtype=np.int64)]
                begins, inner = np.zeros(to[-1], bool), np.repeat(
                    np.tile([True, False], len(every)), np.stack([cores, tails], axis=1).ravel()
                )
                begins[to[:-1][cores > 0]] = True
                found = encoder.ids(every).astype(kind), begins, inner
                starts = np.r_[0, ends[:-1]].tolist()
                parts = [[x[a:b] for a, b in zip(starts, ends.tolist())] for x in found]
                end = np.array([END], kind).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(name) for name in ("doc_id", "row", "bytes")),
                        pa.array([x.tobytes() + end for x in parts[0]], pa.binary()),
                        *(pa.array([np.packbits(x).tobytes() for x in y], pa.binary()) for y in parts[1:]),
                    ],
                    ["doc_id", "row", "bytes", "ids", "begins", "inner"],
                )
        finally:  # the worker lives on, what it remembers of these texts does not
            encoder.forget()
            pa.default_memory_pool().release_unused()

    rows = docs.select(
        "doc_id",
        "text",
        F.xxhash64("doc_id", "text").alias("row"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    return rows.mapInArrow(encode, SPLIT)


def terms_of(ids: list[np.ndarray], begins: list[bytes], inner: list[bytes]) -> list[np.ndarray]:
    """Hashes of the terms of documents, from their ``IDS``."""
    none = np.zeros(0, np.uint8)
    start, word = (
        np.concatenate(
            [none, *(np.unpackbits(np.frombuffer(x, np.uint8), count=len(i) - 1) for x, i in zip(y, ids))]
        ).view(bool)
        for y in (begins, inner)
    )
    token = np.concatenate([none, *(i[:-1] for i in ids)])[word]
    first = np.flatnonzero(start[word])
    sizes = np.diff(first, append=len(token))
    hashes = np.zeros(len(first), np.uint64)
    at, left = first, slice(None)
    for place in range(sizes.max(initial=0)):
        if place:  # the words that go on
            left = np.flatnonzero(sizes > place) if place == 1 else left[sizes[left] > place]
            at = first[left] + place
        hashes[left] = (hashes[left] ^ mixed(token[at].astype(np.uint64) + np.uint64(1))) * _FACTOR
    # A document's words are those that begin in it.
    ends = np.cumsum([len(i) - 1 for i in ids], dtype=np.int64)
    cuts = np.searchsorted(np.flatnonzero(start), ends)
    return np.split(mixed(hashes).view(np.int64), cuts)[: len(ids)]


def statistics(docs: DataFrame) -> Statistics:
    """Count the terms of ``docs`` (text, not null) by the hashes of ``TermHashes``."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        hashes = TermHashes()
        for batch in batches:
            found = hashes.of(batch.column("text").cast(pa.string()))
            yield batch.column("bytes").to_numpy(), found

    return statistics_of(docs.select("text", F.octet_length("text").cast("long").alias("bytes")), terms)


def statistics_of(docs: DataFrame, terms) -> Statistics:
    """Count terms and write those that several documents have. ``terms`` makes of batches of ``docs``
    the bytes of each batch's documents, and their terms.
    """
    folder = f"{mapped_folder(docs.sparkSession)}/terms-{uuid.uuid4().hex}"
    os.makedirs(folder)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, long = 0, 0
        for held, found in terms(batches):
            n += len(found)
            long += sum(map(len, found))
            doc, term, _ = counted(found)
            names, at = np.unique(term, return_inverse=True)
            df, size = np.bincount(at, minlength=len(names)), np.bincount(at, held[doc], len(names))
            yield counts(pa.array(names), df, size.astype(np.int64))
        yield counts(pa.array([None], pa.int64()), [n], [long])

    def counts(names: pa.Array, df, held) -> pa.RecordBatch:
        columns = [names, pa.array(df, pa.int64()), pa.array(held, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["term", "df", "bytes"])

    sums = stage(
        docs.mapInArrow(count, "term long, df long, bytes long")
        .groupBy("term")
        .agg(F.sum("df").alias("df"), F.sum("bytes").alias("bytes"))
        .filter("term IS NULL OR df > 1")
    )
    size = sums.agg(F.count("term").alias("terms")).first()["terms"]
    files = max(1, -(-size // FILE_TERMS))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            file = shard_of(batch["term"].to_numpy(np.int64).view(np.uint64), files)
            yield batch.assign(file=file.astype(np.int32))

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        term = rows["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(term)
        saved(folder, f"terms-{key[0]}", term[order])
        saved(folder, f"documents-{key[0]}", rows[["df", "bytes"]].to_numpy(np.int64)[order])
        return pd.DataFrame({"n": [len(rows)]})

    placed = sums.filter("term IS NOT NULL").mapInPandas(
        place, "term long, df long, bytes long, file int"
    )
    placed.groupBy("file").applyInPandas(write, "n long").agg(F.sum("n")).first()
    total = sums.filter("term IS NULL").first()
    n, long = (total["df"], total["bytes"]) if total else (0, 0)
    return Statistics(folder, files, n, long / max(1, n))


def places(
    terms: list[np.ndarray],
    rows: np.ndarray,
    known: Statistics,
    shards: int,
    most: tuple[int, int],
) -> np.ndarray:
    """The shard of each document, given its hashed terms and a hash of the row; ``most`` is the
    bytes and rows of a shard.
    """
    sizes = np.array([len(t) for t in terms], np.int64)
    doc, term, tf = counted(terms)
    names, at = np.unique(term, return_inverse=True)
    df, held = (x[at] for x in known.of(names))
    weight = known.weights(df, tf, sizes[doc])
    parts = np.maximum(-(-held // most[0]), -(-df // most[1]))
    fits = (2 * held <= most[0]) & (2 * df <= most[1])
    # The best of a document: one that fits, heavier, of a smaller hash.
    shared = np.flatnonzero(df > 1)
    value = fits[shared] * 2.0**40 + weight[shared]
    begins = np.flatnonzero(np.diff(doc[shared], prepend=-1))
    most_of = np.maximum.reduceat(value, begins) if len(begins) else value
    top = shared[value == np.repeat(most_of, np.diff(np.r_[begins, len(shared)]))]
    best = top[np.flatnonzero(np.diff(doc[top], prepend=-1))]
    key = rows.view(np.uint64).copy()
    part = np.where(fits[best], 0, mixed(key[doc[best]]) % np.maximum(parts[best], 1).astype(np.uint64))
    key[doc[best]] = mixed(term[best].view(np.uint64)) + part.astype(np.uint64)
    return shard_of(key, shards)


class Index:
    """BM25 postings of a shard: by term, the documents and the weight of the term in each.

    ``known`` are statistics of more documents, by which ``terms`` are hashes, or else the shard's.
    """

    def __init__(self, terms: list[np.ndarray], known: Statistics | None = None):
        n = self.n = len(terms)
        sizes = np.array([len(t) for t in terms], np.int64)
        doc, term, tf = counted(terms)
        # Postings by term; within a term their order does not matter.
        order = np.argsort(term)
        begins = np.diff(term[order], prepend=-1) != 0
        if len(order):
            begins[0] = True
        self.begins = np.flatnonzero(begins)
        self.df = np.diff(self.begins, append=len(order))
        number = np.cumsum(begins) - 1
        of_all = known.of(term[order[self.begins]])[0] if known else self.df
        known = known or Statistics("", 0, n, sizes.mean())
        self.docs = doc[order].astype(np.int32)
        self.weights = known.weights(of_all[number], tf[order], sizes[self.docs])
        dense = np.empty(len(order), np.int64)
        dense[order] = number
        # The terms of each document, without those of one document only.
        met = self.df[dense] > 1
        self.terms = dense[met]
        self.of = np.searchsorted(doc[met], np.arange(n + 1))

    def scores(self, doc: int) -> np.ndarray:
        """The weights of every document's terms that ``doc`` has too, summed."""
        terms = self.terms[self.of[doc] : self.of[doc + 1]]
        df = self.df[terms]
        ends = np.cumsum(df)
        at = np.repeat(self.begins[terms] - (ends - df), df) + np.arange(ends[-1] if len(df) else 0)
        return np.bincount(self.docs[at], self.weights[at], minlength=self.n)


def fill(lengths: np.ndarray, ranked, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents packed without padding.

    ``ranked(doc)`` gives documents, nearest first; used ones among them are passed over.
    """
    unused = np.ones(len(lengths), bool)
    sequence, room = 0, window
    tail: list[tuple[int, int, int]] = []  # of the window being filled
    first = 0

    def put(doc: int, start: int = 0):
        nonlocal sequence, room, tail
        length = int(lengths[doc])
        while start < length:
            n = min(room, length - start)
            tail.append((doc, start, n))
            start += n
            room -= n
            if room == 0:
                yield from lay(tail, [window], sequence)
                sequence, room, tail = sequence + 1, window, []
        unused[doc] = False

    while True:
        if tail:  # the rest of a cut document
            seed = tail[0][0]
        else:
            while first < len(lengths) and not unused[first]:
                first += 1
            if first == len(lengths):
                break
            seed = first
            yield from put(seed)
            if not tail:
                continue
        at = sequence
        near = ranked(seed)
        near = near[unused[near]]
        if not len(near):
            break
        # No more than the window can hold are taken before the next one gets its own seed.
        for doc in near:
            yield from put(int(doc))
            if sequence > at:
                break
    if tail:
        total = sum(n for _, _, n in tail)
        powers = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        yield from lay(tail, powers, sequence)


def lay(pieces: list[tuple[int, int, int]], sizes: list[int], sequence: int):
    """Cut pieces into sequences of just these sizes."""
    sizes, offset = list(sizes), 0
    for doc, start, length in pieces:
        while length:
            n = min(length, sizes[0] - offset)
            yield doc, start, n, sequence, offset
            start, length, offset = start + n, length - n, offset + n
            if offset == sizes[0]:
                sizes.pop(0)
                sequence, offset = sequence + 1, 0


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False):
    """Pieces of all ``docs`` (doc_id, text): see ``PIECES``; ``sequence_tokens`` is the length of
    the piece's sequence, and ``ids`` its little-endian 32-bit ids if ``with_ids``, else null.

    A null text is empty and has the end id only. Repeated rows are packed each on its own; rows
    of one doc_id are ordered by their ids. Other columns are ignored. An empty table has no pieces.
    The result depends on the rows only, not on their partitions. ``window`` is a power of two.
    The shared folder has to be one that workers can map files from.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    path = f"{staging_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    # Ids take as much room as the texts, and Spark's default would store them as they are.
    split(docs, tokenizer).write.option("compression", "zstd").parquet(path)
    docs = docs.sparkSession.read.schema(SPLIT).parquet(path)
    size = docs.agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).first()
    shards = max(1, -(-(size["b"] or 0) // SHARD_BYTES), -(-size["n"] // SHARD_ROWS))
    kind = word_tokenizer(tokenizer).id_type()

    def terms(batch) -> list[np.ndarray]:
        ids, begins, inner = (batch[name].to_pylist() for name in ("ids", "begins", "inner"))
        return terms_of([np.frombuffer(i, kind) for i in ids], begins, inner)

    def counted_terms(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch.column("bytes").to_numpy(), terms(batch)

    known = statistics_of(docs, counted_terms)
    most = SHARD_BYTES, SHARD_ROWS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = places(terms(batch), batch.column("row").to_numpy(), known, shards, most)
            names = ["doc_id", "ids", "begins", "inner"]
            columns = [pa.array(to.astype(np.int32)), *(batch.column(name) for name in names)]
            yield pa.RecordBatch.from_arrays(columns, ["shard", *names])

    def shard(number: int, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "ids"], kind="stable", na_position="first")
        found = [np.frombuffer(i, kind) for i in rows["ids"]]
        lengths = np.array([len(i) for i in found], np.int64)
        index = Index(terms_of(found, list(rows["begins"]), list(rows["inner"])), known)
        parts = list(
            fill(lengths, lambda d: np.argsort(-index.scores(d), kind="stable"), window)
        )
        parts.sort(key=lambda p: (p[0], p[1]))
        out = {name: [] for name in ("crc", "ids")}
        last, ids = -1, b""
        for doc, start, n, _, _ in parts:
            if doc != last:
                last = doc
                ids = found[doc].astype("<u4").tobytes()
            cut = ids[4 * start : 4 * (start + n)]
            out["crc"].append(zlib.crc32(cut))
            out["ids"].append(cut if with_ids else None)
        doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*parts))
        tokens = np.bincount(sequence, length).astype(np.int64)
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].array[doc],
                "start": start,
                "length": length,
                "ids_crc32": np.array(out["crc"], np.int64),
                "doc_tokens": lengths[doc],
                "sequence_id": (number << 32) + sequence,
                "offset": offset,
                "sequence_tokens": tokens[sequence],
                "ids": out["ids"],
            }
        )

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for at, rows in runs(batches, "shard"):
            yield shard(at, rows)

    placed = docs.mapInArrow(place, f"shard int, doc_id long, {IDS}")
    return placed.repartition("shard").sortWithinPartitions("shard").mapInPandas(packed, PIECES)


def runs(batches: Iterator[pd.DataFrame], by: str) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of each value of ``by``, one after another, of batches sorted by it."""
    at, waiting = None, []
    for batch in batches:
        for value, rows in batch.groupby(by):
            if waiting and value != at:
                yield int(at), pd.concat(waiting)
                waiting = []
            at = value
            waiting.append(rows)
    if waiting:
        yield int(at), pd.concat(waiting)
