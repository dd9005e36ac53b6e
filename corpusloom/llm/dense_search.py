"""Ranked lexical search by dense blocked BLAS multiplication.

The terms that the items ask for are the only ones that can add to a score. One pass over the texts
counts them: a document becomes its length and the numbers of its known terms, without texts. Then
items are cut into tiles, each with the vocabulary of its own items only; a task lays documents
out as dense tiles of impacts over that vocabulary and multiplies them with the tile of the items'
term weights, in float64. All numbers are whole; a vocabulary tile ends before the largest sum it could
give reaches 2^53, so every product is exact, and tiles are added as 64-bit integers. Of each product a
task keeps the k best rows of an item and all that tie with the last until ids have decided.

Only the weights of items (a block of bounded size at a time) go with the tasks; documents are neither
shuffled nor joined, and k rows of an item leave a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.tables import stage

#: Bytes of terms in a block of items; documents in a dense tile; items in a tile; terms in one.
BLOCK_BYTES, DOCS, ITEMS, TERMS = 8 << 20, 1024, 64, 2048
#: An impact is at most this, and sums below this are exact in float64.
IMPACT, EXACT = 1_000_000, 2**53
# Bytes of terms are ASCII letters (in lower case) and digits and all of other characters.
_LOWERED = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and other characters, A-Z in lower case.

    >>> terms(b"Ab-c1")
    [b'ab', b'c1']
    """
    return (text or b"").translate(_LOWERED).split()


def _term_rows(items: DataFrame) -> DataFrame:
    """(item_id, term, times), one row per different term of an item."""

    def cut(batches):
        for batch in batches:
            ids, words = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms(text)
                ids += [i] * len(found)
                words += found
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(words, pa.binary())], ["item_id", "term"]
            )

    rows = items.select("item_id", F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(cut, "item_id long, term binary")
    return rows.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def count_known(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, tfs): terms in all, and which of the ``known`` occur how often."""

    def count(batches):
        for batch in batches:
            lengths, sizes, found, often = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = terms(text)
                here = np.fromiter(
                    (i for i in map(known.get, words) if i is not None), np.int32
                )
                ids, times = np.unique(here, return_counts=True)
                lengths.append(len(words))
                sizes.append(len(ids))
                found.append(ids)
                often.append(times)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(ends), pa.array(_joined(x, np.int32)))
                for x in (found, often)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "ids", "tfs"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, ids array<int>, tfs array<int>")


def _joined(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype), *parts]).astype(dtype)


def document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each known term: a task sends a number for each term it met."""

    def add(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(df[met])], ["id", "df"])

    parts = counted.select("ids").mapInArrow(add, "id long, df long")
    out = np.zeros(size, np.int64)
    for row in parts.groupBy("id").agg(F.sum("df").alias("df")).collect():  # one for each term
        out[row["id"]] = row["df"]
    return out


@dataclass
class Tile:
    """Items of one tile over their own vocabulary, cut where sums might no longer be exact."""

    item_ids: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]  # term numbers, and weights (terms x items)


def item_tiles(
    item_ids: np.ndarray, at: np.ndarray, ids: np.ndarray, weights: np.ndarray,
    items: int = ITEMS, width: int = TERMS, exact: int = EXACT,
) -> list[Tile]:
    """Tiles of (item, term, weight) triples; ``at`` is the place of the item in ``item_ids``.

    A term whose weight alone could pass ``exact`` is split over several parts, and so are
    vocabularies: in any part the weights of an item add up to less than exact / IMPACT.
    """
    room = (exact - 1) // IMPACT
    tiles = []
    for first in range(0, len(item_ids), items):
        here = (at >= first) & (at < first + items)
        own, column = np.unique(ids[here], return_inverse=True)
        left = np.zeros((len(own), min(items, len(item_ids) - first)), np.int64)
        np.add.at(left, (column, at[here] - first), weights[here])
        parts = []
        while left.any():
            used, start = left.any(axis=1).nonzero()[0], 0
            for end in range(1, len(used) + 1):
                rows = used[start:end]
                if end < len(used) and end - start < width:
                    if left[used[start : end + 1]].sum(axis=0).max() <= room:
                        continue
                taken = np.minimum(left[rows], room)
                parts.append((own[rows], taken.astype(np.float64)))
                left[rows] -= taken
                start = end
        tiles.append(Tile(item_ids[first : first + items], parts))
    return tiles


class _Best:
    """The k best rows so far of each item of a tile."""

    def __init__(self, tile: Tile, k: int):
        self.k, self.score = k, [np.empty(0, np.int64)] * len(tile.item_ids)
        self.doc = list(self.score)
        self.floor = np.ones(len(tile.item_ids), np.int64)

    def take(self, docs: np.ndarray, scores: np.ndarray) -> None:
        k = self.k
        floor = self.floor
        if len(docs) > k:  # a score below the k-th best of the tile cannot enter; ties can
            floor = np.maximum(floor, np.partition(scores, len(docs) - k, axis=0)[len(docs) - k])
        for i in np.flatnonzero((scores >= floor).any(axis=0)):
            rows = np.flatnonzero(scores[:, i] >= floor[i])
            score = np.concatenate([self.score[i], scores[rows, i]])
            doc = np.concatenate([self.doc[i], docs[rows]])
            best = np.lexsort([doc, -score])[:k]
            self.score[i], self.doc[i] = score[best], doc[best]
            if len(best) == k:
                self.floor[i] = score[best[-1]]


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _ranked(counted: DataFrame, tiles: list[Tile], size: int, N: int, L: int, k: int) -> DataFrame:
    def search(batches):
        best = [_Best(tile, k) for tile in tiles]
        places = []
        for tile in tiles:
            for ids, _ in tile.parts:
                place = np.full(size, -1, np.int32)
                place[ids] = np.arange(len(ids))
                places.append(place)
        for batch in batches:
            for first in range(0, batch.num_rows, DOCS):
                some = batch.slice(first, DOCS)
                docs = some.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                n = some.column(1).to_numpy()
                ids, tfs = (some.column(c).flatten().to_numpy() for c in (2, 3))
                sizes = np.diff(some.column(2).offsets.to_numpy())
                row = np.repeat(np.arange(len(docs)), sizes)
                m = 25 + (75 * n * N) // L
                impact = impacts(tfs.astype(np.int64), m[row]).astype(np.float64)
                which = iter(places)
                for tile, top in zip(tiles, best, strict=True):
                    scores = np.zeros((len(docs), len(tile.item_ids)), np.int64)
                    for own, weights in tile.parts:
                        column = next(which)[ids]
                        known = column >= 0
                        dense = np.zeros((len(docs), len(own)))
                        dense[row[known], column[known]] = impact[known]
                        scores += (dense @ weights).astype(np.int64)
                    top.take(docs, scores)
        for tile, top in zip(tiles, best, strict=True):
            many = [len(d) for d in top.doc]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(tile.item_ids, many)),
                    pa.array(_joined(top.doc, np.int64)),
                    pa.array(_joined(top.score, np.int64)),
                ],
                ["item_id", "doc_id", "score"],
            )

    # 75 * n * N must fit a long; the statistics are checked where they are known.
    found = counted.mapInArrow(search, "item_id long, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score"
    )


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0.

    ``docs`` is (doc_id, text), ``items`` is (item_id, text); other columns are ignored. Ties go to
    the smaller doc_id. Null and empty texts have no terms; they are neither ranked nor counted. Rows
    with a null doc_id count in the statistics and are never ranked; repeated rows are documents of their
    own. Rows with a null item_id are passed over; of several texts of an item the smallest counts.
    Statistics cover all documents and whole texts. Items are taken in blocks of about
    ``block_bytes`` of terms (an item is never cut), each with a pass over the texts.
    """
    asked = items.filter(F.col("item_id").isNotNull()).groupBy(F.col("item_id").cast("long").alias("item_id"))
    wanted = stage(_term_rows(asked.agg(F.min("text").alias("text"))))
    volume = wanted.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = -(-volume // block_bytes)
    out = None
    for b in range(blocks):
        block = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        found = _search_block(docs, block, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        empty = "item_id long, rank int, doc_id long, score long"
        return docs.sparkSession.createDataFrame([], empty)
    return out


def _search_block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    rows = block.orderBy("item_id", "term").toArrow()
    vocabulary = rows.column("term").to_pylist()
    known = {t: i for i, t in enumerate(sorted(set(vocabulary)))}
    ids = np.fromiter((known[t] for t in vocabulary), np.int64, len(vocabulary))
    item_ids, at = np.unique(rows.column("item_id").to_numpy(), return_inverse=True)
    counted = stage(count_known(docs, known))
    N, L, longest = counted.filter("n > 0").agg(
        F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))
    ).first()
    if 75 * longest * N >= 2**63:
        raise OverflowError("the longest document times the number of documents exceeds 64 bits")
    df = document_frequencies(counted, len(known))
    weight = np.array([math.floor(1000 * math.log((2 * N + 2) / (2 * d + 1))) for d in df.tolist()])
    times = rows.column("times").to_numpy()
    tiles = item_tiles(item_ids, at, ids, weight.astype(np.int64)[ids] * times)
    return _ranked(counted.filter("n > 0 AND doc_id IS NOT NULL"), tiles, len(known), N, L or 1, k)
