"""Interpolated modified Kneser-Ney bigram model over whole texts.

Counting. Tasks hash words to 64 bits, combine counts in blocks, and Spark shuffles them: words by
their hash, bigrams by their context (those of very frequent contexts by the bigram, so no context
has to fit one task). Each shard's reducer writes its sorted hash arrays as files.

Model. Arrays of sorted hashes with counts beside them, in the shared folder; nothing of it passes
through the driver but totals, discounts, and the bounded list of very frequent contexts.

Scoring. Workers map the files into memory and look up sorted batches of hashes; pages are shared by
all workers of a machine.

A text's tokens are its words and one end; the first word's context is a start. Unknown words share
the place of one unseen word, so probabilities given a context sum to one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shingles import mixed, word_hashes
from corpusloom.llm.tables import stage, staging_folder

#: Hashes of the end and the start of a text; words are not empty and are hashed without a seed.
END = np.uint64(xxhash.xxh3_64_intdigest(b""))
START = np.uint64(xxhash.xxh3_64_intdigest(b"", seed=1))
#: Tokens of a shard, tokens counted together, and tokens scored together: so many, or more in a model of
#: many shards, since a look-up goes through all of them.
SHARD_TOKENS, BLOCK, SCORED = 1 << 20, 3 << 20, 1 << 18
SCORED_A_SHARD, MOST_SCORED = 1 << 10, 1 << 20
#: Files that a worker keeps mapped, six a shard; a process may have 65,530.
MAPS = 60_000
#: A context this frequent, and more than one token in 65,536, is spread over all shards.
FREQUENT = 1 << 18


def mapped_folder(spark) -> str:
    """The shared folder as a path that workers can map files from."""
    folder = staging_folder(spark)
    if folder.startswith("file:"):
        return "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        raise ValueError(f"files in {folder} cannot be mapped: name a mounted shared folder")
    return folder


def tokens(text: str | None) -> np.ndarray:
    return np.append(word_hashes(text), END)


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts and tokens of texts, some millions at a time."""
    waiting, size = [], 0
    for batch in batches:
        for text in batch["text"]:
            waiting.append(tokens(text))
            size += len(waiting[-1])
            if size >= BLOCK:
                both, waiting, size = with_context(waiting), [], 0
                yield both
    if size:
        yield with_context(waiting)


def with_context(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each token's context, and the tokens."""
    after = np.concatenate(texts)
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[np.cumsum([0, *[len(t) for t in texts[:-1]]])] = START
    return before, after


def combined(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their counts summed."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else order
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and for every key its number among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]][: len(keys)]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


def bigram(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + after)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((mixed(hashes) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted ``among``."""
    return find(values, among)[1]


def find(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in the sorted ``among``, and whether it is there."""
    if not len(among):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return at, among[at] == values


def placed(before: np.ndarray, keys: np.ndarray, frequent: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each bigram: its context's, or its own if the context is very frequent."""
    return shard_of(np.where(member(before, frequent), keys, before), shards)


def saved(folder: str, name: str, array: np.ndarray) -> None:
    """Written under another name first, so that a task that is tried again leaves whole files."""
    temporary = f"{folder}/.{name}-{uuid.uuid4().hex}.npy"
    np.save(temporary, array)
    os.replace(temporary, f"{folder}/{name}.npy")


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that hold for all of them."""

    folder: str
    shards: int
    tokens: int  # in training
    distinct: int
    texts: int
    types: int  # distinct bigrams
    low: tuple[float, float, float]  # discounts of continuation counts of 1, 2, 3 and more
    high: tuple[float, float, float]  # of bigram counts
    low_left: float  # what the unseen word shares with all others
    frequent: tuple[np.ndarray, np.ndarray]  # contexts, and how many words followed 1, 2, 3+ times

    def discount(self, counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
        return np.array([0.0, *by])[np.minimum(counts, 3)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many counts are 1, 2, 3 and 4. Where one of these is
    missing (tiny corpora), half of the count.
    """
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    found = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return tuple(min(max(d, 0.0), k + 1.0) for k, d in enumerate(found))


def train(docs: DataFrame) -> Model:
    """Count ``docs`` (text; null is empty) and write the model. Without rows it knows no word."""
    spark = docs.sparkSession
    folder = f"{mapped_folder(spark)}/model-{uuid.uuid4().hex}"
    os.makedirs(folder)
    texts = docs.select("text")

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, after in blocks(batches):
            word, n = np.unique(after, return_counts=True)
            yield pd.DataFrame({"word": word.view(np.int64), "n": n})

    words = stage(
        texts.mapInPandas(count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    )
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_tokens, distinct = total["n"] or 0, total["v"]
    shards = max(1, -(-n_tokens // SHARD_TOKENS))
    # At most 65,536 words.
    many = words.filter(F.col("n") > max(FREQUENT, n_tokens >> 16)).select("word").toPandas()
    # Each text has one start and one end; the start is always spread.
    frequent = np.sort(np.append(many["word"].to_numpy(np.int64).view(np.uint64), START))
    known = spark.sparkContext.broadcast(frequent)

    def count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for before, after in blocks(batches):
            keys = bigram(before, after)
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            n = np.diff(np.r_[first, len(keys)])
            keys, order = keys[first], order[first]
            before, after = before[order], after[order]
            # Rows of a context together take less room in the shuffle.
            order = np.argsort(before, kind="stable")
            before, after, n = before[order], after[order], n[order]
            shard = placed(before, keys[order], known.value, shards)
            del keys, order
            for i in range(0, len(n), 1 << 17):
                part = slice(i, i + (1 << 17))
                yield pd.DataFrame(
                    {
                        "shard": shard[part].astype(np.int32),
                        "before": before[part].view(np.int64),
                        "after": after[part].view(np.int64),
                        "n": n[part].astype(np.int32),
                    }
                )

    def write_pairs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        before = rows["before"].to_numpy(np.int64).view(np.uint64)
        after = rows["after"].to_numpy(np.int64).view(np.uint64)
        keys, first, back = np.unique(
            bigram(before, after), return_index=True, return_inverse=True
        )
        n = np.bincount(back, rows["n"].to_numpy()).astype(np.int64)
        saved(folder, f"pairs-{key[0]}", keys)
        saved(folder, f"counts-{key[0]}", n.astype(np.uint32))
        before, after = before[first], after[first]
        contexts, at = np.unique(before, return_inverse=True)
        followed = np.stack(
            [np.bincount(at[k], minlength=len(contexts)) for k in (n == 1, n == 2, n > 2)], 1
        )
        spread = member(contexts, known.value)
        saved(folder, f"contexts-{key[0]}", contexts[~spread])
        saved(folder, f"followed-{key[0]}", followed[~spread].astype(np.uint32))
        word, differ = np.unique(after, return_counts=True)
        parts = [
            _sums(0, word, differ),
            _sums(1, contexts[spread], *followed[spread].T),
            _sums(2, np.zeros(1, np.uint64), *[np.array([(n == k).sum()]) for k in (1, 2, 3, 4)]),
        ]
        return pd.concat(parts)

    sums = stage(
        texts.mapInPandas(count_pairs, "shard int, before long, after long, n int")
        .groupBy("shard")
        .applyInPandas(write_pairs, "kind int, name long, a long, b long, c long, d long")
        .groupBy("kind", "name")
        .agg(*[F.sum(x).alias(x) for x in "abcd"])
    )
    spread = sums.filter("kind = 1").orderBy("name").toPandas()
    names = spread["name"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    followed = spread[["a", "b", "c"]].to_numpy(np.float64)[order]
    of_pairs = sums.filter("kind = 2").select("a", "b", "c", "d").first() or (0, 0, 0, 0)

    continued = sums.filter("kind = 0").select(F.col("name").alias("word"), F.col("a").alias("m"))
    table = words.join(continued, "word", "left").select(
        "word", "n", F.coalesce("m", F.lit(0)).alias("m")
    )

    def place_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shard = shard_of(batch["word"].to_numpy(np.int64).view(np.uint64), shards)
            yield batch.assign(shard=shard.astype(np.int32))

    def write_words(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        word = rows["word"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(word)
        saved(folder, f"words-{key[0]}", word[order])
        saved(folder, f"seen-{key[0]}", rows[["n", "m"]].to_numpy(np.int64)[order])
        m = rows["m"].to_numpy()
        sizes = [int((m == k).sum()) for k in (1, 2, 3, 4)] + [int((m > 2).sum()), int(m.sum())]
        return pd.DataFrame([sizes], columns=list("abcdef"))

    written = table.mapInPandas(place_words, "word long, n long, m long, shard int")
    names_of = "a long, b long, c long, d long, e long, f long"
    of_words = written.groupBy("shard").applyInPandas(write_words, names_of)
    of = of_words.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "abcdef"]).first()
    low, types = discounts([of["a"], of["b"], of["c"], of["d"]]), of["f"]
    left = low[0] * of["a"] + low[1] * of["b"] + low[2] * of["e"]
    n_texts = words.filter(F.col("word") == int(END.astype(np.int64))).select("n").first()
    return Model(
        folder,
        shards,
        n_tokens,
        distinct,
        n_texts["n"] if n_texts else 0,
        types,
        low,
        discounts(list(of_pairs)),
        left / types if types else 1.0,
        (names[order], followed),
    )


def _sums(kind: int, name: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame({"kind": np.full(len(name), kind, np.int32), "name": name.view(np.int64)})
    for i, letter in enumerate("abcd"):
        out[letter] = columns[i].astype(np.int64) if i < len(columns) else 0
    return out


@lru_cache(maxsize=MAPS)
def _mapped(folder: str, name: str) -> np.ndarray | None:
    path = f"{folder}/{name}.npy"
    return np.load(path, mmap_mode="r").view(np.ndarray) if os.path.exists(path) else None


def looked_up(
    folder: str, keys: str, values: str, names: np.ndarray, shards: np.ndarray, width: int
) -> np.ndarray:
    """(names, width) numbers stored beside ascending ``names`` in their shards; zeros where there is none."""
    out = np.zeros((len(names), width), np.int64)
    few = len(shards) and shards.max() < 1 << 16  # numbers that are sorted by their digits
    order = np.argsort(shards.astype(np.uint16) if few else shards, kind="stable")
    names, shards = names[order], shards[order]
    starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(names) else []
    for begin, end in zip(starts, [*starts[1:], len(names)], strict=True):
        among = _mapped(folder, f"{keys}-{shards[begin]}")
        if among is not None and len(among):
            at, there = find(names[begin:end], among)
            found = _mapped(folder, f"{values}-{shards[begin]}")[at].reshape(-1, width)
            out[order[begin:end]] = np.where(there[:, None], found, 0)
    return out


def probabilities(model: Model, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
    """log10 p(after | before) by the model, and the count of ``after`` in training."""
    word, _, at = distinct(np.r_[after, before])
    seen = looked_up(model.folder, "words", "seen", word, shard_of(word, model.shards), 2)[at]
    (count, continued), total = seen[: len(after)].T, seen[len(after) :, 0].copy()
    total[before == START] = model.texts
    low = np.maximum(continued - model.discount(continued, model.low), 0) / max(model.types, 1)
    low += model.low_left / (model.distinct + 1)

    pair, first, back = distinct(bigram(before, after))
    shard = placed(before[first], pair, model.frequent[0], model.shards)
    n = looked_up(model.folder, "pairs", "counts", pair, shard, 1)[back, 0]

    before_another = np.zeros(len(word), bool)
    before_another[at[len(after) :]] = True
    context = word[before_another]
    back = (np.cumsum(before_another) - 1)[at[len(after) :]]
    followed = looked_up(
        model.folder, "contexts", "followed", context, shard_of(context, model.shards), 3
    ).astype(np.float64)
    place, spread = find(context, model.frequent[0])
    followed[spread] = model.frequent[1][place[spread]]
    left = (followed @ np.array(model.high))[back]

    high = np.maximum(n - model.discount(n, model.high), 0) + left * low
    p = np.where(total > 0, high / np.maximum(total, 1), low)
    return np.log10(p), count


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score (log10) to ``docs``.

    ``docs`` is doc_id, text and columns to pass on, none called like a new one. A null or empty
    text has one token, the end. Repeated rows and copies get equal scores; a null doc_id is
    passed on; an empty table stays empty. Whole texts are scored, some at a time.
    """
    others = [f for f in docs.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    schema += ", n_tokens long, n_known long, train_tokens long, base_score double, score double"
    together = min(max(SCORED, SCORED_A_SHARD * model.shards), MOST_SCORED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple] = []
            waiting: list[np.ndarray] = []
            size = 0
            for text in batch["text"]:
                waiting.append(tokens(text))
                size += len(waiting[-1])
                if size > together:
                    found += _scored(model, waiting)
                    waiting, size = [], 0
            found += _scored(model, waiting)
            numbers = pd.DataFrame(
                found, columns=["n_tokens", "n_known", "base_score", "score"], index=batch.index
            )
            yield batch.drop(columns="text").assign(train_tokens=model.tokens, **numbers)

    return docs.mapInPandas(run, schema)


def _scored(model: Model, texts: list[np.ndarray]) -> list[tuple]:
    if not texts:
        return []
    before, after = with_context(texts)
    log_p, count = probabilities(model, before, after)
    base = np.log10((count + 1) / (model.tokens + model.distinct + 1))
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    known, base, whole = (
        np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), base, log_p)
    )
    sizes = ends - starts
    return list(zip(sizes.tolist(), known.tolist(), base.tolist(), whole.tolist(), strict=True))
