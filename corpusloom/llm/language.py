"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over them, each filter's largest response in a
window is kept (max pooling), and a softmax over these says the language. The network is trained in
numpy on the driver, on a sample of windows whose size is bounded by parameters; it is then applied
to all windows of every whole text, in batches, and a text's prediction is the product of the
windows' probabilities, tempered by their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import column_like

WINDOW = 512
WIDTHS, FILTERS, DEPTH = (2, 3, 4, 5), 12, 8
#: Bounds of the training sample: rows of a language, windows of a row.
ROWS, WINDOWS = 600, 4
UNKNOWN = "und"
_BATCH = 256  # windows in a batch


@dataclass
class Network:
    """Weights of the network; ``languages`` are its classes in order."""

    languages: list[str]
    embedding: np.ndarray  # (256, depth)
    filters: dict[int, np.ndarray]  # width -> (width * depth, filters)
    bias: dict[int, np.ndarray]
    out: np.ndarray  # (widths * filters, languages)
    out_bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], rng: np.random.Generator) -> Network:
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            languages,
            f(256, DEPTH, scale=0.5),
            {w: f(w * DEPTH, FILTERS, scale=(w * DEPTH) ** -0.5) for w in WIDTHS},
            {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
            f(len(WIDTHS) * FILTERS, len(languages), scale=0.1),
            np.zeros(len(languages), np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        many = [a for w in WIDTHS for a in (self.filters[w], self.bias[w])]
        return [self.embedding, *many, self.out, self.out_bias]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, features): each filter's largest response, and where it stands.

        ``windows`` has a row of bytes for each window; byte 0 fills short ones.
        """
        n, length = windows.shape
        depth = self.embedding.shape[1]
        laid = np.zeros((n, (length + max(WIDTHS) - 1) * depth), np.float32)
        laid[:, : length * depth] = self.embedding[windows].reshape(n, -1)
        best, place = [], []
        for w in WIDTHS:
            seen = sliding_window_view(laid, w * depth, axis=1)[:, : length * depth : depth]
            heard = seen.reshape(-1, w * depth) @ self.filters[w]
            heard = heard.reshape(n, length, -1)
            at = heard.argmax(axis=1)
            best.append(np.take_along_axis(heard, at[:, None], 1)[:, 0] + self.bias[w])
            place.append(at)
        return np.concatenate(best, 1), np.concatenate(place, 1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        heard, _ = self.pooled(windows)
        return log_softmax(np.maximum(heard, 0) @ self.out + self.out_bias)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def train(
    windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 12, seed: int = 5
) -> Network:
    """Adam on the cross entropy; languages weigh alike whatever their number of windows."""
    rng = np.random.default_rng(seed)
    net = Network.new(languages, rng)
    weight = 1 / np.maximum(1, np.bincount(labels, minlength=len(languages)))
    weight = (weight / weight[labels].mean()).astype(np.float32)
    means = [np.zeros_like(a) for a in net.arrays()]
    squares = [np.zeros_like(a) for a in net.arrays()]
    step, size = 0, 64
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        order = rng.permutation(len(windows))
        for i in range(0, len(order), size):
            step += 1
            rows = order[i : i + size]
            grads = gradients(net, windows[rows], labels[rows], weight[labels[rows]])
            for a, g, m, s in zip(net.arrays(), grads, means, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    n, depth = len(x), net.embedding.shape[1]
    heard, place = net.pooled(x)
    active = np.maximum(heard, 0)
    p = np.exp(log_softmax(active @ net.out + net.out_bias))
    p[np.arange(n), y] -= 1
    p *= weight[:, None] / n
    back = (p @ net.out.T) * (heard > 0)  # (n, features)
    padded = np.concatenate([x, np.zeros((n, max(WIDTHS) - 1), x.dtype)], 1)
    inside = np.arange(padded.shape[1]) < x.shape[1]
    d_embedding = np.zeros_like(net.embedding)
    many = []
    for k, w in enumerate(WIDTHS):
        part = slice(k * FILTERS, (k + 1) * FILTERS)
        cols = place[:, part, None] + np.arange(w)  # where each filter's largest response stands
        seen = padded[np.arange(n)[:, None, None], cols]
        vectors = (net.embedding[seen] * inside[cols][..., None]).reshape(n, FILTERS, w * depth)
        b = back[:, part]
        many += [np.einsum("nfd,nf->df", vectors, b), b.sum(axis=0)]
        d_vectors = (b[:, :, None] * net.filters[w].T).reshape(n, FILTERS, w, depth)
        np.add.at(d_embedding, seen, d_vectors * inside[cols][..., None])
    return [d_embedding, *many, active.T @ p, p.sum(axis=0)]


def cut(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, and the number of windows of each; empty texts have one."""
    counts = np.array([max(1, -(-len(t) // window)) for t in texts], np.int64)
    joined = b"".join(t.ljust(int(c) * window, b"\0") for t, c in zip(texts, counts, strict=True))
    return np.frombuffer(joined, np.uint8).reshape(-1, window), counts


def sample(labelled: DataFrame, rows: int, windows: int, window: int = WINDOW) -> DataFrame:
    """(lang, bytes): up to ``windows`` windows of about ``rows`` rows of each language.

    Rows are chosen by a hash of their texts, at a rate that follows from the number of different
    texts among all rows (counted approximately, by a mergeable sketch), so that nothing has to be
    sorted or gathered and copies of one text are no more than that text.
    """
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    # At most one number for each language; a language is a short code.
    rates = {r["lang"]: min(1.0, rows / max(1, r["n"])) for r in counts.collect()}
    if not rates:
        return known.select("lang", F.encode("text", "utf-8").alias("bytes")).limit(0)
    pairs = [x for lang, rate in rates.items() for x in (F.lit(lang), F.lit(rate))]
    rate = F.create_map(*pairs)[F.col("lang")]
    chance = F.pmod(F.xxhash64("text", F.lit(window)), F.lit(1 << 20)) / (1 << 20)
    encoded = F.encode("text", "utf-8")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / window))
    spread = F.transform(
        F.sequence(F.lit(0), F.least(count, F.lit(windows)) - 1),
        lambda i: F.substring(
            encoded, (F.floor(i * count / F.least(count, F.lit(windows))) * window + 1).cast("int"),
            F.lit(window),
        ),
    )
    chosen = known.filter(chance < rate)
    # Chosen copies are one window; the limit only bounds what chance may choose too many.
    each = chosen.select("lang", F.explode(spread).alias("bytes")).distinct()
    return each.orderBy(F.xxhash64("bytes"), "bytes", "lang").limit(2 * rows * windows * len(rates))


def learn(
    labelled: DataFrame, rows: int = ROWS, windows: int = WINDOWS, window: int = WINDOW
) -> Network | None:
    """The network learned from ``labelled`` (text, lang); null texts and languages are passed
    over. None if nothing is left. The driver holds at most 2 * rows * windows windows of each
    language. Half of them are shortened, so that short texts are known too.
    """
    got = sample(labelled, rows, windows, window).toPandas()
    if got.empty:
        return None
    languages = sorted(set(got["lang"]))
    texts, labels = list(got["bytes"]), np.searchsorted(languages, got["lang"].to_numpy(str))
    rng = np.random.default_rng(3)
    short = [t[: int(window ** rng.uniform(0.3, 1))] for t in texts]
    x, _ = cut([bytes(t) for t in [*texts, *short]], window)
    return train(x, np.concatenate([labels, labels]), languages)


def predict(
    docs: DataFrame, net: Network | None, window: int = WINDOW, text: str = "text"
) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the prediction's probability) to ``docs``.

    Only the text is read. A null text, a text without a letter, or no network gives ``und`` and
    score 0. All columns stay; if one is called like a new one, the new one gets an underscore
    before its name. Repeated rows and copies get equal results. An empty table stays empty.
    Windows of long texts are handled in batches, so memory follows the longest text only.
    """
    predicted = column_like("lang_pred", docs.columns)
    score = column_like("score", [*docs.columns, predicted])
    names = [] if net is None else net.languages
    vote = _vote(net, window)
    voted = column_like("_vote", docs.columns)
    out = docs.withColumn(voted, F.when(has_letter(F.col(text)), vote(F.col(text))))
    which = F.col(voted)["language"]
    return out.withColumns(
        {
            predicted: F.coalesce(
                F.get(F.array(*[F.lit(n) for n in names]), which) if names else F.lit(None),
                F.lit(UNKNOWN),
            ),
            score: F.coalesce(F.col(voted)["score"], F.lit(0.0)),
        }
    ).drop(voted)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _vote(net: Network | None, window: int):
    @F.pandas_udf("language int, score double")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            encoded = [(t or "").encode() for t in texts]
            language = np.full(len(encoded), -1, np.int32)
            score = np.zeros(len(encoded))
            if net is not None:
                for part in _runs(encoded, window):
                    x, counts = cut(encoded[part], window)
                    logs = np.concatenate(
                        [
                            net.log_probabilities(x[i : i + _BATCH])
                            for i in range(0, len(x), _BATCH)
                        ]
                    )
                    starts = np.cumsum(counts) - counts
                    mean = np.add.reduceat(logs, starts) / np.sqrt(counts)[:, None]
                    p = np.exp(log_softmax(mean.astype(np.float64)))
                    language[part], score[part] = p.argmax(axis=1), p.max(axis=1)
            yield pd.DataFrame({"language": language, "score": np.clip(score, 0, 1)})

    return vote


def _runs(texts: list[bytes], window: int) -> Iterator[slice]:
    """Slices of texts with a few thousand windows, or one longer text."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > 4096 * window:
            yield slice(start, i)
            start, size = i, 0
        size += max(window, len(text))
    if start < len(texts):
        yield slice(start, len(texts))
