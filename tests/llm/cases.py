"""Small tables with nulls, empty and long texts, repeats, and columns with clashing names."""

from __future__ import annotations

import random

import pandas as pd

CLASHING = "size long, target double, score double, n long, name string, key long, label string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "nu") for b in ("re", "so", "ti") for c in "bdfgklm"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([6, 30, 120, 400])) for _ in range(40)]
    near = []
    for text in base[:20]:  # copies with a few words changed, some of them too many
        words = text.split()
        for _ in range(rng.choice([0, 1, 2, 6])):
            words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    passage = prose(rng, 60)
    shared = [f"{passage} {prose(rng, 10)}" for _ in range(8)]
    odd = [None, "", "  \n\t ", "One", "one", "a b\x0bc", "été ÉTÉ x y", "!!! ???", "1 2 3"]
    return [*base, *near, *shared, *odd, base[0], base[0], prose(rng, 30_000)]


def documents(spark, rows: list[str | None] | None = None, ids: list | None = None):
    rows = texts() if rows is None else rows
    ids = list(range(len(rows))) if ids is None else ids
    made = [
        (i, t, ["en", "fr", None][k % 3], ["a", "b", "b", None][k % 4], 0, 1, 1.0, 1.0, 1, "x", 1, "y")
        for k, (i, t) in enumerate(zip(ids, rows, strict=True))
    ]
    return spark.createDataFrame(made, SCHEMA).repartition(3)


def rows_of(df) -> pd.DataFrame:
    return df.toPandas()
