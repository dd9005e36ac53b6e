from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from corpusloom.llm import prefix_trie
from corpusloom.llm.queries_prefix_trie import rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, d long, bytes string, n_convs int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)


def slow_rebuilt(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(turns)] for c, turns in convs.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def slow_nodes(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p and q for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        out.add((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
            sum(1 for q in nodes if q and q[:-1] == path), len(leaves), saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def made_rows():
    rng = random.Random(3)
    rows = []
    for c in [*range(-12, 60), 1000, 1003]:
        start = rng.choice(["hello", "hi"])
        for t in range(rng.choice([0, 1, 3, 9, 14])):
            text = start if t == 0 else rng.choice(["yes", "no é", "", None])
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", None]), text))
    rows += [(7, 3, "user", "again")] * 4  # repeated rows are turns of their own
    rows += [(None, 1, "user", "nobody")] * 3
    rows += [(70 + 5 * i, t, "user", f"copy {t}") for i in range(30) for t in range(12)]
    rows += [(400, t, "user", "long") for t in range(60)]
    return rows


@pytest.mark.parametrize("nodes", [1 << 16, 6])
def test_equals_brute_force(spark, monkeypatch, nodes):
    """With few nodes in a task, Spark splits components; pieces and blocks are small, too."""
    if nodes == 6:
        monkeypatch.setattr(prefix_trie, "BLOCK", 5)
        monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = made_rows()
    got = prefix_trie.prefix_nodes(*rebuilt(conversations(spark, rows)), nodes=nodes)
    want = slow_nodes(slow_rebuilt(rows))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want)
    assert set(found) == want


def test_empty_and_null_tables(spark):
    for rows in ([(None, 1, "user", "a")], []):
        assert prefix_trie.prefix_nodes(*rebuilt(conversations(spark, rows))).count() == 0


def test_conversation_that_loses_all_its_turns_is_a_member_of_the_root(spark):
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    got = [tuple(r) for r in prefix_trie.prefix_nodes(*rebuilt(conversations(spark, rows))).collect()]
    digest = hashlib.sha256(str(c).encode()).hexdigest()
    assert got == [(c, 0, None, 1, 0, 1, 0, digest)]


@pytest.mark.parametrize("shape", ["random", "path", "star", "forest"])
def test_decomposition_of_forests(shape):
    rng = np.random.default_rng(5)
    n = 300
    parent = {
        "random": np.array([-1, *(rng.integers(0, i) for i in range(1, n))]),
        "path": np.arange(n) - 1,
        "star": np.array([-1] + [0] * (n - 1)),
        "forest": np.array([-1 if i % 40 == 0 else rng.integers(i - i % 40, i) for i in range(n)]),
    }[shape]
    values = rng.integers(0, 10**12, (2, n))
    depth, weight, want = np.zeros(n, int), rng.integers(1, 5, n), values.copy()
    for i in range(n):
        depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            want[:, parent[i]] += want[:, i]
            weight[parent[i]] += weight[i]
    assert (prefix_trie.decompose(parent, depth, weight, values) == want).all()
