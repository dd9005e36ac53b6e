"""Conversation prefix trie: what conversations share, rolled up by centroid decomposition.

A node is a distinct sequence of first turns; it is known by the smallest conversation that starts
with it and its depth. Sequences are compared by a running XOR of two 64-bit hashes of (position, role and
text), taken in blocks of turns, so a conversation of any length is spread over tasks.

Sums over subtrees are taken without walking up the tree. A node's weight is the number of turns, its
own included, that its conversations still have: it is known from the turns alone and is the sum over
the subtree of the numbers of conversations. The nodes of a component that hold at least half of its
weight form a path from its top down to its centroid. In a round every component takes the totals of
all that stands below its centroid, adds them to the rest of that path, and falls apart into the part above
and the parts below, none with more than half of the weight. So a node is touched once in
each of log2(weight) rounds, however deep the tree or wide a node is.

Components of more nodes than a task takes are split by Spark in rounds of joins; all others are decomposed by
numpy where they are, many at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.numbering import row_numbers
from corpusloom.llm.tables import stage

#: Turns of a block, ids of a piece of a digest, nodes that a task decomposes at once.
BLOCK, PIECE, NODES = 4096, 4096, 1 << 16
NODE = ["m", "d"]  # smallest member, depth
PART = ["cm", "cd"]  # the component's top
STATE = [*NODE, "pm", *PART, "w", "leaf", "save", "more_leaf", "more_save"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, bytes): turns counted from 0, ordered by turn, role and text.

    Null turns come first, null roles and texts are empty, repeated rows are turns of their own, and rows
    without a conv_id are passed over. Texts go no further than this.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    rows = (
        conversations.filter(F.col("conv_id").isNotNull())
        .select("conv_id", "turn", role.alias("role"), text.alias("text"))
        .withColumns(
            {
                "digest": F.md5(framed.cast("binary")),
                "bytes": F.octet_length("text").cast("long"),
            }
        )
    )
    numbered = row_numbers(
        rows, ["conv_id", "turn", "role", "text"], "at", ["conv_id", "digest", "bytes"]
    )
    starts = numbered.groupBy("conv_id").agg(F.min("at").alias("start"))
    return numbered.join(starts, "conv_id").select(
        "conv_id", (F.col("at") - F.col("start")).alias("pos"), "digest", "bytes"
    )


def _with_prefix(turns: DataFrame) -> DataFrame:
    """Adds x1, x2 (the sequence up to a turn) and p1, p2 (up to the one before)."""
    hashed = turns.withColumns(
        {
            "g1": F.xxhash64(F.lit(1), "d", "digest"),
            "g2": F.xxhash64(F.lit(2), "d", "digest"),
            "block": F.floor((F.col("d") - 1) / BLOCK),
        }
    )
    here = W.partitionBy("conv_id", "block").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    blocks = hashed.filter(F.col("length") > BLOCK).groupBy("conv_id", "block").agg(
        F.bit_xor("g1").alias("b1"), F.bit_xor("g2").alias("b2")
    )
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(
        "conv_id", "block", F.bit_xor("b1").over(before).alias("b1"), F.bit_xor("b2").over(before).alias("b2")
    )
    running = hashed.withColumns({"x1": F.bit_xor("g1").over(here), "x2": F.bit_xor("g2").over(here)})
    joined = running.join(carried, ["conv_id", "block"], "left")
    add = lambda x, b: F.col(x).bitwiseXOR(F.coalesce(b, F.lit(0)))
    whole = joined.withColumns({"x1": add("x1", "b1"), "x2": add("x2", "b2")})
    return whole.select(
        "conv_id", "d", "length", "bytes", "x1", "x2",
        F.col("x1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("g2")).alias("p2"),
    )


def _digests(ends: DataFrame) -> DataFrame:
    """(m, d, ends_sha256) of (conv_id, m, d): ids in ascending order, joined by commas.

    Ids are joined in pieces of a range of ids each; a node's pieces pass through one task as a stream, since
    the digest is sequential by its nature.
    """
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = (
        ends.withColumn("piece", F.floor(F.col("conv_id") / PIECE))
        .groupBy(*NODE, "piece")
        .agg(F.array_join(ids, ",").alias("ids"))
    )

    def digest(batches):
        node = state = None
        m, d, out = [], [], []
        for batch in batches:
            for *now, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    m.append(node[0]), d.append(node[1]), out.append(state.hexdigest())
                node, state = now, hashlib.sha256(ids.encode())
            yield _batch(m, d, out)
            m, d, out = [], [], []
        if node is not None:
            yield _batch([node[0]], [node[1]], [state.hexdigest()])

    def _batch(m, d, out):
        return pa.RecordBatch.from_arrays(
            [pa.array(m, pa.int64()), pa.array(d, pa.int64()), pa.array(out, pa.string())],
            [*NODE, "ends_sha256"],
        )

    return (
        pieces.repartition(*NODE)
        .sortWithinPartitions(*NODE, "piece")
        .select(*NODE, "ids")
        .mapInArrow(digest, "m long, d long, ends_sha256 string")
    )


def decompose(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (kinds x nodes) over subtrees of a forest, by centroid decomposition.

    ``parent`` is -1 for a top; ``weight`` is the weight of a node's subtree.
    """
    n = len(parent)
    nodes, added, result = np.arange(n), np.zeros_like(values), np.zeros_like(values)
    weight = weight.copy()
    top = _ends(np.where(parent < 0, nodes, parent), nodes)
    alive = nodes
    while len(alive):
        part, up = top[alive], parent[alive]
        heavy = 2 * weight[alive] >= weight[part]
        path = alive[heavy]
        path = path[np.argsort(depth[path], kind="stable")]
        centroid = np.full(n, -1)
        centroid[top[path]] = path  # of nodes of one component the last, which is the deepest
        mid = centroid[part]
        ends = nodes.copy()
        ends[alive] = np.where((alive == part) | (alive == mid) | (up == mid), alive, up)
        new = _ends(ends, alive)[alive]
        below = (alive == mid) | (parent[new] == mid)
        totals = np.zeros_like(values)
        for kind in range(len(values)):
            np.add.at(totals[kind], part[below], values[kind, alive[below]])
        above = heavy & (alive != mid)
        added[:, alive[above]] += totals[:, part[above]]
        weight[alive[above]] -= weight[mid[above]]
        gone = alive == mid
        result[:, alive[gone]] = added[:, alive[gone]] + totals[:, part[gone]]
        top[alive] = new
        alive = alive[~gone]
    return result


def _ends(pointer: np.ndarray, moving: np.ndarray) -> np.ndarray:
    """Follow pointers to their ends, doubling the steps."""
    while True:
        further = pointer[pointer[moving]]
        if (further == pointer[moving]).all():
            return pointer
        pointer[moving] = further


def _parents(m, d, pm, cm, cd) -> np.ndarray:
    """Places of parents within the same component; -1 for its top."""
    ids, code = np.unique(m, return_inverse=True)
    deep = int(d.max()) + 1
    keys = code * deep + d
    order = np.argsort(keys)
    own = (m != cm) | (d != cd)
    wanted = np.searchsorted(ids, pm[own]) * deep + d[own] - 1
    parent = np.full(len(m), -1)
    parent[own] = order[np.searchsorted(keys, wanted, sorter=order)]
    return parent


def _decomposed(state: DataFrame, at_least: int = 1 << 18) -> DataFrame:
    """(m, d, n_leaves, saved_tokens) of components that fit a task, some at a time."""

    def roll(batches):
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size < at_least:
                continue
            table = pa.Table.from_batches(waiting).combine_chunks()
            cm, cd = table["cm"].to_numpy(), table["cd"].to_numpy()
            changes = np.flatnonzero((np.diff(cm) != 0) | (np.diff(cd) != 0))
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if cut:
                yield solve(table.slice(0, cut))
            waiting, size = table.slice(cut).to_batches(), len(table) - cut
        if size:
            yield solve(pa.Table.from_batches(waiting))

    def solve(table: pa.Table) -> pa.RecordBatch:
        m, d, pm, cm, cd, w, *rest = (table[c].to_numpy() for c in STATE)
        leaf, save, more_leaf, more_save = rest
        sums = decompose(_parents(m, d, pm, cm, cd), d, w, np.stack([leaf, save]))
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (m, d, sums[0] + more_leaf, sums[1] + more_save)],
            [*NODE, "n_leaves", "saved_tokens"],
        )

    return (
        state.repartition(*PART)
        .sortWithinPartitions(*PART)
        .select(*STATE)
        .mapInArrow(roll, "m long, d long, n_leaves long, saved_tokens long")
    )


def _rollup(state: DataFrame, ancestors: DataFrame, nodes: int) -> DataFrame:
    """(m, d, n_leaves, saved_tokens) of all nodes.

    ``ancestors`` is (conv_id, d, m, pm): the node that a conversation passes at a depth, and that
    node's parent. Large components are fewer than all nodes / ``nodes``, so what is known of each is broadcast.
    """
    finished = []
    while True:
        parts = state.groupBy(*PART).agg(F.count("*").alias("n"), F.max("w").alias("total"))
        large = stage(parts.filter(F.col("n") > nodes).select(*PART, "total"))
        if not large.head(1):
            finished.append(_decomposed(state))
            break
        finished.append(_decomposed(state.join(F.broadcast(large), PART, "left_anti")))
        inside = state.join(F.broadcast(large), PART)
        heavy = 2 * F.col("w") >= F.col("total")
        centroids = stage(
            inside.filter(heavy)
            .groupBy(*PART)
            .agg(F.max("d").alias("zd"), F.max_by(F.struct("m", "w"), "d").alias("z"))
            .select(*PART, "zd", F.col("z.m").alias("zm"), F.col("z.w").alias("zw"))
        )
        passed = ancestors.select(
            F.col("conv_id").alias("m"),
            (F.col("d") - 1).alias("zd"),
            F.col("m").alias("km"),
            F.col("pm").alias("kp"),
        )
        marked = inside.withColumn("heavy", heavy).join(F.broadcast(centroids), PART)
        # A node stands below the centroid if its conversation passes it higher up.
        deeper, rest = marked.filter("d > zd"), marked.filter("d <= zd")
        looked = deeper.join(passed, ["m", "zd"], "left").withColumn(
            "below", F.coalesce(F.col("kp") == F.col("zm"), F.lit(False))
        )
        none = F.lit(None).cast("long")
        marked = stage(
            looked.unionByName(
                rest.withColumns({"km": none, "kp": none, "below": F.lit(False)})
            ).withColumn("centroid", (F.col("m") == F.col("zm")) & (F.col("d") == F.col("zd")))
        )
        totals = stage(
            marked.filter("below OR centroid")
            .groupBy(*PART)
            .agg(F.sum("leaf").alias("sum_leaf"), F.sum("save").alias("sum_save"))
        )
        known = marked.join(F.broadcast(totals), PART).withColumn(
            "above", F.col("heavy") & ~F.col("centroid")
        )
        finished.append(
            known.filter("centroid").select(
                *NODE,
                (F.col("more_leaf") + F.col("sum_leaf")).alias("n_leaves"),
                (F.col("more_save") + F.col("sum_save")).alias("saved_tokens"),
            )
        )
        only = lambda c: F.when(F.col("above"), F.col(c)).otherwise(0)
        state = stage(
            known.filter("NOT centroid").select(
                *NODE,
                "pm",
                F.when(F.col("below"), F.col("km")).otherwise(F.col("cm")).alias("cm"),
                F.when(F.col("below"), F.col("zd") + 1).otherwise(F.col("cd")).alias("cd"),
                (F.col("w") - only("zw")).alias("w"),
                "leaf",
                "save",
                (F.col("more_leaf") + only("sum_leaf")).alias("more_leaf"),
                (F.col("more_save") + only("sum_save")).alias("more_save"),
            )
        )
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def prefix_nodes(turns: DataFrame, conversations: DataFrame, nodes: int = NODES) -> DataFrame:
    """One row per node of the trie of ``turns``.

    ``turns`` is (conv_id, d, length, digest, bytes): d counts the turns of a conversation from 1 to its
    length without a gap, digest tells turns apart. ``conversations`` is (conv_id, length), each id once;
    conversations without turns are members of the root. Returns long conv_id (smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes of the subtree),
    saved_tokens (sum over the subtree of (n_convs - 1) * bytes) and string ends_sha256 (of the sorted ids of
    conversations that end there). Without conversations there are no nodes.
    """
    paths = stage(_with_prefix(turns))
    first, many, weight = conversations.agg(
        F.min("conv_id"), F.count("*"), F.sum(F.col("length") + 1)
    ).first()
    spark = turns.sparkSession
    root = spark.createDataFrame(
        [(first, 0, None, many, weight, 0)] if many else [],
        "m long, d long, pm long, n_convs long, w long, bytes long",
    )
    found = stage(
        paths.groupBy("d", "x1", "x2").agg(
            F.min("conv_id").alias("m"),
            F.count("*").alias("n_convs"),
            F.sum(F.col("length") - F.col("d") + 1).alias("w"),
            F.min("bytes").alias("bytes"),
            F.min("p1").alias("p1"),
            F.min("p2").alias("p2"),
        )
    )
    above = found.select((F.col("d") + 1).alias("d"), F.col("x1").alias("p1"), F.col("x2").alias("p2"),
                         F.col("m").alias("pm"))
    deep = found.filter("d > 1").join(above, ["d", "p1", "p2"])
    flat = found.filter("d = 1").withColumn("pm", F.lit(first).cast("long"))
    columns = ["d", "x1", "x2", "m", "pm", "n_convs", "w", "bytes"]
    found = stage(deep.select(*columns).unionByName(flat.select(*columns)))
    key = ["d", "x1", "x2"]
    ancestors = stage(
        paths.select("conv_id", *key, "length")
        .join(found.select(*key, "m", "pm"), key)
        .select("conv_id", "d", "length", "m", "pm")
    )
    tree = found.drop("x1", "x2").unionByName(root)
    children = found.groupBy(F.col("pm").alias("m"), (F.col("d") - 1).alias("d")).agg(
        F.count("*").alias("n_children")
    )
    zero = F.lit(0).cast("long")
    top = {"cm": F.lit(first).cast("long"), "cd": zero}  # all nodes are one component at first
    tree = stage(
        tree.join(children, NODE, "left").withColumns(
            {"n_children": F.coalesce("n_children", zero), **top}
        )
    )
    state = tree.select(
        *NODE,
        F.coalesce("pm", zero).alias("pm"),
        *PART,
        "w",
        (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("save"),
        zero.alias("more_leaf"),
        zero.alias("more_save"),
    )
    rolled = _rollup(state, ancestors, nodes)
    ends = ancestors.filter("d = length").select("conv_id", *NODE).unionByName(
        conversations.filter("length = 0").select(
            "conv_id", F.lit(first).cast("long").alias("m"), zero.alias("d")
        )
    )
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        tree.join(rolled, NODE)
        .join(_digests(ends), NODE, "left")
        .select(
            F.col("m").alias("conv_id"),
            F.col("d").alias("depth"),
            F.col("pm").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", nobody).alias("ends_sha256"),
        )
    )
