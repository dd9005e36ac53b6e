"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import staging_folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; Spark removes it when it is no longer used."""
    context = df.sparkSession.sparkContext
    folder = staging_folder(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected ``edges`` (a, b): component is the smallest node.

    Loops and repeated edges are allowed; null ends are passed over; no edges give no rows. A step
    hangs neighbours onto the smallest neighbour: minima are aggregates, combined before their
    shuffle, and a hub's edges are split by adaptive execution like any skewed join.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = cut_lineage(edges.distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        edges = cut_lineage(small.select("e.u", "e.v").filter("u <> v").distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def lower_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Bring the roots of nodes linked by (a, b) down to the smallest they reach, in place."""
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            deeper = root[root]
            if (deeper == root).all():
                break
            root[:] = deeper
        differ = root[a] != root[b]
        a, b = a[differ], b[differ]
