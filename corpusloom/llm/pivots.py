"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors, thinned until no two are near one
another, so a dense region is one pivot. The inverted list of a pivot holds the vectors to which it
is the nearest (its members); a vector looks into the lists of its nearest few pivots, in their
order. All pairs that meet in a list are verified by their cosine in double precision.

Equal vectors are one class with a count. Lists are cut into chunks of bounded size and each pair of
chunks is a group of its own, in which pairs are counted and joined to trees; no pairs leave a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.graph import components, cut_lineage, lower_roots
from corpusloom.llm.vectors import matrix, usable

#: Lists looked into.
PROBED = 6
#: Bounds of the number of pivots; in between it is half the square root of the number of vectors.
LEAST, MOST = 32, 4096
#: Pivots have cosines below this; so many vectors are looked at for each pivot wanted.
APART, DRAWN = 0.65, 4
CHUNK = 2048


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label).

    Rows are linked when their labels are equal and their cosine is at least ``least``. n_links
    counts linked rows (repeated rows and copies each), component_id is the smallest vec_id that
    can be reached, kept tells whether that is the row's own. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows with a null label, link with nothing, as do
    vectors of different dimensions. Other columns are ignored; an empty table stays empty. Every
    link returned is verified; a pair of which neither looks into the other's list is missed.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") ** 2))
    good = vectors.filter(F.col("label").isNotNull() & usable(F.col("embedding"))).filter(norm > 0)
    classes = cut_lineage(
        good.groupBy("label", "embedding").agg(
            F.min("vec_id").alias("node"), F.count("*").alias("copies")
        ).withColumn("id", F.xxhash64("label", "embedding"))
    )
    size = classes.agg(
        F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")
    ).first()
    dims = size["dims"] or 1
    n_pivots = min(MOST, max(LEAST, int(size["n"] ** 0.5 / 2)))
    drawn = classes.orderBy(F.xxhash64("embedding"), "id").limit(DRAWN * n_pivots)
    drawn = unit(matrix(drawn.select("embedding").toPandas()["embedding"], dims))
    points = thinned(drawn, n_pivots)

    def describe(batches):
        for batch in batches:
            near = np.argsort(-(unit(matrix(batch["embedding"], dims)) @ points.T), axis=1)
            yield batch.assign(near=list(near[:, :PROBED].astype(np.int32)))

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in classes.schema)}"
    described = classes.mapInPandas(describe, f"{schema}, near array<int>").withColumn(
        "dims", F.size("embedding")
    )
    visits = described.select(
        "*", F.posexplode("near").alias("place", "cell")
    )
    visits = cut_lineage(visits)
    list_of = ["label", "dims", "cell"]
    chunks = visits.groupBy(*list_of).agg(
        F.ceil(F.sum((F.col("place") == 0).cast("int")) / CHUNK).alias("members"),
        F.ceil(F.count("*") / CHUNK).alias("visitors"),
    )
    placed = visits.join(chunks.filter("members > 0"), list_of)
    upto = lambda c: F.explode(F.sequence(F.lit(1), F.col(c)))
    at = lambda c: F.pmod(F.xxhash64("id"), F.col(c)) + 1
    members = placed.filter("place = 0").select(
        "*", at("members").alias("m"), upto("visitors").alias("v"), F.lit(True).alias("member")
    )
    visitors = placed.select(
        "*", at("visitors").alias("v"), upto("members").alias("m"), F.lit(False).alias("member")
    )
    groups = members.unionByName(visitors).drop("members", "visitors", "place")

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        return linked(rows, dims, least)

    found = cut_lineage(
        groups.groupBy(*list_of, "m", "v").applyInPandas(link, "id long, root long, links long")
    )
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = classes.join(links, "id", "left").join(
        joined.select(F.col("node").alias("id"), "component"), "id", "left"
    )
    named = cut_lineage(named.withColumn("component", F.coalesce("component", "id")))
    smallest = named.groupBy("component").agg(F.min("node").alias("component_id"))
    named = named.join(smallest, "component").select(
        F.col("label").alias("l"),
        F.col("embedding").alias("e"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "component_id",
    )
    same = (vectors["label"] == named["l"]) & (vectors["embedding"] == named["e"])
    return vectors.select("vec_id", "label", "embedding").join(named, same, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1), 1e-300)[:, None]


def thinned(rows: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` rows that are not near an earlier one of them."""
    out, n = np.zeros((min(most, len(rows)), rows.shape[1])), 0
    for row in rows:
        if n == len(out):
            break
        if not n or (out[:n] @ row).max() < APART:
            out[n], n = row, n + 1
    return out[:n]


def linked(rows: pd.DataFrame, dims: int, least: float) -> pd.DataFrame:
    """Counts of links of a group's rows, and the smallest id that their links reach in it.

    A pair of members is counted for each of the two when it visits. A visitor from another list
    is counted for both, in one list only: if each looks into the other's list, the pair belongs to
    the list of the smaller pivot.
    """
    home = rows[rows["member"]].reset_index(drop=True)
    guest = rows[~rows["member"]].reset_index(drop=True)
    if not len(home) or not len(guest):
        return pd.DataFrame({"id": [], "root": [], "links": []}).astype(np.int64)
    cell = int(rows["cell"].iloc[0])
    h, g = (unit(matrix(x["embedding"], dims)) for x in (home, guest))
    h_near, g_near = (np.stack(list(x["near"])) for x in (home, guest))
    h_id, g_id = (x["id"].to_numpy(np.int64) for x in (home, guest))
    ids, where = np.unique(np.r_[h_id, g_id], return_inverse=True)
    h_at, g_at = where[: len(h_id)], where[len(h_id) :]
    h_n, g_n = (x["copies"].to_numpy(np.int64) for x in (home, guest))
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    foreign = g_near[:, 0] != cell
    for i in range(0, len(g), 256):
        # The product rounds by its block's shape; near the threshold a pair is computed by itself.
        a, b = np.nonzero(g[i : i + 256] @ h.T >= least - 1e-9)
        a += i
        away = foreign[a]
        back = (h_near[b] == g_near[a, :1]).any(axis=1) & (g_near[a, 0] < cell)
        keep = (g_id[a] != h_id[b]) & ~(away & back)
        a, b, away = a[keep], b[keep], away[keep]
        close = np.einsum("ij,ij->i", g[a], h[b]) >= least
        a, b, away = a[close], b[close], away[close]
        np.add.at(links, g_at[a], h_n[b])
        np.add.at(links, h_at[b[away]], g_n[a[away]])
        lower_roots(root, g_at[a], h_at[b])
    some = links > 0
    return pd.DataFrame({"id": ids[some], "root": ids[root[some]], "links": links[some]})
