"""Exact Jaccard join of shingle sets by pigeonhole over a partitioned universe.

Two sets of which the larger has r elements and whose similarity reaches the threshold differ in at
most H = r (1 - t) / t elements, whoever is the partner. The universe is hashed into segments, so
many that the sets of a size band fill more than H of them; a difference of D elements damages at
most D segments. A set walks its segments in an order that all sets of the band share and writes
signatures until it has gained H + c:

1. the segment's subset itself, gain 1 (subsets that hold frequent shingles only come last),
2. the one-deletion neighbourhood of a subset of two or more, gain 1 more, as it takes two
   differences to get past both,
3. subsets of frequent shingles only, and then their neighbourhoods.

The c-th segment on which two similar sets agree comes, in either's walk, after a gain of at most
D + c - 1 < H + c, so both have written it: similar sets share c signatures, and pairs that share
fewer are no candidates. c grows with the set, so passages that many documents share bring few
pairs. What a walk prefers follows costs: a subset is one row, a neighbourhood one row for each element, and a frequent subset
brings many candidates. Sets of fewer than 64 elements take every element for a segment.

Bands start at powers of two and are 8/3 wide (for t = 3/4), so every pair has a common band and a
set is in one or two of them.

Candidates are verified on the whole sets. In each bucket of equal signatures all members are first
compared with one of them, its pivot; buckets whose members are then in one component need nothing
more, so a large group of near copies costs its size, not its square. Sets in the other buckets fall
into families by the pivot they share most with; families whose sets meet in most of their pairs are
made one. A family (texts that are alike, but mostly below the threshold) is compared in blocks,
each pair of blocks in a task that returns trees; pairs of different families that share enough
signatures are verified one by one. The components are exactly
those of all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.graph import components, cut_lineage, lower_roots
from corpusloom.llm.shingles import WORDS, mixed, shingle_sets
from corpusloom.llm.tables import stage

#: Similarity as a fraction; the walk's bounds below follow from it.
SHARED, OF = 75, 100
SMALL_SETS = 64
#: A signature more to share for so many elements.
PER_SIGNATURE = 24
#: Bits of the filter that says which texts are read again.
BITS, PROBES = 1 << 22, 3
#: At most so many shingles are known as frequent; others only cost more candidates.
FREQUENT = 1 << 17
_BLOCK = 1 << 20  # shingles counted together
#: Sets of a family in a block, about, and their shingles; shingles that are compared at a time.
FAMILY_BLOCK, FAMILY_SHINGLES, _COLUMNS = 512, 1 << 18, 4096
#: How often a family is taken for that of the set it is named by.
JUMPS = 3
#: Pairs of sets in common buckets from which on it may pay to make one family of two.
MERGED = 4096


def bands(n: int) -> list[int]:
    """Exponents k of the bands [2^k, 2^k (1 + OF / SHARED) ...) that hold size ``n``."""
    k = n.bit_length() - 1
    return [k - 1, k] if k and SHARED * n < OF * (1 << k) else [k]


def signatures(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The keys that the walk of a set (sorted 63-bit hashes) writes, for all its bands."""
    n = len(shingles)
    need = (OF - SHARED) * n // SHARED + 1 + n // PER_SIGNATURE
    out = []
    for k in bands(n):
        # Most walks end before the set does. Elements of a segment stand together.
        load = n / ((4 << k) // 3) if (1 << k) >= SMALL_SETS else 0
        filled = -math.expm1(-load) / load if load else 1
        part = int(1.1 * need / filled) + 32
        keys, left = _walk(shingles, k, need, frequent, part)
        if left and part < n:
            keys, _ = _walk(shingles, k, need, frequent, n)
        out += keys
    return np.concatenate(out)


def _walk(shingles, k, need, frequent, part):
    """The keys of band ``k`` by the segments that the first ``part`` elements fill, and the gain
    that is missing then; less than the whole set is only good for subsets with rare shingles.
    """
    whole = part >= len(shingles)
    value = shingles[: part + 1]
    if (1 << k) < SMALL_SETS:
        segment = value
        starts = np.arange(len(value))
    else:
        segment = ((value >> np.uint64(31)) * np.uint64((4 << k) // 3)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    if not whole:  # the last segment may go on
        value, starts = value[: starts[-1]], starts[:-1]
    n = len(value)
    if not n:
        return [], need
    sizes = np.diff(np.r_[starts, n])
    rare = np.ones(n, bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)
        rare = frequent[at] != value
    many = np.add.reduceat(rare.astype(np.int64), starts)
    sums = np.add.reduceat(value, starts)
    names = segment[starts] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
    deletions = sizes > 1
    out = []
    for neighbourhood, chosen in (
        (False, many > 0),
        (True, deletions & (many > 1)),
        (False, many == 0),
        (True, deletions & (many <= 1)),
    ):
        if need <= 0:
            break
        walk = np.flatnonzero(chosen)[:need]
        need -= len(walk)
        if neighbourhood:
            each = np.repeat(walk, sizes[walk])
            within = np.arange(len(each)) - np.repeat(
                np.cumsum(sizes[walk]) - sizes[walk], sizes[walk]
            )
            out.append(mixed(sums[each] - value[starts[each] + within] + names[each]))
        else:
            out.append(mixed(sums[walk] + names[walk]))
        if not whole:
            break
    return out, need


def name_of(shingles: np.ndarray) -> int:
    """A name of the set; equal sets have equal names."""
    return np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())))


def _sets(batches: Iterator[pd.DataFrame], words: int):
    for batch in batches:
        yield from zip(batch["doc_id"], shingle_sets(batch["text"], words), strict=True)


def document_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows of two kinds: (0, doc_id, n, set) for each document, and (1, null, count, shingle) for
    shingles that several different sets of one block of documents share.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: dict[int, np.ndarray] = {}
        size = 0

        def shared() -> pd.DataFrame:
            value, count = np.unique(np.concatenate(list(block.values())), return_counts=True)
            value, count = value[count > 2].astype(np.int64), count[count > 2]
            return pd.DataFrame({"kind": 1, "doc_id": None, "n": count, "name": value})

        for batch in batches:
            rows = []
            for doc_id, s in _sets(iter([batch]), words):
                name = name_of(s) if len(s) else None
                rows.append((0, doc_id, len(s), name))
                if len(s) and name not in block:
                    block[name] = s
                    size += len(s)
                    if size > _BLOCK:
                        yield shared()
                        block.clear()
                        size = 0
            yield _typed(rows)
        if block:
            yield shared()

    return docs.select("doc_id", "text").mapInPandas(
        run, "kind int, doc_id long, n long, name long"
    )


def _typed(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["kind", "doc_id", "n", "name"], dtype=object)
    return out.astype({"kind": "int32", "doc_id": "Int64", "n": "int64", "name": "Int64"})


def written(docs: DataFrame, frequent: np.ndarray, words: int) -> DataFrame:
    """Signatures (key, name, n) of all sets; a task writes those of equal sets once."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        keys, names, sizes, waiting = [], [], [], 0
        for _, s in _sets(batches, words):
            if not len(s) or (name := name_of(s)) in seen:
                continue
            seen.add(name)
            if len(seen) > 500_000:  # only a saving
                seen.clear()
            k = signatures(s, known.value)
            keys.append(k)
            names.append(np.full(len(k), name, np.int64))
            sizes.append(np.full(len(k), len(s), np.int32))
            waiting += len(k)
            if waiting > 100_000:
                yield _columns(keys, names, sizes)
                keys, names, sizes, waiting = [], [], [], 0
        if keys:
            yield _columns(keys, names, sizes)

    return docs.select("doc_id", "text").mapInPandas(run, "key long, name long, n int")


def _columns(keys, names, sizes) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "key": np.concatenate(keys).view(np.int64),
            "name": np.concatenate(names),
            "n": np.concatenate(sizes),
        }
    )


def buckets(rows: DataFrame) -> DataFrame:
    """(key, name, n, pivot, pivot_n) of keys that at least two sets wrote; pivot is the smallest
    name. One pass over rows sorted by key; only the bucket at hand is remembered, by its pivot.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last row so far: the next batch may go on with its bucket
        pivot = None  # of the bucket at hand, if it was written
        for batch in batches:
            key, name, n = (batch[c].to_numpy() for c in ("key", "name", "n"))
            if not len(key):
                continue
            if held is not None:
                key, name, n = (np.r_[h, c] for h, c in zip(held, (key, name, n), strict=True))
            new = np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])]
            key, name, n = key[new], name[new], n[new]
            first = np.r_[True, key[1:] != key[:-1]]
            at = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            by, by_n = name[at], n[at]
            if pivot is not None and pivot[0] == key[0]:
                by[at == 0], by_n[at == 0] = pivot[1], pivot[2]
            many = ~first | np.r_[~first[1:], False]
            begun = 0
            if held is not None and pivot is not None and pivot[0] == key[0]:
                begun = 1  # the held row was written with its bucket
            out = pd.DataFrame({"key": key, "name": name, "n": n, "pivot": by, "pivot_n": by_n})
            keep = many.copy()
            keep[:begun] = False
            yield out[keep]
            held = (key[-1:], name[-1:], n[-1:])
            written_last = many[-1] or (begun and len(key) == 1)
            pivot = (key[-1], by[-1], by_n[-1]) if written_last else None

    return (
        rows.repartition("key")
        .sortWithinPartitions("key", "name")
        .mapInPandas(run, "key long, name long, n int, pivot long, pivot_n int")
    )


def candidates(pairs: DataFrame) -> DataFrame:
    """Of (a, a_n, b, b_n), a row for each shared signature, the pairs that may be similar."""
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    near = pairs.filter(OF * small >= SHARED * large)
    counted = near.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), small.alias("least")
    ).groupBy("a", "b", "least")
    needed = 1 + F.floor(F.col("least") / PER_SIGNATURE)
    return counted.agg(F.count("*").alias("hits")).filter(F.col("hits") >= needed).select("a", "b")


def whole_sets(docs: DataFrame, holder: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(name, shingles) of the sets ``wanted``, made again from one text of each.

    A filter of a fixed number of bits, set by the doc_ids looked for, goes with the tasks, so that
    only sets move and no texts do. It lets some more texts through; the join drops their sets.
    """
    ids = holder.join(wanted, "name", "left_semi")
    places = [
        F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(BITS)).cast("int").alias(f"p{i}")
        for i in range(PROBES)
    ]
    bits = np.zeros(BITS, bool)
    bits[ids.select(F.explode(F.array(*places)).alias("p")).distinct().toPandas()["p"]] = True
    known = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.unpackbits(known.value).astype(bool)
        for batch in batches:
            hit = table[batch[[f"p{i}" for i in range(PROBES)]].to_numpy()].all(axis=1)
            texts = batch["text"][hit]
            for i in range(0, len(texts), 256):
                found = [s for s in shingle_sets(texts.iloc[i : i + 256], words) if len(s)]
                names = [name_of(s) for s in found]
                yield pd.DataFrame(
                    {"name": names, "shingles": [s.view(np.int64) for s in found]}
                )

    found = docs.select("text", *places).mapInPandas(sets, "name long, shingles array<bigint>")
    return found.join(wanted, "name", "left_semi").dropDuplicates(["name"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    left = sets.select(F.col("name").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("name").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right")).cast("long")
    return (
        pairs.join(right, "b")
        .join(left, "a")
        .select("a", "b", both.alias("i"), (F.size("left") + F.size("right")).alias("sum"))
        .filter(OF * F.col("i") >= SHARED * (F.col("sum") - F.col("i")))
        .select("a", "b")
    )


def within_mixed(rows: DataFrame, column: str) -> DataFrame:
    """The rows of keys with more than one value of a column."""
    keys = rows.groupBy("key").agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return rows.join(keys.filter("low <> high").select("key"), "key", "left_semi")


def able_to_share(rows: DataFrame) -> DataFrame:
    """The rows of sets that have as many keys left as any partner of theirs asks for."""
    fewest = F.ceil(SHARED * F.max("n") / OF)
    enough = rows.groupBy("name").agg(
        (F.count("*") > F.floor(fewest / PER_SIGNATURE)).alias("enough")
    )
    return within_mixed(
        rows.join(enough.filter("enough").select("name"), "name", "left_semi"), "component"
    )


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()


def families(placed: DataFrame) -> DataFrame:
    """(name, component, family, blocks) of ``placed`` (key, name, n, pivot, component).

    A set's family is the pivot with which it shares most keys, or that pivot's own family, up to
    ``JUMPS`` times. Families whose members are in one component have no blocks: nothing in them
    is left to compare.
    """
    counted = placed.groupBy("name", "component", "pivot").agg(F.count("*").alias("hits"))
    best = F.max(F.struct("hits", (-F.col("pivot")).alias("minus"))).alias("best")
    members = cut_lineage(
        counted.groupBy("name", "component")
        .agg(best)
        .select("name", "component", (-F.col("best.minus")).alias("family"))
    )
    for _ in range(JUMPS):
        above = members.select(F.col("name").alias("family"), F.col("family").alias("higher"))
        members = members.join(above, "family", "left").select(
            "name", "component", F.coalesce("higher", "family").alias("family")
        )
        members = cut_lineage(members)
    members = merged(placed, members)
    mixed_up = F.min("component") != F.max("component")
    blocks = F.greatest(F.count("*") / FAMILY_BLOCK, F.sum("n") / FAMILY_SHINGLES)
    sizes = members.groupBy("family").agg(F.when(mixed_up, F.ceil(blocks)).alias("blocks"))
    return cut_lineage(members.drop("n").join(sizes, "family"))


def merged(placed: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (name, component, family) and the sets' sizes n, where families whose sets meet in
    buckets more often than they have pairs are one: that of the larger, up to ``JUMPS`` times.

    Buckets are counted by family, no pairs are made.
    """
    sizes = members.groupBy("family").agg(F.count("*").alias("sets"))
    met = (
        placed.join(members.select("name", "family"), "name")
        .groupBy("key", "family")
        .agg(F.count("*").alias("held"))
    )
    met = within_mixed(cut_lineage(met.join(sizes, "family")), "family")
    one = F.struct("sets", "family", "held")
    largest = met.groupBy("key").agg(F.max(one).alias("to"))
    pairs = F.sum(F.col("held") * F.col("to.held")).alias("pairs")
    into = (
        met.join(largest, "key")
        .filter(F.col("family") != F.col("to.family"))
        .groupBy("family", "sets", F.col("to.sets").alias("more"), F.col("to.family").alias("into"))
        .agg(pairs)
        .filter(F.col("pairs") >= F.greatest(F.lit(MERGED), F.col("sets") * F.col("more")))
        .groupBy("family")
        .agg(F.max(F.struct("pairs", "into")).getField("into").alias("into"))
    )
    into = cut_lineage(into)
    higher = into.select(F.col("family").alias("into"), F.col("into").alias("higher"))
    for _ in range(JUMPS):
        into = into.join(higher, "into", "left").select(
            "family", F.coalesce("higher", "into").alias("into")
        )
    of = placed.groupBy("name").agg(F.first("n").alias("n"))
    return cut_lineage(
        members.join(into, "family", "left")
        .join(of, "name")
        .select("name", "component", F.coalesce("into", "family").alias("family"), "n")
    )


def family_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Trees (a, b) of the links within families, each pair of blocks of a family being a group."""
    placed = members.filter("blocks IS NOT NULL").select(
        "family",
        "name",
        F.pmod(F.xxhash64("name"), F.col("blocks")).alias("block"),
        F.explode(F.sequence(F.lit(1), F.col("blocks"))).alias("other"),
    )
    meet = placed.withColumn("other", F.col("other") - 1).select(
        "family",
        F.least("block", "other").alias("one"),
        F.greatest("block", "other").alias("two"),
        "name",
    )
    groups = meet.join(sets, "name").groupBy("family", "one", "two")
    return groups.applyInPandas(linked_within, "a long, b long")


def linked_within(rows: pd.DataFrame) -> pd.DataFrame:
    """Each linked row of a group, with the smallest name that links in the group reach."""
    rows = rows.sort_values("name", ignore_index=True)
    sizes = rows["shingles"].map(len).to_numpy()
    owner = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(values := np.concatenate(list(rows["shingles"])), kind="stable")
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]]
    column = np.cumsum(new) - 1
    held = np.bincount(column)
    wide = held[column] > 1
    owner, column = owner[wide], (np.cumsum(held > 1) - 1)[column[wide]]
    both = np.zeros((len(rows), len(rows)), np.float32)  # below 2^24, so exact
    ends_at = np.searchsorted(column, np.arange(0, column[-1] + 1 + _COLUMNS, _COLUMNS)) if len(
        column
    ) else []
    for k, (begin, end) in enumerate(zip(ends_at[:-1], ends_at[1:], strict=True)):
        part = np.zeros((len(rows), _COLUMNS), np.float32)
        part[owner[begin:end], column[begin:end] - k * _COLUMNS] = 1
        both += part @ part.T
    union = sizes[:, None] + sizes[None, :] - both
    a, b = np.nonzero(np.triu(OF * both.astype(np.float64) >= SHARED * union, 1))
    root = np.arange(len(rows))
    lower_roots(root, a, b)
    names = rows["name"].to_numpy()
    some = root < np.arange(len(rows))
    return pd.DataFrame({"a": names[some], "b": names[root[some]]})


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id) for each row of ``docs`` (doc_id, text).

    Documents are linked when 100 |A and B| >= 75 |A or B|; component_id is the smallest doc_id that
    can be reached, set_id the smallest doc_id with an equal set. Texts without words, and null
    texts, have no shingles and are linked with nothing: both ids are their own. Repeated rows and
    copies are one set. A null doc_id takes part but names nothing. Other columns are ignored; an
    empty table gives an empty result. Sets and shingles are known by 64-bit hashes.
    """
    known = stage(document_sets(docs, words))
    own = known.filter("kind = 0").select("doc_id", "n", "name")
    counts = known.filter("kind = 1").groupBy("name").agg(F.sum("n").alias("count"))
    # Bounded by FREQUENT numbers.
    top = counts.orderBy(F.desc("count"), "name").limit(FREQUENT).select("name").toPandas()
    frequent = np.sort(top["name"].to_numpy(np.int64).view(np.uint64))

    shared = stage(buckets(written(docs, frequent, words)))
    stars = shared.filter("name <> pivot").select(
        F.col("name").alias("a"),
        F.col("n").alias("a_n"),
        F.col("pivot").alias("b"),
        F.col("pivot_n").alias("b_n"),
    )
    first = cut_lineage(candidates(stars))
    holder = own.filter("name IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("doc_id"))
    links = cut_lineage(verified(first, whole_sets(docs, holder, ends(first), words)))
    so_far = components(links)

    placed = shared.join(so_far, shared["name"] == so_far["node"], "left").select(
        "key", "name", "n", "pivot", F.coalesce("component", "name").alias("component")
    )
    placed = stage(able_to_share(within_mixed(placed, "component")))
    members = families(placed)
    alike = whole_sets(docs, holder, members.filter("blocks IS NOT NULL").select("name"), words)
    within = cut_lineage(family_links(members, alike))

    placed = within_mixed(placed.join(members.select("name", "family"), "name"), "family")
    other = placed.select(
        "key",
        F.col("name").alias("name2"),
        F.col("n").alias("n2"),
        F.col("component").alias("component2"),
        F.col("family").alias("family2"),
    )
    crossing = placed.join(other, "key").filter(
        "name < name2 AND component <> component2 AND family <> family2"
    )
    # All signatures of such a pair are in mixed buckets, so none goes uncounted.
    rest = cut_lineage(
        candidates(
            crossing.select(
                F.col("name").alias("a"),
                F.col("n").alias("a_n"),
                F.col("name2").alias("b"),
                F.col("n2").alias("b_n"),
            )
        ).join(first, ["a", "b"], "left_anti")
    )
    more = cut_lineage(verified(rest, whole_sets(docs, holder, ends(rest), words)))
    final = components(links.unionByName(within).unionByName(more))

    named = holder.join(final, holder["name"] == final["node"], "left").select(
        "name", F.col("doc_id").alias("set_id"), F.coalesce("component", "name").alias("component")
    )
    named = cut_lineage(named)
    smallest = named.groupBy("component").agg(F.min("set_id").alias("component_id"))
    named = named.join(smallest, "component").select("name", "set_id", "component_id")
    return (
        own.join(named, "name", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.coalesce("set_id", "doc_id").alias("set_id"),
            F.coalesce("component_id", "doc_id").alias("component_id"),
        )
    )
