"""Near-duplicate documents by min-max hashing.

Under each permutation both the smallest and the largest value of a document's shingle set are kept:
two unbiased values for one evaluation. Bands of them propose candidates, which are confirmed on
the full sets; components of confirmed links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graderoom.llm import chunks as C
from graderoom.llm.common import discard, materialise, small_side
from graderoom.llm.components import components
from graderoom.llm.lm import word_hashes

WORDS = 5
#: A link needs PERCENT * union <= 100 * intersection.
PERCENT = 75
#: 150 permutations give 300 values in 50 bands of 6: a pair at the threshold shares no band with
#: probability (1 - 0.75 ** 6) ** 50, about 6 in 100,000.
PERMUTATIONS, ROWS = 150, 6
#: Nodes of a block, on the side of minor nodes and on the side of all.
BLOCK, ALL_BLOCK = 64, 1024
_LEFT = np.uint64(0xD1342543DE82EF95)


def _then(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    return C.mix(h * _LEFT + more)


def shingle_sets(row) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a chunk, sorted within each text, and their number.

    A text with fewer than ``WORDS`` words has its whole sequence as one shingle; one without words
    has none.
    """
    data, edges = C.raw_of(row)
    hashes, text = word_hashes(data, edges)
    n = len(row.sizes)
    per = np.bincount(text, minlength=n)
    first = np.cumsum(per) - per
    parts, owners = [], []
    if len(hashes) >= WORDS:
        whole = np.flatnonzero(text[WORDS - 1:] == text[:len(text) - WORDS + 1])
        h = hashes[whole]
        for k in range(1, WORDS):
            h = _then(h, hashes[whole + k])
        parts.append(h)
        owners.append(text[whole])
    for size in range(1, WORDS):
        some = np.flatnonzero(per == size)
        if len(some):
            h = hashes[first[some]]
            for k in range(1, size):
                h = _then(h, hashes[first[some] + k])
            parts.append(C.mix(h + np.uint64(size)))
            owners.append(some)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    values, owner = np.concatenate(parts), np.concatenate(owners)
    by = np.lexsort((values, owner))
    values, owner = values[by], owner[by]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=n)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signature_bands(values: np.ndarray, starts: np.ndarray, permutations: int = PERMUTATIONS,
                    rows: int = ROWS) -> np.ndarray:
    """Band keys of the sets that begin at ``starts``: one row per set."""
    draws = C.mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    signature = np.empty((len(starts), 2 * permutations), np.uint64)
    moved = np.empty_like(values)
    for k in range(permutations):
        np.multiply(values, draws[k] | np.uint64(1), out=moved)
        moved += draws[permutations + k]
        signature[:, k] = np.minimum.reduceat(moved, starts)
        signature[:, permutations + k] = np.maximum.reduceat(moved, starts)
    bands = signature.reshape(len(starts), -1, rows)
    keys = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]).copy()
    for j in range(rows):
        keys = _then(keys, bands[:, :, j])
    return keys


def _nodes(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which texts have a set, where it begins, and a 64-bit digest of it."""
    some = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[some]
    if not len(some):
        return some, starts, np.zeros(0, np.uint64)
    one, two = np.add.reduceat(C.mix(values), starts), np.add.reduceat(C.mix(values ^ _LEFT), starts)
    return some, starts, _then(_then(one, two), counts[some].astype(np.uint64))


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            values, counts = shingle_sets(row)
            some, starts, nodes = _nodes(values, counts)
            node = np.zeros(len(counts), np.int64)
            node[some] = _signed(nodes)
            bands: list = [None] * len(counts)
            if len(some):
                for k, keys in zip(some, _signed(signature_bands(values, starts))):
                    bands[k] = keys
            yield pd.DataFrame({"doc_id": pd.array(C.ids_of(row), "Int64"), "chunk": row.chunk,
                                "place": np.arange(len(counts)), "n_shingles": counts, "node": node, "bands": bands})


def _sets(row, wanted: pd.DataFrame) -> pd.DataFrame:
    values, counts = shingle_sets(row)
    ends = np.cumsum(counts)
    return pd.DataFrame({"node": wanted["node"], "hashes": [
        C.squeeze_sorted(values[ends[p] - counts[p]:ends[p]]) for p in wanted["place"]]})


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < PERCENT * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch = batch.sort_values("u")
        keep, last, held = [], None, None
        for u, x, y in zip(batch["u"], batch["u_hashes"], batch["v_hashes"]):
            if u != last:
                last, held = u, C.stretch_sorted(x)
            keep.append(_linked(held, C.stretch_sorted(y)))
        yield batch.loc[np.array(keep, bool), ["u", "v"]]


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("hashes").alias("u_hashes"))
    right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("v_hashes"))
    return pairs.join(right, "v").join(left, "u").select("u", "v", "u_hashes", "v_hashes").mapInPandas(
        _confirm, "u long, v long")


def _block_links(part: pd.DataFrame) -> pd.DataFrame:
    """Links of a block of minor nodes (side 0) with a block of all nodes (side 1).

    Only nodes of different components are tested, and components joined here are one from then on.
    """
    minor, every = (part[part["side"] == side].sort_values("node") for side in (0, 1))
    if minor.empty or every.empty:
        return pd.DataFrame({"u": [], "v": []}, dtype="int64")
    hashes = [C.stretch_sorted(x) for x in every["hashes"]]
    sizes = np.array([len(x) for x in hashes])
    flat, owner = np.concatenate(hashes), np.repeat(np.arange(len(hashes)), sizes)
    nodes = every["node"].to_numpy()
    # components by number; a link gives the numbers of one to the other
    numbers, comps = np.unique(np.concatenate([minor["comp"], every["comp"]]), return_inverse=True)
    of_minor, of_every = comps[:len(minor)], comps[len(minor):]
    now = np.arange(len(numbers))
    found = []
    for k, (node, packed) in enumerate(zip(minor["node"], minor["hashes"])):
        other = now[of_every] != now[of_minor[k]]
        if not other.any():
            continue
        own = C.stretch_sorted(packed)
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.bincount(owner[own[at] == flat], minlength=len(hashes))
        linked = np.flatnonzero(other & (100 * both >= PERCENT * (sizes + len(own) - both)))
        for j in linked:
            x, y = now[of_minor[k]], now[of_every[j]]
            if x != y:
                now[now == max(x, y)] = min(x, y)
                found.append((node, nodes[j]))
    return pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def _open_buckets(labelled: DataFrame) -> DataFrame:
    """Buckets that still hold more than one component, with their most popular node."""
    return labelled.groupBy("bucket").agg(
        F.max(F.struct("popularity", "node")).alias("top"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    ).where("lo < hi").select("bucket", F.col("top.node").alias("centre"))


def _against_centres(labelled: DataFrame) -> DataFrame:
    """Pairs (centre, node) of open buckets in different components."""
    comps = labelled.select(F.col("node").alias("centre"), F.col("comp").alias("centre_comp")).distinct()
    return (
        labelled.join(_open_buckets(labelled), "bucket").select("node", "comp", "centre").distinct()
        .join(comps, "centre").where("comp <> centre_comp")
        .select(F.col("centre").alias("u"), F.col("node").alias("v")))


def _left_over(labelled: DataFrame) -> DataFrame:
    """Rows of block pairs that hold every pair of an open bucket in different components.

    A bucket's largest component is its major one. The nodes that stand outside of a component in
    any bucket where it is the major one are its minor nodes. They meet the whole component and each
    other, so all pairs of its buckets are there once, however many buckets repeat them; two nodes
    of the major component are connected already and never meet. Both sides are dealt into blocks:
    minor blocks (side 0) meet blocks of all (side 1).
    """
    shares = labelled.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    majors = shares.groupBy("bucket").agg(
        F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("n")).where("top.c < n").select(
        "bucket", F.col("top.comp").alias("major"))
    minors = materialise(
        labelled.join(majors, "bucket").where("comp <> major").select("major", "node", "comp").distinct(), "near-minors")
    wholes = labelled.select("node", "comp").distinct().join(
        minors.select(F.col("major").alias("comp")).distinct(), "comp").select(
        F.col("comp").alias("major"), "node", "comp")
    every = minors.union(wholes)
    sizes = minors.groupBy("major").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("minor_blocks")).join(
        every.groupBy("major").agg(F.ceil(F.count(F.lit(1)) / ALL_BLOCK).cast("int").alias("all_blocks")), "major")

    def meet(nodes: DataFrame, side: int) -> DataFrame:
        own, other = ("i", "j") if side == 0 else ("j", "i")
        count = {"i": "minor_blocks", "j": "all_blocks"}
        return (
            nodes.join(sizes, "major")
            .withColumn(own, F.pmod(F.xxhash64("node"), count[own]).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(count[other]) - 1)))
            .select("major", "i", "j", F.lit(side).alias("side"), "node", "comp"))

    return meet(minors, 0).union(meet(every, 1))


def links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Roots of all components that confirmed links make among the members (bucket, node) of buckets.

    Every pair of a bucket is either tested or already connected:

    1. each node is tested against the centre that most of its buckets have: a bucket's centre is
       the node that meets most others over all buckets, likely the text the others were made from;
    2. in buckets that still hold several components, nodes of other components are tested against
       the bucket's centre;
    3. in those still open, the nodes outside the largest component are tested, block by block,
       against that component and each other.

    So a family of copies costs a test or two per copy, whatever its size, and the last step leaves
    no pair out.
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    popular = members.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("popularity"))
    members = materialise(members.join(popular, "node"), "near-popular")
    centres = members.groupBy("bucket").agg(F.max(F.struct("popularity", "node")).alias("top")).select(
        "bucket", F.col("top.node").alias("centre"), F.col("top.popularity").alias("weight"))
    by_centre = members.join(centres, "bucket").where("node <> centre").groupBy("node", "centre", "weight").agg(
        F.count(F.lit(1)).alias("n"))
    first = by_centre.groupBy("node").agg(F.max(F.struct("n", "weight", "centre"))["centre"].alias("centre"))
    edges = materialise(confirmed(first.select(F.col("centre").alias("u"), F.col("node").alias("v")), sets), "near-1")

    # two steps up from each node already join most of a family; any part of a component may do here
    up = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    twice = up.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select(
        "node", F.coalesce("next", "root").alias("root"))
    labelled = materialise(_labelled(members, twice), "near-labels-1")
    edges = edges.union(materialise(confirmed(_against_centres(labelled), sets), "near-2"))
    roots = materialise(components(edges), "near-roots-2")

    labelled = materialise(_labelled(members, roots), "near-labels-2")
    found = _left_over(labelled).join(sets, "node").groupBy("major", "i", "j").applyInPandas(
        _block_links, "u long, v long")
    return components(edges.union(materialise(found, "near-3")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are lower-cased A-Z and split at ASCII blanks; a set holds the distinct shingles of five
    words. Documents with 100 * intersection >= 75 * union are linked; component_id is the smallest
    doc_id of the component, and kept says whether the row has it. A null, empty or blank text has an
    empty set, is linked with nothing and kept. Rows with equal sets are one class from the start, so
    exact copies cost nothing further; rows that repeat a doc_id with one set are kept together; a
    null doc_id is never the smallest. An empty table gives an empty table. Sets are told apart by a
    64-bit digest.
    """
    table = C.write_chunks(docs, "near")
    signed = materialise(table.mapInPandas(
        _sign, "doc_id long, chunk long, place long, n_shingles long, node long, bands array<long>"), "near-signed")
    classes = signed.where("n_shingles > 0").groupBy("node").agg(
        F.min_by(F.struct("chunk", "place", "bands"), F.struct("chunk", "place")).alias("one"))
    banded = classes.select("node", F.explode("one.bands").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = materialise(banded.join(crowded, "bucket").select("bucket", "node"), "near-members")

    chosen = members.select("node").distinct().join(
        signed.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("chunk", "place")).alias("one")), "node")
    wanted = chosen.select("node", "one.chunk", "one.place")
    sets = materialise(C.with_replies(table, wanted, _sets, "node long, hashes binary"), "near-sets")
    discard(table)
    roots = materialise(links(members, sets), "near-roots")
    discard(members, sets)

    slim = signed.drop("bands", "chunk", "place").join(roots, "node", "left").withColumn(
        "comp", F.coalesce("root", "node"))
    least = slim.where("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return (
        slim.join(least, (slim["comp"] == least["comp"]) & (slim["n_shingles"] > 0), "left")
        .select("doc_id", "n_shingles",
                F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near duplicates.

    Rows are told apart by a hash of doc_id and text, so a doc_id that is null or repeated says nothing
    about other texts. A group keeps the row with the smallest doc_id, a null one last; rows equal in
    doc_id and text count once. Texts without words are all kept.
    """
    row = F.xxhash64("doc_id", "text")
    judged = near_duplicates(docs.select(row.alias("doc_id"), "text")).where("n_shingles > 0")
    judged = materialise(judged.select(F.col("doc_id").alias("_row"), "component_id"), "near-judged")
    groups = judged.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = judged.join(groups, "component_id", "left_semi").distinct()
    named = docs.select(row.alias("_row"), "doc_id").join(members, "_row")
    best = named.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))["_row"].alias("best"))
    gone = materialise(members.join(best, "component_id").where("_row <> best").select("_row"), "near-gone")
    left = docs.withColumn("_row", row).join(small_side(gone), "_row", "left_anti")
    repeated = judged.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_row")
    if repeated.limit(1).count():
        repeated = small_side(materialise(repeated, "near-repeated"))
        once = left.join(repeated, "_row", "left_semi").dropDuplicates(["_row"])
        left = left.join(repeated, "_row", "left_anti").unionByName(once)
    return left.select(*docs.columns)
