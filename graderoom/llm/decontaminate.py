"""Benchmark decontamination by SimHash of item-sized windows.

Only DataFrame functions. Windows of an item's number of words are fingerprinted; a multi-index over
blocks of the fingerprint finds every item of that size within a Hamming radius, and the weighted
similarity of the shingles decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graderoom.llm.common import materialise, small_side, words

WORDS = 5
SIMILARITY = 0.75
#: A pair at the threshold shares 6 of 7 shingles and differs in 11 of 64 bits, give or take 3.
RADIUS = 20
#: Seven blocks: of at most 20 differing bits some block has at most two.
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
PER_BLOCK = RADIUS // len(BLOCKS)
LANES = 0x0000000100000001


def _shingles(tokens: Column | str, k: int) -> Column:
    """Hashes of all runs of k words in order; none if there are fewer words.

    Shifted arrays of word hashes are combined pairwise, so no lambda refers to a whole array.
    """
    def combined(hashes: Column) -> Column:
        n = F.greatest(F.size(hashes) - (k - 1), F.lit(0))
        out = F.slice(hashes, F.lit(1), n)
        for j in range(1, k):
            out = F.zip_with(out, F.slice(hashes, F.lit(j + 1), n), lambda x, y: F.xxhash64(x, y))
        return out

    # bound to a lambda variable, the word hashes are computed once per text
    return F.transform(F.array(F.transform(tokens, lambda w: F.xxhash64(w))), combined)[0]


def _fingerprint(shingle: str) -> list[Column]:
    """Sums of the bits of all shingles, two bits of the hash to a sum, 32 bits apart."""
    return [F.sum(F.shiftrightunsigned(shingle, b).bitwiseAND(F.lit(LANES))).alias(f"_l{b}") for b in range(32)]


def _signs(total: str) -> Column:
    """The 64-bit SimHash: a bit is set if more than half of the weighted shingles have it."""
    out = F.lit(0).cast("bigint")
    for b in range(32):
        low, high = F.col(f"_l{b}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_l{b}", 32)
        for count, bit in ((low, b), (high, b + 32)):
            mask = 1 << bit if bit < 63 else -(1 << 63)
            out = out.bitwiseOR(F.when(2 * count > F.col(total), F.lit(mask)).otherwise(F.lit(0)).cast("bigint"))
    return out


def _fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ``keys`` with the number ``m`` of shingles and the fingerprint ``f``."""
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), *_fingerprint("h"))
    return sums.select(*keys, "m", _signs("m").alias("f"))


def _block_values(f: str) -> Column:
    """Array of (block number, bits of the block)."""
    out, at = [], 0
    for k, width in enumerate(BLOCKS):
        bits = F.shiftrightunsigned(f, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        out.append(F.struct(F.lit(k).alias("block"), bits.alias("bits")))
        at += width
    return F.array(*out)


def _near_values() -> Column:
    """All values that differ from ``b.bits`` in at most PER_BLOCK bits, for the block's width."""
    def flips(width: int) -> list[int]:
        masks = {0}
        for _ in range(PER_BLOCK):
            masks |= {m ^ (1 << i) for m in masks for i in range(width)}
        return sorted(masks)

    out = F.array([F.lit(m) for m in flips(BLOCKS[1])])
    for width in set(BLOCKS) - {BLOCKS[1]}:
        wide = [k for k, w in enumerate(BLOCKS) if w == width]
        out = F.when(F.col("b.block").isin(wide), F.array([F.lit(m) for m in flips(width)])).otherwise(out)
    return F.transform(out, lambda m: m.bitwiseXOR(F.col("b.bits")))


def _starts(shared: DataFrame, m: Column) -> DataFrame:
    """Adds ``starts``: where the windows of ``m`` shingles begin that share enough to reach SIMILARITY.

    ``at`` has the sorted positions of the shared shingles of a text of ``size`` shingles. A window at
    the threshold holds that many of them in any order, so some run of as many successive positions
    lies in it; each run gives the starts that no run before it has given. A text shorter than the
    item is one window.
    """
    width = F.least("size", m)
    sized = shared.withColumns({
        "_width": width, "_need": F.ceil(SIMILARITY * (width + m) / (1 + SIMILARITY)).cast("int")})
    runs = F.greatest(F.size("at") - F.col("_need") + 1, F.lit(0))
    ends = F.zip_with(F.slice("at", F.lit(1), runs), F.slice("at", F.col("_need"), runs),
                      lambda x, y: F.struct(x.alias("first"), y.alias("last")))
    spans = F.zip_with(ends, F.slice(F.concat(F.array(F.lit(-1)), "at"), F.lit(1), runs), lambda e, before: F.struct(
        F.greatest(e["last"] - F.col("_width") + 1, before + 1).alias("low"),
        F.least(e["first"], F.col("size") - F.col("_width")).alias("high")))
    starts = F.flatten(F.transform(F.filter(spans, lambda x: x["low"] <= x["high"]),
                                   lambda x: F.sequence(x["low"], x["high"])))
    return sized.withColumn("starts", starts).drop("_width", "_need")


def _search(docs: DataFrame, items: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Best match per ``by`` and item of one shingle size: by, item_id, start, n, hamming, similarity."""
    item_shingles = items.select("item_id", "n", F.explode(_shingles("tokens", k)).alias("h"))
    prints = materialise(_fingerprints(item_shingles, ["item_id", "n"]), "leak-items")
    index = prints.select("item_id", "n", F.col("m").alias("item_m"), F.col("f").alias("item_f"),
                          F.explode(_block_values("f")).alias("b")).select(
        "item_id", "n", "item_m", "item_f", F.col("b.block").alias("block"), F.explode(_near_values()).alias("bits"))
    weights = item_shingles.groupBy("item_id", "h").agg(F.count(F.lit(1)).alias("w"))

    hashes = _shingles(words(F.lower("text")), k)
    seeds = item_shingles.select("h", "n").distinct()
    shared = (
        docs.select("doc_id", F.xxhash64("text").alias("t"), hashes.alias("hashes"))
        .select("doc_id", "t", F.size("hashes").alias("size"), F.posexplode("hashes").alias("p", "h"))
        .join(small_side(materialise(seeds, "leak-seeds")), "h")
        .groupBy("doc_id", "t", "size", "n").agg(F.sort_array(F.collect_set("p")).alias("at")))
    windows = (
        _starts(shared, F.col("n") - (k - 1)).where("size(starts) > 0")
        .groupBy("doc_id", "t").agg(F.collect_list(F.struct("n", "starts")).alias("windows")))
    windows = materialise(windows.withColumnRenamed("doc_id", "w_doc").withColumnRenamed("t", "w_t"), "leak-windows")

    spelled = (
        docs.join(small_side(windows, values=F.aggregate(
            "windows", F.lit(0).cast("long"), lambda n, w: n + F.size(w["starts"]) + 1)),
                  F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.xxhash64("text") == F.col("w_t")))
        .dropDuplicates(["w_doc", "w_t"])
        .select("doc_id", "w_t", hashes.alias("hashes"), F.explode("windows").alias("w"))
        .select("doc_id", "w_t", "hashes", F.col("w.n").alias("n"), F.explode("w.starts").alias("start"))
        .select("doc_id", "w_t", "n", "start",
                F.explode(F.slice("hashes", F.col("start") + 1, F.col("n") - (k - 1))).alias("h")))
    spelled = materialise(spelled, "leak-shingles")
    window = ["doc_id", "w_t", "n", "start"]
    found = (
        _fingerprints(spelled, window)
        .withColumn("b", F.explode(_block_values("f")))
        .select(*window, "m", "f", F.col("b.block").alias("block"), F.col("b.bits").alias("bits"))
        .join(small_side(materialise(index, "leak-index")), ["n", "block", "bits"])
        .withColumn("hamming", F.bit_count(F.col("f").bitwiseXOR(F.col("item_f"))))
        .where(F.col("hamming") <= RADIUS)
        .select(*window, "m", "item_id", "item_m", "hamming").distinct())
    found = materialise(found, "leak-candidates")
    counted = spelled.groupBy(*window, "h").agg(F.count(F.lit(1)).alias("c")).withColumnRenamed("doc_id", "d")
    same = [F.col("d").eqNullSafe(F.col("doc_id"))] + [counted[x] == found[x] for x in window[1:]]
    both = (
        found.join(counted, same).select(
            found["doc_id"], found["w_t"], found["n"], found["start"], "m", "item_id", "item_m", "hamming", "h", "c")
        .join(small_side(materialise(weights, "leak-weights")), ["item_id", "h"])
        .groupBy(*window, "item_id", "m", "item_m", "hamming").agg(F.sum(F.least("c", "w")).alias("common")))
    return (
        both.withColumn("similarity", F.col("common") / (F.col("m") + F.col("item_m") - F.col("common")))
        .where(F.col("similarity") >= SIMILARITY)
        .groupBy(*by, "item_id", "n")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("neg"), "hamming")).alias("best"))
        .select(*by, "item_id", (-F.col("best.neg")).alias("start"), "n", "best.hamming", "best.similarity"))


def _leaks(docs: DataFrame, benchmark: DataFrame, by: list[str]) -> DataFrame:
    """``find_leaks`` per ``by``: doc_id, or doc_id and w_t, the hash of the text."""
    items = benchmark.select("item_id", words(F.lower("text")).alias("tokens")).where("size(tokens) > 0")
    items = materialise(items.withColumn("n", F.size("tokens")), "leak-benchmark")
    slim = docs.select("doc_id", "text")
    parts = [_search(slim, items.where(f"n >= {WORDS}"), WORDS, by)]
    short = [r[0] for r in items.where(f"n < {WORDS}").select("n").distinct().collect()]  # four values at most
    for k in sorted(short):
        parts.append(_search(slim, items.where(F.col("n") == k), k, by))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document and benchmark item of which the document holds a near copy.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Words are lower-cased and split at
    ASCII blanks. A window has as many words as the item (or is the whole of a shorter document);
    it matches if the shingles of five words, weighted by how often they occur, have a Jaccard
    similarity of 0.75 or more. Items of fewer than five words are one shingle. Returns doc_id,
    item_id, the first word and number of words of the best window, its Hamming distance and
    similarity.

    A window that can reach the threshold shares 6 of 7 shingles with the item, in any order, so
    windows are fingerprinted at every start where that many of their shingles are shared with items
    of their size; the multi-index then looks up items, whichever shingles led there. Null and empty
    texts and items match nothing; repeated rows give one row per doc_id and item; empty tables give
    an empty table. Item-side tables are broadcast only up to a counted number of rows.
    """
    return _leaks(docs, benchmark, ["doc_id"])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no near copy of a benchmark item, with their columns.

    Rows are told apart by doc_id and text: a clean text that shares a leak's doc_id, or like it has none, stays.
    """
    plain = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"))
    gone = materialise(_leaks(docs, benchmark, ["doc_id", "w_t"]).select("doc_id", "w_t").distinct(), "leak-documents")
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("w_t"))
    return plain.join(small_side(gone), same, "left_anti").select("_row.*")
