"""Exact substring removal by distributed prefix doubling.

A string is named by a 64-bit number; the name of a string of twice the length is the name of the
pair of names at its two halves, and the last, overlapping pair reaches the threshold. Positions
whose name is unique in the corpus drop out after each round; what is left is ranked by its place.

Doubling at every position would shuffle every byte of the corpus in every round. Two facts keep
what is asked small and lose nothing:

* Of all base strings inside a string of threshold length the one with the smallest name (the last
  of equal ones) is its anchor. Equal strings have equal anchors at equal offsets, so strings whose
  anchor is unique cannot repeat. Only anchors are ranked in the first round.
* Neighbouring positions mostly share their anchor. Such a run of positions is one entry, named by
  the names of its first and last string, which together cover it. A run that stands earlier
  elsewhere repeats as a whole. A run that is the first of its kind is looked at position by
  position, in the second round, only if its anchor also has runs of another kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graderoom.llm import chunks as C

THRESHOLD = 100
RUNS, SINGLES = 1, 2
EARLIER, MIXED = 1, 2
TILE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LEFT = np.uint64(0xD1342543DE82EF95)


def base_length(threshold: int) -> int:
    return max(1, threshold * 32 // 100)


def names_of(data: np.ndarray, length: int) -> np.ndarray:
    """The names of all strings of ``length`` bytes in ``data``, tile by tile."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size = min(TILE, n) + length
    up = np.cumprod(np.full(size, _BASE, np.uint64))
    down = np.cumprod(np.full(size, _INVERSE, np.uint64))
    values = C.byte_values(11)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, TILE):
        part = data[lo:lo + TILE + length - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * up[:len(part)], out=sums[1:])
        k = len(part) - length + 1
        out[lo:lo + k] = C.mix((sums[length:] - sums[:k]) * down[:k])
    return out


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return C.mix(left * _LEFT + right)


def name_at(names: np.ndarray, base: int, at: np.ndarray, length: int) -> np.ndarray:
    """Names of the strings of ``length`` at positions ``at``, doubled up from the base names."""
    if length == base:
        return names[at]
    shorter = base
    while shorter * 2 < length:
        shorter *= 2
    return pair(name_at(names, base, at, shorter), name_at(names, base, at + (length - shorter), shorter))


def anchors_of(names: np.ndarray, threshold: int, base: int) -> np.ndarray:
    """For each string of threshold length the position of its anchor."""
    width = threshold - base + 1
    n = len(names) - width + 1
    out = np.empty(max(n, 0), np.int64)
    mask = np.uint64((1 << 22) - 1)
    for lo in range(0, n, TILE):
        least = names[lo:lo + TILE + width - 1]
        # the low bits hold the place, so that the later of equal names is the smaller
        least = (least & ~mask) | (mask - np.arange(len(least), dtype=np.uint64))
        have = 1
        while have * 2 <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if width > have:
            least = np.minimum(least[:have - width], least[width - have:])
        out[lo:lo + len(least)] = lo + (mask - (least & mask)).astype(np.int64)
    return out


class Runs:
    """The runs of a chunk: maximal stretches of positions of one text that share their anchor."""

    def __init__(self, row, threshold: int):
        base = base_length(threshold)
        self.threshold, self.base = threshold, base
        self.data, self.edges = C.raw_of(row)
        self.ids = np.asarray(row.doc_ids, np.int64)
        n = len(self.ids)
        rank = np.empty(n, np.int64)
        rank[np.lexsort((np.arange(n), self.ids))] = np.arange(n)
        self.names = names_of(self.data, base)
        anchors = anchors_of(self.names, threshold, base)
        whole = np.zeros(len(anchors) + 1, bool)
        for lo, hi in zip(self.edges[:-1], self.edges[1:]):
            if hi - lo >= threshold:
                whole[lo:hi - threshold + 1] = True
        inside = whole[:-1]
        change = np.ones(len(anchors), bool)
        change[1:] = (anchors[1:] != anchors[:-1]) | ~inside[:-1]
        self.lo = np.flatnonzero(change & inside)
        last = inside & ~whole[1:]
        last[:-1] |= inside[:-1] & change[1:]
        self.hi = np.flatnonzero(last)
        self.anchor = anchors[self.lo]
        self.doc = np.searchsorted(self.edges, self.lo, side="right") - 1
        self.order = (rank[self.doc] << 40) | (self.lo - self.edges[self.doc])
        self.group = C.mix(self.names[self.anchor])
        ends = [name_at(self.names, base, p, threshold) for p in (self.lo, self.hi)]
        self.name = pair(pair(ends[0], ends[1]), (self.hi - self.lo).astype(np.uint64))
        self.entries = Entries(self.group, self.name, self.order)

    def opened(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, "Entries"]:
        """After round one: which runs repeat, the positions to look at singly, and their entries."""
        code = codes[self.entries.of]
        repeats = ~self.entries.first | ((code & EARLIER) > 0)
        look = np.flatnonzero(~repeats & ((code & MIXED) > 0))
        lengths = self.hi[look] - self.lo[look] + 1
        run = np.repeat(look, lengths)
        at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + self.lo[run]
        keys = C.mix(name_at(self.names, self.base, at, self.threshold))
        check = C.mix(self.group[run] + (self.anchor[run] - at).astype(np.uint64)) & np.uint64(0xFFFF)
        return repeats, at, Entries(keys, check, self.order[run] + (at - self.lo[run]), self.doc[run])


class Entries:
    """Distinct (key, name) pairs in order, where each occurrence is, and which comes first."""

    def __init__(self, keys: np.ndarray, names: np.ndarray, order: np.ndarray, doc: np.ndarray | None = None):
        by = np.lexsort((order, names, keys))
        k, v = keys[by], names[by]
        new = np.ones(len(by), bool)
        new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
        self.of = np.empty(len(by), np.int64)
        self.of[by] = np.cumsum(new) - 1
        self.first = np.zeros(len(by), bool)
        self.first[by[new]] = True
        self.keys, self.names, self.at, self.doc = k[new], v[new], by[new], doc


def _answer(asked: pd.DataFrame) -> pd.DataFrame:
    """For each entry: does it stand earlier in another chunk, and has its key other names too."""
    keys = [C.stretch_sorted(k) for k in asked["keys"]]
    sizes = np.array([len(k) for k in keys])
    key = np.concatenate(keys)
    name = np.concatenate([C.stretch(x, np.uint64) for x in asked["a"]])
    doc = np.concatenate([C.stretch(x, np.int64) for x in asked["b"]])
    chunk = np.repeat(asked["chunk"].to_numpy(), sizes)
    by = np.lexsort((chunk, doc, name, key))
    k, v = key[by], name[by]
    new_key = np.ones(len(by), bool)
    new_key[1:] = k[1:] != k[:-1]
    new = new_key.copy()
    new[1:] |= v[1:] != v[:-1]
    kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))
    code = np.empty(len(by), np.uint8)
    code[by] = np.where(new, 0, EARLIER) | np.where(kinds[np.cumsum(new_key) - 1] > 1, MIXED, 0)
    parts = np.split(code, np.cumsum(sizes)[:-1])
    return pd.DataFrame({
        "kind": asked["kind"], "bucket": asked["bucket"], "chunk": asked["chunk"],
        "a": [C.squeeze(p) for p in parts], "b": [b""] * len(parts), "total": 0, "distinct": 0})


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Remove every byte of a text that a string of ``threshold`` bytes covers which starts earlier.

    Texts are UTF-8 bytes; earlier means in a text with a smaller doc_id, or before in the same
    text. Repeats never cross texts, may overlap, and are judged on the input. Returns per row
    doc_id, n_bytes, kept (the other bytes; binary, as a cut can part a character), and the removed
    spans as span_starts and span_ends (byte offsets, ends exclusive). A null text is empty; a null
    doc_id is smaller than all; rows that repeat a doc_id are ordered as they are stored; an empty
    table gives an empty table. Names are 64-bit hashes, checked by 16 bits of the anchor's name.
    """
    table = C.write_chunks(docs, "exact")
    ranges = C.key_ranges(table)

    def ask_runs(row) -> Iterator[pd.DataFrame]:
        runs = Runs(row, threshold)
        e = runs.entries
        yield C.questions(row.chunk, RUNS, ranges, e.keys, e.names, runs.ids[runs.doc[e.at]])

    first = C.ask_all(table, ask_runs, _answer, "exact-runs")

    def ask_singles(row, replies: pd.DataFrame) -> pd.DataFrame:
        runs = Runs(row, threshold)
        e = runs.opened(C.reply_array(replies, RUNS, "a", np.uint8))[2]
        return C.questions(row.chunk, SINGLES, ranges, e.keys, e.names, runs.ids[e.doc[e.at]])

    second = C.answered(C.with_replies(table, first, ask_singles, C.ASK_SCHEMA), _answer, "exact-singles")

    def cut(row, replies: pd.DataFrame) -> pd.DataFrame:
        runs = Runs(row, threshold)
        repeats, at, e = runs.opened(C.reply_array(replies, RUNS, "a", np.uint8))
        codes = C.reply_array(replies, SINGLES, "a", np.uint8)
        single = at[~e.first | ((codes[e.of] & EARLIER) > 0)] if len(at) else at
        steps = np.zeros(len(runs.data) + 1, np.int32)
        np.add.at(steps, runs.lo[repeats], 1)
        np.add.at(steps, runs.hi[repeats] + threshold, -1)
        np.add.at(steps, single, 1)
        np.add.at(steps, single + threshold, -1)
        gone = np.cumsum(steps[:-1]) > 0
        kept, starts, ends = [], [], []
        for lo, hi in zip(runs.edges[:-1], runs.edges[1:]):
            here = gone[lo:hi]
            edge = np.flatnonzero(np.diff(here.astype(np.int8), prepend=0, append=0))
            kept.append(runs.data[lo:hi][~here].tobytes())
            starts.append(edge[::2])
            ends.append(edge[1::2])
        return pd.DataFrame({"doc_id": pd.array(C.ids_of(row), "Int64"), "n_bytes": np.diff(runs.edges),
                             "kept": kept, "span_starts": starts, "span_ends": ends})

    return C.with_replies(table, first.unionByName(second), cut, "doc_id long, n_bytes long, kept binary, "
                          "span_starts array<long>, span_ends array<long>")


def summarise(removed: DataFrame) -> DataFrame:
    """Counts and the digest of what is kept, per row of ``remove_repeats``."""
    return removed.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
