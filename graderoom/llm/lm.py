"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of two-word and one-word sequences and a uniform
distribution. The mixture weights depend on how often the context was seen, by powers of two, and
are learned by expectation-maximisation on held-out counts: those of one fold of the training
documents, against estimates from which that fold has been deleted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graderoom.llm import chunks as C

FOLDS = 7
TEST_FOLD = 2
HELD_FOLD = 3
EM_ROUNDS = 40
UNIGRAM, BIGRAM = 1, 2
#: Grid of the held-out counts: quarter powers of two of both estimates, powers of two of the context.
STEP = 4
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def word_hashes(data: np.ndarray, edges: np.ndarray, between: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in ``data``, and the text each is in.

    ``between`` says for each byte value whether it separates words.
    """
    inside = ~between[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_text = edges[:-1][edges[:-1] < len(data)]
    first[starts_text] = inside[starts_text]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    word = np.cumsum(first, dtype=np.int32)[at] - 1
    place = (at - starts[word]).astype(np.int32)
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
    terms = C.byte_values(3)[_LOWER[data[at]]] * powers[place]
    cuts = np.flatnonzero(np.diff(word, prepend=-1))
    hashes = C.mix(np.add.reduceat(terms, cuts))
    return hashes, np.searchsorted(edges, starts, side="right") - 1


class Stream:
    """The tokens of a chunk: words and one end per text, with the token before each."""

    def __init__(self, row):
        data, edges = C.raw_of(row)
        hashes, text = word_hashes(data, edges)
        n = len(row.sizes)
        counts = np.bincount(text, minlength=n) + 1
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.counts = counts
        self.tokens = np.empty(int(self.ends[-1]), np.uint64)
        self.tokens[np.arange(len(hashes)) + text] = hashes
        self.tokens[self.ends - 1] = _END
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = _START
        self.pairs = C.mix(before ^ C.mix(self.tokens + _BASE))
        folds = np.array([fold_of(d) for d in C.ids_of(row)])
        self.train = np.repeat(folds != TEST_FOLD, counts)
        self.held = np.repeat(folds == HELD_FOLD, counts)
        self.folds = folds


def _ask(row, ranges: int) -> Iterator[pd.DataFrame]:
    s = Stream(row)
    for kind, keys in ((UNIGRAM, s.tokens), (BIGRAM, s.pairs)):
        unique, which = np.unique(keys, return_inverse=True)
        counts = [np.bincount(which, weights=w, minlength=len(unique)).astype(np.uint32) for w in (s.train, s.held)]
        yield C.questions(row.chunk, kind, ranges, unique, *counts)


def _answer(asked: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts of each asked key, in training documents and in the held fold."""
    keys = [C.stretch_sorted(k) for k in asked["keys"]]
    unique, which = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(which, weights=np.concatenate([C.stretch(x, np.uint32) for x in asked[c]]),
                        minlength=len(unique)).astype(np.uint64) for c in ("a", "b")]
    edges = np.cumsum([0] + [len(k) for k in keys])
    parts = [which[edges[i]:edges[i + 1]] for i in range(len(keys))]
    only_first = np.arange(len(keys)) == 0
    return pd.DataFrame({
        "kind": asked["kind"], "bucket": asked["bucket"], "chunk": asked["chunk"],
        "a": [C.squeeze(sums[0][p]) for p in parts], "b": [C.squeeze(sums[1][p]) for p in parts],
        "total": np.where(only_first, int(sums[0].sum()), 0),
        "distinct": np.where(only_first, int((sums[0] > 0).sum()), 0)})


def _counts(row, replies: pd.DataFrame):
    s = Stream(row)
    out = []
    for kind, keys in ((UNIGRAM, s.tokens), (BIGRAM, s.pairs)):
        unique, which = np.unique(keys, return_inverse=True)
        for column in ("a", "b"):
            out.append(C.reply_array(replies, kind, column, np.uint64).astype(np.float64)[which])
        del unique
    uni, uni_held, bi, bi_held = out
    first_end = s.ends[0] - 1
    context, context_held = np.empty_like(uni), np.empty_like(uni)
    for target, source in ((context, uni), (context_held, uni_held)):
        target[1:] = source[:-1]
        target[s.starts] = source[first_end]  # as many starts as ends
    return s, uni, uni_held, bi, bi_held, context, context_held


def _class(context: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(context + 1)).astype(np.int64)


def _share(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0)


def learn_weights(cells: pd.DataFrame, uniform: float, rounds: int = EM_ROUNDS) -> dict[int, tuple[float, float, float]]:
    """Mixture weights per context class from held-out counts on the grid of estimates."""
    weights = {}
    for cls, part in cells.groupby("cls"):
        f = np.stack([np.where(part[c] == 1, 0.0, np.exp2(part[c].to_numpy() / STEP)) for c in ("q2", "q1")]
                     + [np.full(len(part), uniform)])
        n = part["n"].to_numpy(float)
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = f * w[:, None]
            share /= share.sum(axis=0)
            w = (share * n).sum(axis=1) / n.sum()
        weights[int(cls)] = tuple(w)
    return weights


def score_documents(docs: DataFrame) -> DataFrame:
    """Score every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are lower-cased A-Z; each text has one end token. Counts come from all documents whose
    crc32(doc_id as text) mod 7 is not 2. base_score is add-one smoothing of single tokens; score
    is the mixture. Both are log10 of the whole text. A null text is empty (one end token); a null
    doc_id counts as the text ''; rows that repeat a document are each counted and scored; an empty
    table gives an empty table. Context classes without held-out tokens use those of the nearest
    lower class, at last the uniform and one-word parts alone.

    Each chunk of texts asks for the corpus counts of its distinct words and pairs of words, packed
    per key range; so counts are exact sums over all documents and hot words cost one entry per
    chunk. Only the grid of held-out counts (bounded by its classes and steps) and the weights
    (three numbers per class) pass through the driver.
    """
    table = C.write_chunks(docs, "lm")
    ranges = C.key_ranges(table)
    replies = C.ask_all(table, lambda row: _ask(row, ranges), _answer, "lm-counts")
    sums = replies.where(F.col("kind") == UNIGRAM).agg(F.sum("total"), F.sum("distinct")).first()
    n, v = int(sums[0] or 0), int(sums[1] or 0)
    uniform = 1.0 / (v + 1)

    def grid(row, reply: pd.DataFrame) -> pd.DataFrame:
        s, uni, uni_held, bi, bi_held, context, context_held = _counts(row, reply)
        h = s.held
        rest = context[h] - context_held[h]
        two, one = _share(bi[h] - bi_held[h], rest), (uni[h] - uni_held[h])
        cells = np.stack([_class(rest), *[
            np.where(x > 0, np.round(np.log2(np.maximum(x, 1e-300)) * STEP), 1).astype(np.int64) for x in (two, one)]])
        unique, count = np.unique(cells, axis=1, return_counts=True)
        return pd.DataFrame({"cls": unique[0], "q2": unique[1], "c1": unique[2], "n": count})

    held = C.with_replies(table, replies, grid, "cls long, q2 long, c1 long, n long")
    cells = held.groupBy("cls", "q2", "c1").agg(F.sum("n").alias("n")).toPandas()
    known = cells["c1"].to_numpy()
    deleted = n - float(cells["n"].sum())
    log_n = np.round(np.log2(max(deleted, 1.0)) * STEP)
    # one-word counts on the grid become shares of the training tokens that are left
    cells["q1"] = np.where(known == 1, 1, np.minimum(known - log_n, 0)).astype(np.int64)
    weights = learn_weights(cells, uniform)
    lists = np.zeros((64, 3))
    last = (0.0, 0.5, 0.5)
    for cls in range(64):
        last = weights.get(cls, last)
        lists[cls] = last

    def score(row, reply: pd.DataFrame) -> pd.DataFrame:
        s, uni, _, bi, _, context, _ = _counts(row, reply)
        w = lists[_class(context)]
        p = w[:, 0] * _share(bi, context) + w[:, 1] * (uni / max(n, 1)) + w[:, 2] * uniform
        base = np.log10((uni + 1) / (n + v + 1))
        return pd.DataFrame({
            "doc_id": pd.array(C.ids_of(row), "Int64"), "held_out": s.folds == TEST_FOLD, "n_tokens": s.counts,
            "n_known": np.add.reduceat((uni > 0).astype(np.int64), s.starts), "train_tokens": n,
            "base_score": np.add.reduceat(base, s.starts),
            "score": np.add.reduceat(np.log10(np.maximum(p, 1e-300)), s.starts)})

    return C.with_replies(table, replies, score, "doc_id long, held_out boolean, n_tokens long, n_known long, "
                          "train_tokens long, base_score double, score double")
