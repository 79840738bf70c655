"""Ranked lexical search over sharded inverted lists by Block-Max MaxScore.

Each shard holds whole documents and, per term, a list of (document, occurrences) in blocks: offsets from
the block's first document in the fewest whole bytes. A block can be passed over without unpacking it, by
the largest impact it holds. Per item and shard:

* the lists are ordered by their global bound, term weight times largest impact; as long as the bounds of the
  remaining lists could still lift a document over the threshold, the next list is essential and read whole;
* documents that only occur in the other lists cannot qualify. The rest are held against the maxima of the
  blocks they would be in: what cannot reach the threshold goes before any of those blocks is unpacked.

The threshold is the k-th best score found so far, or that of a pilot: some sqrt(shards) shards are searched
first, and their merged k-th scores start the others. So of S shards some sqrt(S) * k rows per item are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graderoom.llm import chunks as C
from graderoom.llm.common import NO_ID, discard, materialise
from graderoom.llm.lm import word_hashes
from graderoom.llm.tokens import by_bytes

TOP = 50
#: UTF-8 bytes of text that fill a shard (one document at least), and postings of a block.
SHARD_BYTES, BLOCK = 24_000_000, 128
#: A text is split into terms so many bytes at a time, cut between terms.
PIECE_BYTES = 3_000_000
#: Items are searched in sets with at most so many bytes of text; while there is one set, only its terms are indexed.
ITEM_BYTES = 4_000_000
#: Bytes below 0x80 that belong to no term: all but digits and letters.
BETWEEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
WIDTHS = ((1, np.uint8), (2, np.uint16), (4, np.uint32))
INDEX = ("shard long, n_docs long, n_terms long, doc_ids array<long>, sizes array<long>, terms binary, counts binary, "
         "firsts binary, lasts binary, widths binary, streams array<binary>")
HITS = "item int, doc_id long, score long"


def _ramp(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the runs, one after the other."""
    done = np.cumsum(sizes)
    return np.repeat(starts - done + sizes, sizes) + np.arange(int(done[-1]) if len(done) else 0)


def pieces(data: np.ndarray, step: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of about ``step`` bytes that end between terms; a longer term stays in one run."""
    at = 0
    while len(data) - at > step:
        end = at + step
        gaps = np.flatnonzero(BETWEEN[data[at:end]])
        if len(gaps):
            end = at + int(gaps[-1]) + 1
        else:
            while end < len(data) and not BETWEEN[data[end]]:
                more = np.flatnonzero(BETWEEN[data[end:end + step]])
                end = min(len(data), end + (int(more[0]) if len(more) else step))
        yield at, end
        at = end
    yield at, len(data)


def term_counts(data: np.ndarray, edges: np.ndarray, vocabulary: np.ndarray | None) -> tuple:
    """Terms per text, and the distinct (term, text) with their occurrences; of the vocabulary, if there is one."""
    hashes, text = word_hashes(data, edges, BETWEEN)
    n = len(edges) - 1
    sizes = np.bincount(text, minlength=n)
    if vocabulary is None:
        known, which = np.unique(hashes, return_inverse=True)
    else:
        known = vocabulary
        which = np.searchsorted(known, hashes)
        which[which == len(known)] = 0
        some = known[which] == hashes if len(known) else np.zeros(len(hashes), bool)
        which, text = which[some], text[some]
    pairs, counts = np.unique(which.astype(np.int64) * n + text, return_counts=True)
    return sizes, known[pairs // n] if n else known[:0], pairs % n if n else pairs, counts


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the blocks of all lists start among the postings, and how many each list has."""
    each = -(-counts // BLOCK)
    within = _ramp(np.zeros(len(each), np.int64), each)
    return np.repeat(np.cumsum(counts) - counts, each) + BLOCK * within, each


def _width(largest: np.ndarray) -> np.ndarray:
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4)).astype(np.uint8)


class Builder:
    """Collects the postings of documents and packs them as one shard."""

    def __init__(self, vocabulary: np.ndarray | None):
        self.vocabulary, self.held = vocabulary, 0
        self.ids: list[int] = []
        self.sizes: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: list[int], data: np.ndarray, edges: np.ndarray) -> None:
        first = len(self.ids)
        self.ids += ids
        self.held += len(data)
        if len(ids) > 1 or len(data) <= PIECE_BYTES:
            sizes, *postings = term_counts(data, edges, self.vocabulary)
            self._keep(first, postings)
        else:
            sizes = np.zeros(1, np.int64)
            for lo, hi in pieces(data):
                more, *postings = term_counts(data[lo:hi], np.array([0, hi - lo]), self.vocabulary)
                sizes = sizes + more
                self._keep(first, postings)
        self.sizes.append(sizes)

    def _keep(self, first: int, postings: list[np.ndarray]) -> None:
        terms, docs, counts = postings
        self.parts.append((terms, (docs + first).astype(np.uint32), counts.astype(np.uint32)))

    def packed(self, number: int) -> pa.RecordBatch:
        terms, docs, tf = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        by = np.lexsort((docs, terms))
        terms, docs, tf = terms[by], docs[by].astype(np.int64), tf[by].astype(np.int64)
        if len(terms):  # the pieces of a long text repeat its terms
            new = np.append(True, (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1]))
            tf, terms, docs = np.add.reduceat(tf, np.flatnonzero(new)), terms[new], docs[new]
        known, counts = np.unique(terms, return_counts=True)
        starts, _ = _blocks(counts)
        sizes = np.diff(np.append(starts, len(docs)))
        firsts, lasts = docs[starts], docs[starts + sizes - 1]
        largest = np.maximum.reduceat(tf, starts) if len(starts) else tf
        widths = np.stack([_width(lasts - firsts), _width(largest)])
        values = (docs - np.repeat(firsts, sizes), tf)
        streams = [v[np.repeat(w == size, sizes)].astype(kind).tobytes()
                   for v, w in zip(values, widths) for size, kind in WIDTHS]
        lengths = np.concatenate(self.sizes)
        row = {"shard": [number], "n_docs": [int((lengths > 0).sum())], "n_terms": [int(lengths.sum())], "doc_ids": [self.ids],
               "sizes": [lengths], "terms": [C.squeeze_sorted(known)], "counts": [C.squeeze(counts.astype(np.uint32))],
               "firsts": [C.squeeze(firsts.astype(np.uint32))], "lasts": [C.squeeze(lasts.astype(np.uint32))],
               "widths": [C.squeeze(widths.ravel())], "streams": [streams]}
        kinds = {"doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "streams": pa.list_(pa.binary())}
        kinds |= {c: pa.int64() for c in ("shard", "n_docs", "n_terms")}
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([(c, kinds.get(c, pa.binary())) for c in row]))


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards of inverted lists over all rows of ``docs`` (doc_id, text), written once.

    ``vocabulary`` (sorted hashes of terms) leaves other terms out of the lists; they still count in the lengths
    of the documents. A null text has no term. The shards say nothing of the whole corpus, so those of
    more documents can be added.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, Builder(vocabulary)
        for batch in batches:
            for some in by_bytes(batch):
                raw = some["text"].fill_null(b"").cast(pa.large_binary())
                edges = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
                body = raw.buffers()[2]
                data = np.frombuffer(body, np.uint8)[edges[0]:edges[-1]] if body is not None else np.zeros(0, np.uint8)
                if shard.ids and shard.held + len(data) > shard_bytes:
                    yield shard.packed(number)
                    number, shard = number + 1, Builder(vocabulary)
                shard.add(some["doc_id"].to_pylist(), data, edges - edges[0])
        if shard.ids:
            yield shard.packed(number)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.col("text").cast("binary").alias("text"))
    return materialise(rows.mapInArrow(build, INDEX), "lexical-shards")


class Shard:
    """The lists of one shard; blocks are unpacked as they are asked for."""

    def __init__(self, row):
        self.ids, self.lengths = np.asarray(row.doc_ids, np.int64), np.asarray(row.sizes, np.int64)
        self.terms, self.counts = C.stretch_sorted(row.terms), C.stretch(row.counts, np.uint32).astype(np.int64)
        starts, each = _blocks(self.counts)
        self.stops = np.cumsum(each)
        self.sizes = np.diff(np.append(starts, self.counts.sum()))
        self.firsts, self.lasts = (C.stretch(x, np.uint32).astype(np.int64) for x in (row.firsts, row.lasts))
        self.widths = C.stretch(row.widths, np.uint8).reshape(2, -1)
        self.streams = [np.frombuffer(x, WIDTHS[i % 3][1]) for i, x in enumerate(row.streams)]
        self.places = np.zeros(self.widths.shape, np.int64)
        for k in range(2):
            for size, _ in WIDTHS:
                own = self.widths[k] == size
                self.places[k, own] = np.cumsum(self.sizes[own]) - self.sizes[own]
        self.unpacked = 0
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def blocks_of(self, which: int) -> tuple[int, int]:
        return int(self.stops[which - 1]) if which else 0, int(self.stops[which])

    def unpack(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and occurrences in the given blocks, in their order."""
        sizes = self.sizes[blocks]
        ends = np.cumsum(sizes)
        out = np.zeros((2, int(ends[-1]) if len(ends) else 0), np.int64)
        for k in range(2):
            for i, (size, _) in enumerate(WIDTHS):
                own = self.widths[k, blocks] == size
                if own.any():
                    here = _ramp(self.places[k, blocks[own]], sizes[own])
                    out[k, _ramp((ends - sizes)[own], sizes[own])] = self.streams[3 * k + i][here]
        out[0] += np.repeat(self.firsts[blocks], sizes)
        self.unpacked += len(blocks)
        return out[0], out[1]

    def set_corpus(self, n_docs: int, n_terms: int) -> None:
        """The lengths of all documents as the score's m, from the corpus' numbers of documents and terms."""
        if int(self.lengths.max(initial=0)) * n_docs * 50 < 1 << 62:
            self.m = 50 + 50 * self.lengths * n_docs // max(n_terms, 1)
        else:
            self.m = np.array([50 + 50 * int(x) * n_docs // n_terms for x in self.lengths], np.int64)

    def impacts(self, docs: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 20 * self.m[docs])

    def maxima(self) -> np.ndarray:
        """The largest impact of every block: unpacks all of them, a million postings at a time."""
        out = np.zeros(len(self.sizes), np.int64)
        for lo in range(0, len(out), 8192):
            blocks = np.arange(lo, min(lo + 8192, len(out)))
            starts = np.cumsum(self.sizes[blocks]) - self.sizes[blocks]
            out[blocks] = np.maximum.reduceat(self.impacts(*self.unpack(blocks)), starts)
        return out

    def set_maxima(self, packed: bytes) -> None:
        self.block_max = C.stretch(packed, np.uint32).astype(np.int64)
        starts = np.append(0, self.stops)[:-1]
        self.list_max = np.maximum.reduceat(self.block_max, starts) if len(starts) else self.block_max

    def read(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        """A whole list: documents and impacts. Kept, as items share terms."""
        if which not in self.whole:
            docs, tf = self.unpack(np.arange(*self.blocks_of(which)))
            self.whole[which] = docs, self.impacts(docs, tf)
        return self.whole[which]

    def best(self, lists: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents with the ``k`` highest scores of at least ``least``, and the scores."""
        bounds = weights * self.list_max[lists]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        lists, weights = lists[order], weights[order]
        rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
        scores = np.zeros(len(self.ids), np.int64)
        at = 0
        while at < len(lists) and rest[at] >= least:  # essential lists
            docs, impacts = self.read(lists[at])
            scores[docs] += weights[at] * impacts
            at += 1
            if rest[at] and len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        left = np.flatnonzero((scores > 0) & (scores + rest[at] >= least))
        places = np.zeros((len(lists) - at, len(left)), np.int64)
        above = np.zeros((len(lists) - at + 1, len(left)), np.int64)
        for j, (which, weight) in enumerate(zip(lists[at:], weights[at:])):
            lo, hi = self.blocks_of(which)
            place = lo + np.searchsorted(self.lasts[lo:hi], left)
            inside = place < hi
            inside[inside] = self.firsts[place[inside]] <= left[inside]
            places[j] = np.where(inside, place, -1)
            above[j, inside] = weight * self.block_max[place[inside]]
        above = np.cumsum(above[::-1], axis=0)[::-1]
        for j, weight in enumerate(weights[at:]):  # the other lists
            alive = scores[left] + above[j] >= least
            left, places, above = left[alive], places[:, alive], above[:, alive]
            inside = places[j] >= 0
            docs, tf = self.unpack(np.unique(places[j, inside]))
            if len(docs):
                asked = left[inside]
                found = np.minimum(np.searchsorted(docs, asked), len(docs) - 1)
                hit = docs[found] == asked
                scores[asked[hit]] += weight * self.impacts(asked[hit], tf[found[hit]])
            if len(left) >= k:
                least = max(least, int(np.partition(scores[left], len(left) - k)[len(left) - k]))
        left = left[scores[left] >= least]
        ids = self.ids[left]
        first = np.lexsort((ids, ids == NO_ID, -scores[left]))[:k]
        return ids[first], scores[left][first]


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator:
    for batch in batches:
        yield from batch.itertuples(index=False)


def corpus_size(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms, of all shards."""
    row = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return int(row[0] or 0), int(row[1] or 0)


def with_maxima(index: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The index with the largest impact of every block, which depends on the corpus as a whole."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            shard = Shard(row)
            shard.set_corpus(n_docs, n_terms)
            yield pd.DataFrame([row]).assign(maxima=[C.squeeze(shard.maxima().astype(np.uint32))])

    return materialise(index.mapInPandas(add, f"{INDEX}, maxima binary"), "lexical-index")


def frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """In how many documents each term of the vocabulary is."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            _, own, there = np.intersect1d(vocabulary, C.stretch_sorted(row.terms), return_indices=True, assume_unique=True)
            yield pd.DataFrame({"term": own, "n": C.stretch(row.counts, np.uint32)[there].astype(np.int64)})

    out = np.zeros(len(vocabulary), np.int64)
    found = index.select("terms", "counts").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for r in found.collect():  # at most a row per term of the vocabulary
        out[r.term] = r.n
    return out


def item_terms(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct term hashes of each text."""
    out = []
    for text in texts:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        out.append(np.unique(word_hashes(raw, np.array([0, len(raw)]), BETWEEN)[0]))
    return out


def _vocabulary(terms: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)


def _hits(index: DataFrame, terms: list[np.ndarray], vocabulary: np.ndarray, weights: np.ndarray,
          corpus: tuple[int, int], least: np.ndarray, k: int) -> DataFrame:
    own = [np.searchsorted(vocabulary, t) for t in terms]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            shard = Shard(row)
            shard.set_corpus(*corpus)
            shard.set_maxima(row.maxima)
            lists = np.searchsorted(shard.terms, vocabulary)
            lists[lists == len(shard.terms)] = 0
            there = shard.terms[lists] == vocabulary if len(shard.terms) else np.zeros(len(vocabulary), bool)
            found = []
            for item, which in enumerate(own):
                which = which[there[which]]
                if len(which):
                    ids, scores = shard.best(lists[which], weights[which], k, int(least[item]))
                    found.append(pd.DataFrame({"item": np.int32(item), "doc_id": ids, "score": scores}))
            if found:
                yield pd.concat(found, ignore_index=True)

    return index.mapInPandas(search, HITS)


def _merge(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    known = hits.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
    return known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_set(index: DataFrame, texts: list[str | None], k: int, corpus: tuple[int, int]) -> DataFrame:
    terms = item_terms(texts)
    vocabulary = _vocabulary(terms)
    df = frequencies(index, vocabulary)
    weights = np.array([math.floor(1000 * math.log((2 * corpus[0] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    least = np.ones(len(texts), np.int64)
    share = 1 / math.sqrt(max(index.count(), 1))
    pilot = F.pmod(F.xxhash64("shard"), F.lit(1 << 20)) < int(share * (1 << 20))
    first = materialise(_hits(index.where(pilot), terms, vocabulary, weights, corpus, least, k), "lexical-pilot")
    for r in _merge(first, k).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).collect():
        if r.n == k:  # a row per item of the set at most
            least[r.item] = r.s
    rest = _hits(index.where(~pilot), terms, vocabulary, weights, corpus, least, k)
    return materialise(_merge(first.union(rest), k), "lexical-found")


def _sets(items: DataFrame, id_col: str) -> Iterator[list]:
    """The items in sets of at most ``ITEM_BYTES`` of text, one in the driver at a time."""
    held, size = [], 0
    for row in items.select(F.col(id_col).alias("id"), "text").toLocalIterator():
        n = len((row.text or "").encode("utf-8", "surrogatepass"))
        if held and size + n > ITEM_BYTES:
            yield held
            held, size = [], 0
        held.append(row)
        size += n + 16
    if held:
        yield held


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "item_id") -> DataFrame:
    """The ``k`` best documents for every item: item_id, rank, doc_id, score.

    Terms are runs of letters A-Z and a-z, digits and characters beyond ASCII, A-Z lower-cased; terms are told
    apart by 64-bit hashes. The score is the sum over an item's terms of
    ``w * (10^9 tf div (1000 tf + 20 m))`` as the contract has it; documents with score 0 are not ranked. Equal
    scores go by ascending doc_id, null last; rows that repeat a doc_id are documents of their own.
    Null and empty texts match nothing, items without a term or a match have no row, items that repeat an
    id are ranked each. Empty tables give an empty table. A text of any length is in one shard, its
    terms counted piece by piece. Items go set by set; with one set, only its terms are indexed.
    """
    spark = docs.sparkSession
    kind = items.schema[id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"{id_col} {kind}, rank int, doc_id long, score long")
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    index = corpus = None
    for rows in _sets(items, id_col):
        texts = [r.text for r in rows]
        if index is None:
            raw = build_index(docs, _vocabulary(item_terms(texts)) if total <= ITEM_BYTES else None)
            corpus = corpus_size(raw)
            index = with_maxima(raw, *corpus)
            discard(raw)
        found = _search_set(index, texts, k, corpus)
        names = spark.createDataFrame([(i, r.id) for i, r in enumerate(rows)], f"item int, {id_col} {kind}")
        out = out.union(found.join(F.broadcast(names), "item").select(id_col, "rank", "doc_id", "score"))  # one set
    return out
