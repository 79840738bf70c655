"""Lexical search against a plain ranking, with odd rows, small shards and long texts."""

import collections
import math
import random
import re

import numpy as np
import pytest
from graderoom.llm import lexical
from graderoom.llm.lexical import Shard, build_index, corpus_size, item_terms, pieces, rank_documents, with_maxima

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """Every document's score by the formula; (item place, rank, doc_id, score)."""
    bags = [collections.Counter(terms(t)) for _, t in docs]
    sizes = [sum(b.values()) for b in bags]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    out = []
    for item, (_, text) in enumerate(items):
        found = []
        for (doc, _), bag, size in zip(docs, bags, sizes):
            if size:
                m = 50 + 50 * size * n // length
                score = sum(weight[t] * (10 ** 9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if bag[t])
                if score > 0:
                    found.append((-score, doc is None, doc or 0, doc))
        out += [(items[item][0], r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(found)[:k])]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 120)))) for i in range(900)]
    rng.shuffle(rows)
    rows += [(1000, None), (1001, ""), (1002, " .,;! "), (1003, "Ünï-W1 w2"), (None, "w1 w250 w251"), (7, "w250 w251 W250"),
             (7, "w250 w251 W250"), (-4, "w250"), (1004, "日本 w1 " * 300), (1005, "w299 " + "w0 " * 70_000)]
    items = [(1, "w250 w251 w1 w0"), (2, "W7, w90!"), (2, "w7 w90"), (3, None), (4, ""), (5, "nothing here"),
             (None, "日本 ünï"), (6, " ".join(vocabulary))]
    return rows, items


def ranked(spark, rows, items, k):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, score int, item string")
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    return collections.Counter(map(tuple, rank_documents(docs, asked, k).collect()))


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_against_plain_ranking(spark, corpus, monkeypatch, k):
    monkeypatch.setattr(build_index, "__defaults__", (None, 20_000))  # many shards
    assert ranked(spark, *corpus, k) == collections.Counter(plain(*corpus, k))


def test_sets_of_items_search_an_index_of_all_terms(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 40)
    assert ranked(spark, *corpus, 10) == collections.Counter(plain(*corpus, 10))


def test_empty_tables(spark, corpus):
    rows, items = corpus
    assert not ranked(spark, [], items, 10) and not ranked(spark, rows, [], 10)
    assert not ranked(spark, [(1, None), (2, "")], items, 10)


def test_pieces_cut_between_terms():
    text = ("ab cd" * 50 + " " + "x" * 400 + ". é日").encode()
    data = np.frombuffer(text, np.uint8)
    runs = list(pieces(data, 64))
    assert runs[0][0] == 0 and runs[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    assert terms(text.decode()) == [t for lo, hi in runs for t in terms(text[lo:hi].decode())]


def test_blocks_are_passed_over(spark):
    """Common terms' blocks stay packed where no document in them can reach the threshold."""
    rows = [(i, f"common{i % 3} filler " + ("rare rare rare" if i % 900 == 0 else "")) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = build_index(docs)
    row = next(with_maxima(index, *corpus_size(index)).toPandas().itertuples(index=False))
    shard = Shard(row)
    shard.set_corpus(*corpus_size(index))
    shard.set_maxima(row.maxima)
    which = np.searchsorted(shard.terms, item_terms(["rare filler common0"])[0])
    weights = np.array([math.floor(1000 * math.log((2 * 9000 + 2) / (2 * int(c) + 1))) for c in shard.counts[which]])
    ids, _ = shard.best(which, weights, 5, 1)
    assert len(ids) == 5 and set(ids.tolist()) <= {i for i, _ in rows if i % 900 == 0}
    assert shard.unpacked < sum(b - a for a, b in map(shard.blocks_of, which)) / 2
