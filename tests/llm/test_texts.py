"""Operators on whole texts against brute force on small tables with odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from graderoom.llm import exact, quality
from graderoom.llm.decontaminate import find_leaks, without_leaks
from graderoom.llm.lm import score_documents
from graderoom.llm.neardup import near_duplicates, one_of_each
from graderoom.llm.tokens import encode_documents, pack, unpack
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    long = prose(rng, 300)
    words = long.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1:]) for k in (40, 120, 260)]
    passage = prose(rng, 60)
    rows = [(5, long), (1, near[0]), (9, near[1]), (2, near[2]), (7, long), (3, None), (4, ""), (6, " \t\n"),
            (8, "one two"), (10, "One  two"), (11, passage + " " + prose(rng, 90)), (12, prose(rng, 80) + "\n" + passage),
            (13, "ab" * 400), (14, "é" * 120), (15, "x " * 300), (16, prose(rng, 5)), (17, prose(rng, 3000)),
            (None, "nobody " + passage), (18, "Ünï " + prose(rng, 40).upper()), (8, "one two")]
    return rows


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for bits in (1, 3, 7, 8, 13, 16, 17, 31, 32):
        ids = rng.integers(0, 1 << bits, 501, dtype=np.uint64).astype(np.uint32)
        packed = pack(ids, bits)
        assert len(packed) == -(-501 * bits // 8)
        assert (unpack(packed, bits, 0, 501) == ids).all() and (unpack(packed, bits, 77, 300) == ids[77:300]).all()


def test_tokens(docs_of, texts):
    rows = texts + [(20, "a  b   c\n\nd <|endoftext|> e"), (21, "日本 語　x y")]
    t = Tokenizer.from_file(PATH)
    got = sorted(encode_documents(docs_of(*rows), PATH).collect(), key=lambda r: r.start)
    want, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    assert encode_documents(docs_of().limit(0), PATH).count() == 0


def test_exact_repeats(docs_of, texts):
    rows = [r for r in texts if r[0] is not None][:-1]
    got = {r.doc_id: r for r in exact.summarise(exact.remove_repeats(docs_of(*rows))).collect()}
    seen = set()
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p:p + 100] in seen:
                gone[p:p + 100] = True
            seen.add(raw[p:p + 100])
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum()) if raw else 0
        r = got[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (
            len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), doc
    assert exact.remove_repeats(docs_of().limit(0)).count() == 0


def test_language_model(docs_of, texts):
    rng = random.Random(5)
    vocabulary = prose(rng, 60).split()
    chain = [(100 + i, " ".join(vocabulary[(i * 7 + j * (1 + i % 2)) % 60] for j in range(80))) for i in range(80)]
    rows = texts + chain
    lower = lambda t: (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    fold = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7
    counts = collections.Counter(w for d, t in rows if fold(d) != 2 for w in lower(t) + [None])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for d, t in rows:
        tokens = lower(t) + [None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        want[(d, fold(d) == 2, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6))] += 1
    scored = score_documents(docs_of(*rows)).collect()
    assert want == collections.Counter(
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored)
    held = [r for r in scored if r.held_out and (r.doc_id or 0) >= 100]
    assert held and sum(r.score - r.base_score for r in held) > 0
    assert all(math.isfinite(r.score) and r.score < 0 for r in scored)
    assert score_documents(docs_of().limit(0)).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs_of, texts):
    rows = texts[:-1]
    sets = {d: shingles(t) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r for r in near_duplicates(docs_of(*rows)).collect()}
    for d, s in sets.items():
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (len(s), root(d), root(d) == d)
    left = one_of_each(docs_of(*texts))
    assert left.columns == docs_of(*texts).columns
    kept = [r.doc_id for r in left.where("doc_id is not null").collect()]
    assert sorted(kept) == sorted(d for d in sets if root(d) == d)
    assert near_duplicates(docs_of().limit(0)).count() == 0


def test_a_family_needs_no_star(docs_of):
    """A chain of edits is one component, though its ends are far apart."""
    rng = random.Random(11)
    words, rows = prose(rng, 200).split(), []
    for i in range(40):
        words = list(words)
        words[(i * 5) % 200] = f"edit{i}"
        rows.append((i, " ".join(words)))
    assert {r.component_id for r in near_duplicates(docs_of(*rows)).collect()} == {0}


def test_decontamination(spark, docs_of):
    rng = random.Random(17)
    item, other = prose(rng, 50), prose(rng, 30)
    w = item.split()
    edited = " ".join(["start"] + w[1:])
    rows = [(1, prose(rng, 200)), (2, prose(rng, 70) + " " + item.upper() + " " + prose(rng, 30)), (3, edited),
            (4, " ".join(w[:20])), (5, None), (6, ""), (7, prose(rng, 9) + " three word item"), (7, prose(rng, 20)),
            (None, other)]
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (5, "three word item")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in find_leaks(docs_of(*rows), bench).collect()}
    assert set(got) == {(2, 1), (3, 1), (7, 5), (None, 2)}
    assert got[(2, 1)].start == 70 and got[(2, 1)].similarity == 1.0 and got[(2, 1)].hamming == 0
    left = [(r.doc_id, r.text) for r in without_leaks(docs_of(*rows), bench).collect()]
    assert sorted(left, key=str) == sorted([rows[k][:2] for k in (0, 3, 4, 5, 7)], key=str)
    assert find_leaks(docs_of().limit(0), bench).count() == 0
    assert find_leaks(docs_of(*rows), bench.limit(0)).count() == 0


def test_quality(docs_of, texts):
    rng = random.Random(23)
    clean = [(i, prose(rng, 60 + i % 90) + ".") for i in range(100, 400)]
    junk = [(i, " ".join(x + "###$$$" for x in prose(rng, 80).split())) for i in range(400, 410)]
    assert quality.text_statistics("a b c\na b c\n\n#x") == (7, 8, 1, 1, 6, 3, 0)
    docs = docs_of(*clean, *junk, *texts)
    stats = quality.with_statistics(docs)
    judged = {r.doc_id: r for r in quality.judge(stats, quality.estimate(stats)).drop("_q", "_x").collect()}
    assert all(judged[d].base_failed is False for d, _ in clean + junk)
    assert sum(r.distance < quality.CUT for d, r in judged.items() if d and 100 <= d < 400) == 300
    assert all(judged[d].distance > quality.CUT for d, _ in junk)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {d for d, _ in clean} <= {r.doc_id for r in good.collect()}
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_decontamination_finds_reordered_copies(spark, docs_of):
    """Swapped halves move every shared shingle, yet one window has most of the item's shingles."""
    rng = random.Random(29)
    sizes = (50, 80, 120)
    items = [prose(rng, n).split() for n in sizes]
    swapped = [" ".join(prose(rng, 100).split() + w[len(w) // 2:] + w[:len(w) // 2] + prose(rng, 100).split()) for w in items]
    thirds = items[2][80:] + items[2][40:80] + items[2][:40]
    rows = [*enumerate(swapped), (3, " ".join(thirds)), (4, " ".join(items[2][6:])), (5, prose(rng, 400)),
            (6, " ".join(items[0][:25]) + " " + prose(rng, 90) + " " + " ".join(items[0][25:]))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")

    def grams(words):
        return collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))

    want = {}
    for d, text in rows:
        words = text.split()
        for i, item in enumerate(items):
            own = grams(item)
            for at in range(max(len(words) - len(item), 0) + 1):
                window = grams(words[at:at + len(item)])
                both = (own & window).total()
                score = both / (own.total() + window.total() - both)
                if score >= 0.75 and score > want.get((d, i), (0, 0))[0]:
                    want[d, i] = score, at
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in find_leaks(docs_of(*rows), bench).collect()}
    assert set(want) == {(0, 0), (1, 1), (2, 2), (3, 2), (4, 2)} and got == want


def test_one_of_each_tells_rows_apart(docs_of):
    """Null and repeated ids: every distinct text stays once, every copy goes."""
    rng = random.Random(31)
    a, b, c, d, e, f = (prose(rng, 80) for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, c + " end"), (1, c), (2, d), (2, e), (3, e + " end"), (3, f), (4, f),
            (0, d + " end"), (5, ""), (5, ""), (None, None), (None, None)]
    left = one_of_each(docs_of(*rows)).collect()
    want = [(None, a), (None, b), (1, c), (2, e), (3, f), (0, d + " end"), (5, ""), (5, ""), (None, None), (None, None)]
    assert collections.Counter((r.doc_id, r.text) for r in left) == collections.Counter(want)


def test_leaks_of_rows_without_an_id(spark, docs_of):
    """A leak in one row without a doc_id says nothing about the others."""
    rng = random.Random(37)
    item, clean = prose(rng, 40), prose(rng, 60)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = without_leaks(docs_of((None, item), (None, clean), (None, clean), (None, None), (1, item), (2, clean)), bench)
    assert collections.Counter((r.doc_id, r.text) for r in left.collect()) == collections.Counter(
        [(None, clean), (None, clean), (None, None), (2, clean)])
