"""Scores, distances and the order of shards against plain versions of the same methods."""

import collections
import math
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from graderoom.llm import lm, quality
from graderoom.llm.sharding import SEED, interleave


def word_list(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def spark_hash(seed, key):
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=42)
    if key is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=h)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("shards", [16, 7])
def test_every_row_has_the_place_of_the_plain_order(docs_of, shards):
    rows = [(i, "é" * (i % 9), "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
    rows += [(None, None, None), (None, "x", "hot"), (5, "", "hot"), (5, "", "hot"), (-7, "last", None)]
    crc = lambda t: zlib.crc32((t or "").encode())
    least = -(1 << 70)
    sort = lambda r: (spark_hash(SEED, r[0]), least if r[0] is None else r[0], crc(r[1]))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    placed = []
    for part in by.values():
        placed += [((at + 0.5) / len(part), r) for at, r in enumerate(sorted(part, key=sort))]
    placed.sort(key=lambda p: (p[0], *sort(p[1])))
    n = len(rows)
    want = collections.Counter()
    for at, (_, r) in enumerate(placed):
        shard = at * shards // n
        want[(r[0], crc(r[1]), len((r[1] or "").encode()) + 1, shard, at - -(-shard * n // shards))] += 1
    got = interleave(docs_of(*rows), shards).collect()
    assert collections.Counter((r.doc_id, r.text_crc32, r.size, r.shard, r.slot) for r in got) == want


def plain_scores(rows):
    """Deleted interpolation with dictionaries: score per (doc_id, text)."""
    lower = lambda t: (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    uni, uni_held, bi, bi_held = (collections.Counter() for _ in range(4))
    pairs_of = lambda t: list(zip(["START", *lower(t)], [*lower(t), "END"]))
    for doc, text in rows:
        for a, b in pairs_of(text):
            if lm.fold_of(doc) != lm.TEST_FOLD:
                uni[b] += 1
                bi[a, b] += 1
            if lm.fold_of(doc) == lm.HELD_FOLD:
                uni_held[b] += 1
                bi_held[a, b] += 1
    uni["START"], uni_held["START"] = uni["END"], uni_held["END"]
    n, v = sum(c for w, c in uni.items() if w != "START"), sum(c > 0 for w, c in uni.items() if w != "START")
    uniform, total_held = 1 / (v + 1), sum(c for w, c in uni_held.items() if w != "START")
    log_n = round(math.log2(max(n - total_held, 1)) * lm.STEP)
    cells = collections.defaultdict(collections.Counter)
    for doc, text in rows:
        if lm.fold_of(doc) == lm.HELD_FOLD:
            for a, b in pairs_of(text):
                rest, pair, one = uni[a] - uni_held[a], bi[a, b] - bi_held[a, b], uni[b] - uni_held[b]
                f2 = 2 ** (round(math.log2(pair / rest) * lm.STEP) / lm.STEP) if pair else 0.0
                f1 = 2 ** (min(round(math.log2(one) * lm.STEP) - log_n, 0) / lm.STEP) if one else 0.0
                cells[int(math.log2(rest + 1))][f2, f1, uniform] += 1
    weights, last = {}, (0.0, 0.5, 0.5)
    for cls in range(64):
        if cls in cells:
            last = (1 / 3, 1 / 3, 1 / 3)
            for _ in range(lm.EM_ROUNDS):
                new = [0.0] * 3
                for f, count in cells[cls].items():
                    mix = sum(x * w for x, w in zip(f, last))
                    for i in range(3):
                        new[i] += count * f[i] * last[i] / mix
                last = tuple(x / sum(cells[cls].values()) for x in new)
        weights[cls] = last
    out = []
    for doc, text in rows:
        score = 0.0
        for a, b in pairs_of(text):
            w = weights[int(math.log2(uni[a] + 1))]
            score += math.log10(w[0] * (bi[a, b] / uni[a] if uni[a] else 0) + w[1] * uni[b] / max(n, 1) + w[2] * uniform)
        out.append((-1 if doc is None else doc, lm.fold_of(doc) == lm.TEST_FOLD, round(score, 6)))
    return sorted(out), weights


def test_language_model_scores(docs_of):
    rng = random.Random(11)
    vocabulary = word_list(rng, 40)
    rows = [(i, " ".join(vocabulary[min(int(rng.expovariate(0.12)), 39)] for _ in range(rng.randint(1, 60)))) for i in range(150)]
    rows += [(151, None), (152, " \n"), (None, "ABC " + vocabulary[0].upper()), (3, "again again again"), (153, " ".join(word_list(rng, 500)))]
    want, weights = plain_scores(rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, round(r.score, 6)) for r in lm.score_documents(docs_of(*rows)).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-5, rtol=0)
    assert len(set(weights.values())) > 3  # contexts seen more often trust their pairs more


def plain_distances(rows):
    """Minimum covariance determinant by concentration, per group, over vectors in memory."""
    counts = [quality.text_statistics(t) for _, t, _ in rows]
    share = lambda a, b: math.sqrt(a / max(b, 1))
    x = np.array([[math.log(max(c, 1) / max(n, 1)), share(s, c), share(d, lines), share(r, n), share(u, c)]
                  for n, c, s, d, r, lines, u in counts])
    x = np.floor(x * quality.STEPS + 0.5) / quality.STEPS
    good = np.array([n >= quality.MIN_WORDS and 100 * r <= 50 * n for n, _, _, _, r, _, _ in counts])
    lower_median = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]

    def fit(part):
        centre = lower_median(part)
        scale = np.maximum(lower_median(np.abs(part - centre)) * 1.4826, quality.FLOOR)
        inverse = np.diag(scale ** -2.0)
        for _ in range(quality.ROUNDS):
            d = np.einsum("ij,jk,ik->i", part - centre, inverse, part - centre)
            step = np.floor(np.log1p(d) * quality.DISTANCE_STEPS)
            near = part[step <= np.sort(step)[math.ceil(quality.SHARE * len(part)) - 1]]
            centre = near.mean(axis=0)
            cov = quality.CONSISTENT * np.cov(near.T, bias=True)
            regular = (1 - quality.SHRINK) * cov
            np.fill_diagonal(regular, np.maximum(np.diag(cov), np.array(quality.FLOOR) ** 2))
            inverse = np.linalg.inv(regular)
        return centre, inverse

    sources = np.array([s for _, _, s in rows])
    out = []
    for i, (doc, _, source) in enumerate(rows):
        own = good & (sources == source)
        part = x[own] if own.sum() >= quality.LEAST_ROWS else x[good]
        centre, inverse = fit(part)
        d = float((x[i] - centre) @ inverse @ (x[i] - centre))
        out.append((doc, round(d, 3), bool(good[i]) and d <= quality.CUT))
    return out


def test_outliers_are_those_of_the_plain_estimate(docs_of):
    rng = random.Random(29)
    rows = []
    for i in range(260):
        words = word_list(rng, 60 + i % 70)
        if i % 11 == 0:
            words = [w.upper() for w in words]
        if i % 13 == 0:
            words = [w + rng.choice(["", "#", "$$", "<>"]) for w in words]
        if i % 29 == 0:
            words = [w + "####" for w in words]
        text = " ".join(words) if i % 5 else "\n".join(" ".join(words[k:k + 9]) for k in [0, 0, 0, *range(9, len(words), 9)])
        rows.append((i, text, ["a", "b", "few"][0 if i % 20 < 11 else 1 if i % 20 < 18 else 2]))
    rows += [(260, "too short", "a"), (261, "no no no " * 40, "b")]
    docs = docs_of(*rows).drop("kept")
    stats = quality.with_statistics(docs)
    got = {r.doc_id: r for r in quality.judge(stats, quality.estimate(stats)).drop("_q", "_x").collect()}
    want = plain_distances(rows)
    assert [got[d].kept for d, _, _ in want] == [kept for _, _, kept in want]
    assert np.allclose([got[d].distance for d, _, _ in want], [x for _, x, _ in want], atol=2e-3)
    kept = collections.Counter(k for _, _, k in want)
    assert kept[False] > 2 and kept[True] > 200
