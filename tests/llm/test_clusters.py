"""Centroid clustering against plain whole-number arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest
from graderoom.llm.clusters import Tournament, cluster_vectors, digest, with_inertia

DIMS = 6


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def plain(rows, k, rounds):
    points = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
              if v is not None and len(v) == DIMS and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda p: (hashlib.sha256(f"3:{'' if p[0] is None else p[0]}".encode()).hexdigest(), p[0] or 0, p[1])
    centroids = [p[1] for p in sorted(points, key=key)[:k]]
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in points]
        for c in range(len(centroids)):
            members = [v for (_, v), o in zip(points, own) if o == c]
            if members:
                centroids[c] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, nearest(v), far(v, centroids[nearest(v)])) for i, v in points]
    return sorted(found, key=str), centroids


@pytest.mark.parametrize("k,rounds", [(1, 2), (4, 5), (200, 3)])
def test_against_plain_arithmetic(spark, k, rounds):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(i % 3, 0.4) for _ in range(DIMS)]) for i in range(90)]
    rows += [(100, None), (101, []), (102, [1.0] * (DIMS + 1)), (103, [1.0] * (DIMS - 1) + [None]), (104, [float("nan")] * DIMS),
             (105, [float("inf")] * DIMS), (106, [-0.0] * DIMS), (None, [0.5] * DIMS), (5, [0.5] * DIMS), (5, [0.5] * DIMS)]
    table = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, id string")
    got, centroids = cluster_vectors(table.repartition(7), k, rounds, dims=DIMS)
    want, finals = plain(rows, k, rounds)
    assert sorted(map(tuple, got.collect()), key=str) == want and centroids == finals
    facts = {r.vec_id: r for r in with_inertia(got, centroids).collect()}
    assert {r.inertia for r in facts.values()} == {sum(d for *_, d in want)}
    one = facts[3]
    assert one.cluster_inertia == sum(d for _, c, d in want if c == one.cluster)
    assert one.centroid_sha256 == digest(finals[one.cluster])


def test_large_components_stay_exact(spark):
    rows = [(i, [s * 1e5, s * 70_000.25, 1.0, 2.0, 3.0, 4.0]) for i, s in enumerate((1, -1, 1.0001, -1.0002))]
    rows += [(9, [1e18] * DIMS)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, centroids = cluster_vectors(table, 3, 4, dims=DIMS)
    want, finals = plain(rows, 3, 4)
    assert sorted(map(tuple, got.collect()), key=str) == want and centroids == finals
    assert centroids and max(map(max, centroids)) > 1 << 60


def test_distance_beyond_a_long_is_null(spark):
    table = spark.createDataFrame([(1, [1e18] * DIMS), (2, [-1e18] * DIMS)], "vec_id long, embedding array<double>")
    got, centroids = cluster_vectors(table, 1, 1, dims=DIMS)
    rows = with_inertia(got, centroids).collect()
    assert len(rows) == 2 and all(r.distance is None and r.inertia is None for r in rows)


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    got, centroids = cluster_vectors(table)
    assert centroids == [] and with_inertia(got, centroids).collect() == []


def test_zero_favours_the_smaller_number():
    best, distance = Tournament([[0, 0], [2, 0], [0, 0]]).nearest(np.array([[1, 0], [2, 0], [0, 5]]))
    assert best.tolist() == [0, 1, 0] and distance.tolist() == [1, 0, 25]
