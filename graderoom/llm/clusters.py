"""Centroid clustering with whole numbers, nearest centroids found by a bisector tournament.

For centroids i < j, a vector x is nearer to j exactly if x lies beyond their bisector:
``2 x . (c_i - c_j) < |c_i|^2 - |c_j|^2``. The normals ``2 (c_i - c_j)`` and thresholds of all pairs are
computed once a round. Each vector then plays k - 1 linear sign tests, the winner of one meeting the next
centroid; zero favours the smaller number. Only the last winner's distance is computed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graderoom.llm.common import materialise

CLUSTERS, DIMS, ROUNDS, SEED, SCALE = 8, 64, 10, 3, 1024
#: Whole numbers up to this keep every product and sum over a vector in 64 bits; larger ones are computed
#: with Python's integers. Beyond ``FAR`` a vector's sums would not fit Spark's decimals.
NEAR, FAR = 1 << 26, 10 ** 26
LONG_MAX = (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """Rows (id, x) whose vector has exactly ``dims`` components, none null, infinite or not a number."""
    finite = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(FAR // SCALE))))
    return vectors.where((F.size(vector_col) == dims) & finite).select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))


def whole(x: pd.Series, dims: int, scale: int) -> np.ndarray:
    """Rows of whole numbers floor(scale * component): 64-bit where that is exact, else Python's integers."""
    values = np.floor(np.concatenate([np.asarray(v, np.float64) for v in x]).reshape(-1, dims) * scale)
    if np.abs(values).max(initial=0) <= NEAR:
        return values.astype(np.int64)
    return np.array([[int(v) for v in row] for row in values], object)


class Tournament:
    """Normals and thresholds of all pairs of centroids; ``nearest`` plays the tests."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = np.array(centroids, object)
        squares = (self.exact * self.exact).sum(axis=1)
        normals = 2 * (self.exact[:, None, :] - self.exact[None, :, :])
        thresholds = squares[:, None] - squares[None, :]
        self.small = max((abs(c) for row in centroids for c in row), default=0) <= NEAR
        kind = np.int64 if self.small else object
        self.centroids, self.normals, self.thresholds = (a.astype(kind) for a in (self.exact, normals, thresholds))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each row's nearest centroid, and its squared distance."""
        if not self.small or x.dtype == object:
            x = x.astype(object)
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            side = (x * self.normals[best, j]).sum(axis=1) - self.thresholds[best, j]
            best[np.asarray(side < 0, bool)] = j
        away = x - self.centroids[best]
        return best, (away * away).sum(axis=1)


def start(points: DataFrame, k: int, seed: int, scale: int, dims: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``; all, if fewer. Ties go by id and vector."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = points.select(key.alias("h"), "id", "x").orderBy("h", "id", "x").limit(k).collect()  # k rows
    return [[int(v) for v in whole(pd.Series([r.x]), dims, scale)[0]] for r in first]


def _sums(points: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Number and exact componentwise sums of every non-empty cluster: k * dims rows after the shuffle."""
    referee = Tournament(centroids)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), object)
        for batch in batches:
            if len(batch):
                x = whole(batch["x"], dims, scale)
                best, _ = referee.nearest(x)
                counts += np.bincount(best, minlength=len(centroids))
                for c in np.unique(best):
                    sums[c] += x[best == c].sum(axis=0).astype(object)
        some = np.flatnonzero(counts)
        if len(some):
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": counts[some],
                                "sums": [[str(v) for v in sums[c]] for c in some]})

    parts = points.select("x").mapInPandas(add, "cluster int, n long, sums array<string>")
    total = (
        parts.select("cluster", "n", F.posexplode("sums").alias("place", "s"))
        .groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in total.collect():  # at most k * dims rows
        out.setdefault(r.cluster, (r.n, [0] * dims))[1][r.place] = int(r.s)
    return out


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS,
                    scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """Assignment (id_col, cluster, distance) of every usable vector, and the final centroids.

    Components are taken as floor(scale * x). Centroids start as the vectors with the smallest sha256 of
    ``seed:id``; each round assigns all vectors and replaces every non-empty centroid by the componentwise
    floor of the mean, in exact whole numbers, so neither partitions nor retries change a digit. A round
    shuffles k * dims sums per task; the driver holds k vectors. Vectors with another number of components,
    with a null, or with one that is infinite, not a number or of 9 * 10^22 or more, are left out. A null id
    counts as '' in the seed's hash; rows that repeat an id are points of their own. With fewer than k
    vectors each starts a cluster; an empty table gives an empty table. A distance beyond 64 bits is null.
    """
    points = materialise(usable(vectors, id_col, vector_col, dims), "clusters-points")
    centroids = start(points, k, seed, scale, dims)
    for _ in range(rounds if centroids else 0):
        for c, (n, sums) in _sums(points, centroids, dims, scale).items():
            centroids[c] = [s // n for s in sums]
    referee = Tournament(centroids) if centroids else None

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                best, distance = referee.nearest(whole(batch["x"], dims, scale))
                yield pd.DataFrame({"id": batch["id"], "cluster": best.astype(np.int32), "distance": pd.array(
                    [d if d <= LONG_MAX else None for d in distance.tolist()], "Int64")})

    kind = points.schema["id"].dataType.simpleString()
    assigned = points.mapInPandas(assign, f"id {kind}, cluster int, distance long")
    return assigned.withColumnRenamed("id", id_col), centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(assigned: DataFrame, centroids: list[list[int]],
                 name: Callable[[list[int]], str] = digest) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256; sums beyond 64 bits, or of a null distance, are null."""
    spark = assigned.sparkSession
    kept = materialise(assigned, "clusters-assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    found = kept.groupBy("cluster").agg(
        F.when(F.count("distance") == F.count(F.lit(1)), exact).alias("s")).collect()  # at most k rows
    sums = {r.cluster: None if r.s is None else int(r.s) for r in found}
    total = None if None in sums.values() else sum(sums.values())
    fits = lambda v: v if v is not None and v <= LONG_MAX else None
    rows = [(c, fits(s), fits(total), name(centroids[c])) for c, s in sorted(sums.items())]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return kept.join(F.broadcast(facts), "cluster")  # at most k rows
