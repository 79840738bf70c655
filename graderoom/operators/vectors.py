"""Fingerprints, clustering, representatives, ensemble plans and seeded splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fingerprints


def mean_pool_long(responses: DataFrame, key: str = "model_identifier", vec: str = "embedding") -> DataFrame:
    """Element-wise mean of response vectors per model, long form (key, dim, value).
    posexplode + grouped avg: partial aggregation keeps one row per (key, dim) per partition."""
    return responses.select(key, F.posexplode(vec).alias("dim", "x")).groupBy(key, "dim").agg(
        F.avg("x").alias("value"))


def mean_pool_fingerprint(responses: DataFrame, key: str = "model_identifier", vec: str = "embedding") -> DataFrame:
    """One fingerprint array per model (dims in order); fails if a model's vectors differ in length."""
    long = mean_pool_long(responses, key, vec)
    dims = responses.groupBy(key).agg(F.min(F.size(vec)).alias("dmin"), F.max(F.size(vec)).alias("dmax"))
    fp = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("pairs"))
    fp = fp.join(dims, key).withColumn(
        "embedding",
        F.when(F.col("dmin") != F.col("dmax"), F.raise_error(F.lit("response vectors differ in length")))
        .otherwise(F.transform("pairs", lambda p: p["value"])),
    )
    return fp.select(key, "embedding")


def check_dimensions(fps: DataFrame, vec: str = "embedding") -> DataFrame:
    """Fail at run time if fingerprints do not all share one dimension."""
    n_dims = fps.agg(F.count_distinct(F.size(vec)).alias("n")).first()["n"]
    if n_dims > 1:
        raise ValueError("fingerprints have different dimensions")
    return fps


# ---------------------------------------------------------------- k-means


def sq_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, d: acc + d)


def kmeans_assign(points: DataFrame, centres: list[list[float]], key: str = "model_identifier",
                  vec: str = "embedding") -> DataFrame:
    """One Lloyd step from given centres: nearest centre (lowest index on ties) per point.
    The K centres are a bounded literal (K x dims) embedded in the expression, as MLlib broadcasts them."""
    lit_centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    dists = F.transform(lit_centres, lambda c, i: F.struct(sq_distance(F.col(vec), c).alias("d"), i.alias("cluster")))
    return points.withColumn("cluster", F.array_min(dists)["cluster"])


def kmeans_update(assigned: DataFrame, vec: str = "embedding") -> DataFrame:
    """Recompute centres as the mean of assigned points (long form: cluster, dim, value)."""
    return assigned.select("cluster", F.posexplode(vec).alias("dim", "x")).groupBy("cluster", "dim").agg(
        F.avg("x").alias("value"))


def kmeans_models(fps: DataFrame, k: int = 3, seed: int = 42, key: str = "model_identifier", vec: str = "embedding") -> DataFrame:
    """K-means (pyspark.ml) on fingerprints; labels are arbitrary, compare partitions, not numbers."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = fps.select(key, array_to_vector(vec).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(feats)
    return model.transform(feats).select(key, "cluster")


def pca_project(fps: DataFrame, key: str = "model_identifier", vec: str = "embedding") -> DataFrame:
    """2-component PCA projection with a sign normalisation (largest |loading| positive per component)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    feats = fps.select(key, array_to_vector(vec).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(feats)
    pcs = model.pc.toArray()
    signs = [1.0 if pcs[abs(pcs[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    out = model.transform(feats).select(key, vector_to_array("pc").alias("pc"))
    return out.select(key, (F.col("pc")[0] * signs[0]).alias("pc1"), (F.col("pc")[1] * signs[1]).alias("pc2"))


def embed_responses(texts: DataFrame, text: str = "solution", dims: int = 64) -> DataFrame:
    """Hashed token features per response as an array of length one: the counts of the lower-cased words (runs of
    ASCII letters, digits and underscores) by bucket, the first 32 bits of a word's md5 modulo ``dims``. A text without
    words has zeros, a null text null."""
    words = F.filter(F.split(F.lower(text), r"\W+", -1), lambda w: w != "")
    bucket = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dims
    d = texts.withColumn("_b", F.transform(words, lambda w: bucket(w).cast("int")))
    every = F.sequence(F.lit(0), F.lit(dims - 1))
    d = d.withColumn("_n", F.when(F.col("_b").isNotNull(), F.transform(every, lambda i: F.size(F.filter("_b", lambda x: x == i)))))
    d = d.withColumn("_l", F.sqrt(F.aggregate("_n", F.lit(0).cast("long"), lambda acc, n: acc + n.cast("long") * n)))
    scaled = F.transform("_n", lambda n: F.when(F.col("_l") > 0, n / F.col("_l")).otherwise(F.lit(0.0)))
    return d.withColumn("embedding", scaled).drop("_b", "_n", "_l")


# ---------------------------------------------------------------- representatives and plans


def cluster_members(assigned: DataFrame, key: str = "model_identifier") -> DataFrame:
    return assigned.groupBy("cluster").agg(
        F.array_join(F.sort_array(F.collect_list(key)), ",").alias("members"), F.count(F.lit(1)).alias("n_members"))


def cluster_representatives(models: DataFrame, key: str = "model_identifier") -> DataFrame:
    """Most accurate model per cluster (null accuracy skipped, ties -> smallest identifier), ranked by
    accuracy descending (ties keep cluster order)."""
    w = Window.partitionBy("cluster").orderBy(F.desc("accuracy"), F.asc(key))
    reps = models.where(F.col("accuracy").isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    order = Window.orderBy(F.desc("accuracy"), F.asc("cluster"))  # one row per cluster: K rows
    return reps.drop("_r").withColumn("rank", F.row_number().over(order))


def ensemble_plans(reps: DataFrame, models: DataFrame, key: str = "model_identifier") -> DataFrame:
    """Chains (ensemble, step, model, previous_model): the cluster chain, the top-n chain, best x n,
    least x n, plus one single-step baseline per model. n = number of representatives (at most K)."""
    n = reps.count()  # a bounded scalar (<= K)
    cluster_chain = reps.select(F.lit("cluster").alias("ensemble"), (F.col("rank") - 1).alias("step"), key)
    ranked = models.where(F.col("accuracy").isNotNull()).withColumn(
        "r", F.row_number().over(Window.orderBy(F.desc("accuracy"), F.asc(key))))
    top = ranked.where(F.col("r") <= n).select(F.lit("top").alias("ensemble"), (F.col("r") - 1).alias("step"), key)
    steps = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step")
    best = reps.where(F.col("rank") == 1).select(F.lit("best").alias("ensemble"), steps, key)
    least = reps.where(F.col("rank") == n).select(F.lit("least").alias("ensemble"), steps, key)
    base = ranked.select(F.concat(F.lit("baseline:"), F.col(key)).alias("ensemble"), F.lit(0).alias("step"), key)
    plans = cluster_chain.unionByName(top).unionByName(best).unionByName(least).unionByName(base)
    w = Window.partitionBy("ensemble").orderBy("step")
    return plans.withColumn("previous_model", F.lag(key).over(w))


# ---------------------------------------------------------------- seeded split

HASH_BUCKET_CHARS = 4  # 65 536 histogram buckets over the md5 prefix


def seeded_split(ids: DataFrame, seed: int = 42, ratio: float = 0.8, val_size: int | None = None,
                 key: str = "task_id") -> DataFrame:
    """Deterministic disjoint val/test split: ids ordered by md5('id:seed'); the first ``cut`` are val.

    No global sort or single-partition window over the ids: a histogram over the hash prefix
    (<= 65 536 rows) locates the boundary bucket, and only that bucket is ranked row by row.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    df = ids.select(key).withColumn("_h", h).withColumn("_b", F.substring("_h", 1, HASH_BUCKET_CHARS))
    hist = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_cnt").over(Window.partitionBy(F.lit(1)))
    if val_size is not None:
        cut = F.lit(int(val_size))
        check = F.when((cut < 1) | (cut >= total), F.raise_error(F.lit("val_size must be in 1..n-1")))
    else:
        cut = F.floor(total * F.lit(float(ratio))).cast("bigint")
        check = F.lit(None)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0))).withColumn(
        "_cut", F.when(check.isNull(), cut).otherwise(check.cast("bigint")))
    j = df.join(F.broadcast(hist.select("_b", "_before", "_cnt", "_cut")), "_b")
    # only the boundary bucket (about n / 65 536 ids) is ranked row by row
    boundary = (F.col("_before") < F.col("_cut")) & (F.col("_before") + F.col("_cnt") > F.col("_cut"))
    rank_in_b = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    edge = j.where(boundary).withColumn("_val", F.col("_before") + rank_in_b <= F.col("_cut"))
    rest = j.where(~boundary).withColumn("_val", F.col("_before") + F.col("_cnt") <= F.col("_cut"))
    both = edge.unionByName(rest)
    return both.select(key, F.when(F.col("_val"), F.lit("val")).otherwise(F.lit("test")).alias("split"))
