"""Aggregations: sample counts, pass@k, leaderboards, profile statistics, perf gates, dps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graderoom.functions.exprs import pass_at_k_expr

DEFAULT_KS = (1, 5, 10, 100)


def plus_pass(samples: DataFrame) -> DataFrame:
    """Plus-correct iff base *and* plus pass."""
    return samples.withColumn(
        "plus_correct", (F.col("base_status") == "pass") & (F.col("plus_status") == "pass")
    )


def task_counts(samples: DataFrame, group: Sequence[str] = ("model", "task_id")) -> DataFrame:
    """n samples, c base-correct, c plus-correct per group (partial + final hash aggregate)."""
    return samples.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("base_status") == "pass").alias("c_base"),
        F.count_if((F.col("base_status") == "pass") & (F.col("plus_status") == "pass")).alias("c_plus"),
    )


def _long_counts(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    return counts.select(
        *group,
        "n",
        F.explode(
            F.array(
                F.struct(F.lit("base").alias("suite"), F.col("c_base").alias("c")),
                F.struct(F.lit("plus").alias("suite"), F.col("c_plus").alias("c")),
            )
        ).alias("s"),
    ).select(*group, "n", "s.suite", "s.c")


def pass_at_k_task(counts: DataFrame, ks: Sequence[int] = DEFAULT_KS,
                   group: Sequence[str] = ("model", "task_id")) -> DataFrame:
    """Per (group, suite, k) unbiased estimate."""
    long = _long_counts(counts, group)
    return long.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).withColumn(
        "pass_at_k", pass_at_k_expr("n", "c", "k")
    )


def pass_at_k(counts: DataFrame, ks: Sequence[int] = DEFAULT_KS, by: Sequence[str] = ("model",),
              task_col: str = "task_id") -> DataFrame:
    """Mean over tasks of pass@k, emitted for k only when min n over all tasks >= k."""
    per_task = pass_at_k_task(counts, ks, group=(*by, task_col))
    return (
        per_task.groupBy(*by, "suite", "k")
        .agg(F.avg("pass_at_k").alias("pass_at_k"), F.min("n").alias("min_n"))
        .where(F.col("min_n") >= F.col("k"))
        .drop("min_n")
    )


def model_leaderboard(counts: DataFrame, k: int = 1) -> DataFrame:
    """Accuracy per model at pass@k for base and plus, ranked by plus then base accuracy."""
    scores = pass_at_k(counts, ks=[k])
    wide = scores.groupBy("model").pivot("suite", ["base", "plus"]).agg(F.first("pass_at_k"))
    w = Window.orderBy(F.desc("plus"), F.desc("base"), F.asc("model"))
    return wide.select(
        "model",
        F.col("base").alias("base_accuracy"),
        F.col("plus").alias("plus_accuracy"),
        F.row_number().over(w).alias("rank"),
    )


def pass_at_1_percent(results: DataFrame, task_col: str = "task", pass_col: str = "passed") -> DataFrame:
    """100 * passes / n per task."""
    return results.groupBy(task_col).agg(
        (F.avg(F.col(pass_col).cast("double")) * 100).alias("pass_at_1"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def sample_completeness(problems: DataFrame, samples: DataFrame, expected: int, key: str = "task_id") -> DataFrame:
    """Samples per task against the expected count: tasks done (n >= expected) and incomplete, plus
    the count under the reference tool's inverted test (n <= expected) for comparison."""
    counts = samples.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    j = problems.select(key).join(counts, key, "left").fillna(0, ["n"])
    return j.agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if(F.col("n") >= expected).alias("n_done"),
        F.count_if(F.col("n") < expected).alias("n_incomplete"),
        F.count_if(F.col("n") <= expected).alias("n_done_inverted"),
    )
