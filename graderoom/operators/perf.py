"""Efficiency layer: profile statistics, curation gates, cost segments, reference ladders, dps.

Profiles are long: one row per (task, solution_idx, round) with a cost (null = broken round).
Per-solution statistics are a grouped aggregate; per-task orderings are windows partitioned by task
over per-solution rows (one row per solution, never per round); the ladder match keeps each task's
ladder as a small sorted array and searches it with higher-order functions, so no range join
multiplies rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graderoom.operators.quantiles import exact_percentile

MIN_INSTRUCTIONS = 10_000  # curation gate and the weight inside the segment threshold
GATE_SEGMENT_BASE = 0.2
EXPORT_SEGMENT_BASE = 0.10


def cost_key(c: str | Column) -> Column:
    """Costs (instruction counts, up to ~1e10) are kept at milli-unit precision so that summation
    order in the mean cannot flip a later comparison."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 3)


def solution_stats(profiles: DataFrame, task: str = "task", sol: str = "solution_idx", cost: str = "cost",
                   medians: bool = True) -> DataFrame:
    """Per solution: mean, median, population CV over rounds; mean/median null if any round broken. The exact
    median is found by ranks, so no task holds the rounds of a solution; ``medians=False`` leaves it out."""
    broken = F.max(F.col(cost).isNull())
    stats = profiles.groupBy(task, sol).agg(
        F.when(~broken, cost_key(F.avg(cost))).alias("mean_cost"),
        (F.lit(100.0) * F.stddev_pop(cost) / F.avg(cost)).alias("cv"),
        F.count(F.lit(1)).alias("n_rounds"),
        broken.alias("has_broken_round"),
    )
    return with_medians(stats, profiles, task, sol, cost) if medians else stats


def with_medians(stats: DataFrame, profiles: DataFrame, task: str = "task", sol: str = "solution_idx",
                 cost: str = "cost") -> DataFrame:
    """Adds ``median_cost`` of each solution's rounds, null if one is broken."""
    m = exact_percentile(profiles, [task, sol], cost, 0.5, "_median").select(F.col(task).alias("_t"), F.col(sol).alias("_s"), "_median")
    joined = stats.join(m, F.col(task).eqNullSafe(F.col("_t")) & F.col(sol).eqNullSafe(F.col("_s")), "left")
    return joined.select(*stats.columns, F.when(~F.col("has_broken_round"), cost_key("_median")).alias("median_cost"))


def gate_profile_size(stats: DataFrame, threshold: int = 10, task: str = "task") -> DataFrame:
    """Tasks with at least ``threshold`` profiled solutions and no broken round."""
    return stats.groupBy(task).agg(
        F.count(F.lit(1)).alias("n_solutions"), F.max("has_broken_round").alias("broken")
    ).where((F.col("n_solutions") >= threshold) & ~F.col("broken")).select(task)


def gate_compute_cost(stats: DataFrame, thresh: float = MIN_INSTRUCTIONS, task: str = "task") -> DataFrame:
    """Drop tasks whose fastest solution (mean cost) is below the threshold."""
    return stats.groupBy(task).agg(F.min("mean_cost").alias("fastest")).where(
        F.col("fastest") >= thresh).select(task)


def gate_cv(stats: DataFrame, thresh: float = 5.0, percentile: float = 0.99, task: str = "task") -> DataFrame:
    """Drop tasks whose P-th percentile (linear interpolation) of per-solution CV exceeds thresh.
    The percentile is exact and found by ranks, so no task holds the solutions of one key."""
    return exact_percentile(stats, [task], "cv", percentile, "p_cv").where(F.col("p_cv") <= thresh).select(task)


def segment_costs(stats: DataFrame, base: float = EXPORT_SEGMENT_BASE, task: str = "task",
                  sol: str = "solution_idx", weight: float = MIN_INSTRUCTIONS,
                  n_parts: int | None = None) -> DataFrame:
    """Sort solution means descending per task; start a new segment where the relative drop from the
    previous (larger) mean exceeds base + sqrt(weight / previous).

    Skew-safe: solutions are range-partitioned on (task, mean desc, index), so a task with very many
    solutions spans several partitions. ``lag`` and the running cut count are computed inside each
    (partition, task) run; a small table of per-run boundary values (last mean, run sizes, cut counts)
    stitches the runs together."""
    from graderoom.session import ensure_checkpoint_dir

    spark = stats.sparkSession
    ensure_checkpoint_dir(spark)
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("mean_cost"), F.asc(sol)]
    s = stats.repartitionByRange(n, F.col(task), *order).withColumn("_pid", F.spark_partition_id()).checkpoint()
    local = Window.partitionBy("_pid", task).orderBy(*order)
    run = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("_prev_local", F.lag("mean_cost").over(local)).withColumn("_rn_local", F.row_number().over(local))
    # last row of each run in sort order: smallest mean, then largest index
    runs = s.groupBy("_pid", task).agg(
        F.max_by("mean_cost", F.struct((-F.col("mean_cost")).alias("m"), F.col(sol).alias("i"))).alias("_last"),
        F.count(F.lit(1)).alias("_n"))
    by_pid = Window.partitionBy(task).orderBy("_pid")
    runs = runs.withColumn("_prev_run_last", F.lag("_last").over(by_pid)).withColumn(
        "_rows_before", F.coalesce(F.sum("_n").over(by_pid.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.join(runs.select("_pid", task, "_prev_run_last", "_rows_before"), ["_pid", task])
    prev = F.when(F.col("_rn_local") == 1, F.col("_prev_run_last")).otherwise(F.col("_prev_local"))
    cut = ((prev - F.col("mean_cost")) / prev) > (F.lit(base) + F.sqrt(F.lit(weight) / prev))
    s = s.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("_cuts_local", F.sum("_cut").over(run))
    cuts = s.groupBy("_pid", task).agg(F.sum("_cut").alias("_c"))
    cuts = cuts.withColumn("_cuts_before", F.coalesce(F.sum("_c").over(by_pid.rowsBetween(Window.unboundedPreceding, -1)),
                                                      F.lit(0)))
    s = s.join(cuts.select("_pid", task, "_cuts_before"), ["_pid", task])
    return (s.withColumn("segment", F.col("_cuts_before") + F.col("_cuts_local"))
            .withColumn("rank_in_task", (F.col("_rows_before") + F.col("_rn_local")).cast("int"))
            .drop("_pid", "_prev_local", "_rn_local", "_prev_run_last", "_rows_before", "_cut", "_cuts_local", "_cuts_before"))


def gate_clusters(stats: DataFrame, min_clusters: int = 4, base: float = GATE_SEGMENT_BASE, task: str = "task") -> DataFrame:
    seg = segment_costs(stats, base, task)
    return seg.groupBy(task).agg((F.max("segment") + 1).alias("n_segments")).where(
        F.col("n_segments") >= min_clusters).select(task)


def reference_ladder(segments: DataFrame, task: str = "task", sol: str = "solution_idx") -> DataFrame:
    """One reference per segment: its slowest solution (lowest index on equal means); score is the
    cumulative percentage of solutions in this and all slower segments. ref_idx 0 is the slowest."""
    per_seg = segments.groupBy(task, "segment").agg(
        F.min_by(F.struct(F.col(sol), F.col("mean_cost")), F.col("rank_in_task")).alias("ref"),
        F.count(F.lit(1)).alias("seg_size"),
    )
    wt = Window.partitionBy(task)
    run = Window.partitionBy(task).orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_seg.select(
        task,
        F.col("segment").alias("ref_idx"),
        F.col("ref").getField(sol).alias(sol),
        F.col("ref").getField("mean_cost").alias("ref_cost"),
        (F.lit(100.0) * F.sum("seg_size").over(run) / F.sum("seg_size").over(wt)).alias("score"),
        F.count(F.lit(1)).over(wt).alias("n_ref"),
    )


def ladder_order_check(refs: DataFrame, task: str = "task", strict: bool = False) -> DataFrame:
    """References whose re-measured cost is below the next (faster-ranked) reference's cost; with
    ``strict`` also those whose cost equals it, as an exported ladder must fall."""
    w = Window.partitionBy(task).orderBy("ref_idx")
    nxt = F.lead("ref_cost").over(w)
    wrong = F.col("ref_cost") <= F.col("next_cost") if strict else F.col("ref_cost") < F.col("next_cost")
    return refs.withColumn("next_cost", nxt).where(wrong)


def ladder_arrays(ladder: DataFrame, task: str = "task") -> DataFrame:
    """Each task's ladder as one sorted array (length = number of segments, tens at most)."""
    return ladder.groupBy(task).agg(
        F.array_sort(F.collect_list(F.struct("ref_idx", "ref_cost", "score"))).alias("ladder"),
        F.count(F.lit(1)).alias("n_ref"),
    )


def match_reference_ladder(samples: DataFrame, ladder: DataFrame, task: str = "task", cost: str = "cost") -> DataFrame:
    """Largest ref_idx whose reference cost is >= the sample's cost; none (or broken) -> -1 and 0 scores.
    dps = that reference's score, dps_norm = 100 * (j + 1) / n_ref."""
    arr = ladder_arrays(ladder, task)
    j = samples.join(arr, task, "left")
    c = cost_key(cost)
    hits = F.filter("ladder", lambda r: r["ref_cost"] >= c)
    best = F.aggregate(hits, F.lit(-1).cast("bigint"), lambda acc, r: F.greatest(acc, r["ref_idx"].cast("bigint")))
    j = j.withColumn("matching_idx", F.when(F.col(cost).isNull() | F.col("ladder").isNull(), F.lit(-1).cast("bigint"))
                     .otherwise(best))
    score = F.filter("ladder", lambda r: r["ref_idx"] == F.col("matching_idx"))
    return j.withColumn(
        "dps", F.when(F.col("matching_idx") >= 0, F.element_at(score, 1).getField("score")).otherwise(F.lit(0.0))
    ).withColumn(
        "dps_norm", F.when(F.col("matching_idx") >= 0, F.lit(100.0) * (F.col("matching_idx") + 1) / F.col("n_ref"))
        .otherwise(F.lit(0.0))
    ).drop("ladder", "n_ref")


def _check_enough(n: int, task: str) -> Column:
    return F.when(F.col("_rn_total") < n, F.raise_error(
        F.concat(F.lit("task has fewer samples than n: "), F.col(task).cast("string"))))


def _within_first(n: int, task: str, strict: bool) -> Column:
    first = F.col("_rn") <= n
    return F.coalesce(_check_enough(n, task).cast("boolean"), first) if strict else first


def first_n_samples(samples: DataFrame, n: int, task: str = "task", order: str = "round_id",
                    strict: bool = True) -> DataFrame:
    """First n samples per task in arrival order. A task with fewer than n fails the job at run time; without
    ``strict`` it keeps all that it has.
    Numbering is skew-safe (a task holding most samples is spread over partitions)."""
    from graderoom.operators.ranking import running_within

    numbered = running_within(samples, task, order, out="_rn", totals=True)
    return numbered.withColumn("_keep", _within_first(n, task, strict)).where("_keep").drop("_rn", "_rn_total", "_keep")


def cap_profiled(samples: DataFrame, max_profile: int, task: str = "task", order: str = "round_id",
                 passed: str = "passed") -> DataFrame:
    """Only the first ``max_profile`` passing samples of a task get profiled and scored
    (running count of passes, skew-safe)."""
    from graderoom.operators.ranking import running_within

    run = running_within(samples, task, order, F.col(passed).cast("int"), "_npass")
    return run.withColumn("profiled", F.col(passed) & (F.col("_npass") <= max_profile)).drop("_npass")


def first_n_and_cap(samples: DataFrame, n: int, max_profile: int, task: str = "task", order: str = "round_id",
                    passed: str = "passed", strict: bool = True) -> DataFrame:
    """``cap_profiled(first_n_samples(...))`` in one skew-safe pass: the first n samples form a prefix,
    so the running pass count over all samples equals the one inside the prefix. ``strict`` is that of
    ``first_n_samples``."""
    from graderoom.operators.ranking import running_within

    run = running_within(samples, task, order, values={"_rn": F.lit(1), "_npass": F.col(passed).cast("int")},
                         totals=True)
    run = run.withColumn("_keep", _within_first(n, task, strict)).where("_keep")
    return run.withColumn("profiled", F.col(passed) & (F.col("_npass") <= max_profile)).drop(
        "_rn", "_rn_total", "_npass", "_npass_total", "_keep")


def profile_key(df: DataFrame, options: dict, text: str = "solution", task: str = "task", out: str = "profile_key") -> DataFrame:
    """Adds the key of a profile: a digest of task, solution text and profiling options (repeat count, time limit,
    counter, ...). Equal texts of a task share it; any other option gives other keys, so stored profiles under the
    former options are not found any more. Null for a null text."""
    config = json.dumps(options, sort_keys=True, default=str)
    parts = [F.col(task).cast("string"), F.lit(config), F.col(text).cast("string")]
    return df.withColumn(out, F.sha2(F.concat_ws("\x1f", *[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts[:2]],
                                                 F.coalesce(parts[2], F.lit(""))), 256)).withColumn(
        out, F.when(F.col(text).isNotNull(), F.col(out)))


def profiles_wanted(samples: DataFrame, stored: DataFrame, key: str = "profile_key", task: str = "task",
                    text: str = "solution") -> DataFrame:
    """What is left to profile: one row per key of the samples that are to be profiled and have no stored profile,
    with the number of samples that share it. Copies are counted before they are shuffled."""
    wanted = samples.where(F.col("profiled") & F.col(key).isNotNull())
    each = wanted.groupBy(key).agg(F.first(task).alias(task), F.first(text).alias(text), F.count(F.lit(1)).alias("n_samples"))
    return each.join(stored.select(key), key, "left_anti")


def with_stored_costs(samples: DataFrame, stored: DataFrame, key: str = "profile_key", cost: str = "cost") -> DataFrame:
    """Samples with the cost of their key's stored profile, null where there is none. A key that was stored more than
    once has the cost of its first run (``run``, then the lower cost), so that a repeated write changes nothing."""
    first = stored.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("run", cost))[cost].alias(cost))
    return samples.drop(cost).join(first, key, "left")


def dps_task(scored: DataFrame, min_correct: int, task: str = "task", passed: str = "passed") -> DataFrame:
    """Per task: mean dps / dps_norm over profiled samples, n_profiled and pass@1, only for tasks with
    at least ``min_correct`` passing samples (others get null dps)."""
    agg = scored.groupBy(task).agg(
        F.avg(F.when(F.col("profiled"), F.col("dps"))).alias("dps"),
        F.avg(F.when(F.col("profiled"), F.col("dps_norm"))).alias("dps_norm"),
        F.count_if(F.col("profiled")).alias("n_profiled"),
        F.count_if(F.col(passed)).alias("n_pass"),
        (F.lit(100.0) * F.avg(F.col(passed).cast("double"))).alias("pass_at_1"),
    )
    ok = F.col("n_pass") >= min_correct
    return agg.select(
        task,
        F.when(ok, F.col("dps")).alias("dps"),
        F.when(ok, F.col("dps_norm")).alias("dps_norm"),
        F.when(ok, F.col("n_profiled")).alias("n_profiled"),
        "pass_at_1",
    )


def dps_summary(per_task: DataFrame) -> DataFrame:
    """Mean over tasks of dps, dps_norm and pass@1 (nulls ignored) and the number evaluated."""
    return per_task.agg(
        F.avg("dps").alias("dps"), F.avg("dps_norm").alias("dps_norm"), F.avg("pass_at_1").alias("pass_at_1"),
        F.count("dps").alias("n_evaluated"),
    )


def preview_list(values: Column, head: int = 4, tail: int = 4) -> Column:
    """'[a, b, c]' when short, else '[h1, .., h4, ..., t1, .., t4]' (for an already small array)."""
    as_text = F.transform(values, lambda v: v.cast("string"))
    short = F.concat(F.lit("["), F.array_join(as_text, ", "), F.lit("]"))
    long = F.concat(F.lit("["), F.array_join(F.slice(as_text, 1, head), ", "), F.lit(", ..., "),
                    F.array_join(F.slice(as_text, -tail, tail), ", "), F.lit("]"))
    return F.when(F.size(values) <= head + tail, short).otherwise(long)


def preview_groups(df: DataFrame, keys: list[str], order: str, value: Column, head: int = 4, tail: int = 4) -> DataFrame:
    """Per group, the preview of its values in ``order`` without collecting the group: only the first
    ``head`` and last ``tail`` rows (rank filters, limited per partition before the shuffle) and the
    group size are gathered."""
    asc = Window.partitionBy(*keys).orderBy(F.asc(order))
    desc = Window.partitionBy(*keys).orderBy(F.desc(order))
    d = df.withColumn("_v", value.cast("string"))
    firsts = d.withColumn("_r", F.row_number().over(asc)).where(F.col("_r") <= head + tail).select(*keys, "_r", "_v")
    lasts = d.withColumn("_r", F.row_number().over(desc)).where(F.col("_r") <= tail).select(
        *keys, (-F.col("_r")).alias("_r"), "_v")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ends = firsts.unionByName(lasts).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", "_v"))).alias("_e"))
    j = ends.join(sizes, keys)
    firsts_v = F.transform(F.filter("_e", lambda e: e["_r"] > 0), lambda e: e["_v"])  # up to head + tail
    tails = F.transform(F.filter("_e", lambda e: e["_r"] < 0), lambda e: e["_v"])  # ranks -tail .. -1, in order
    short = F.concat(F.lit("["), F.array_join(firsts_v, ", "), F.lit("]"))
    long = F.concat(F.lit("["), F.array_join(F.slice(firsts_v, 1, head), ", "), F.lit(", ..., "),
                    F.array_join(tails, ", "), F.lit("]"))
    return j.select(*keys, F.when(F.col("_n") <= head + tail, short).otherwise(long).alias("preview"))


# ---------------------------------------------------------------- input curation


def pick_pe_input(candidates: DataFrame, task: str = "task", inp: str = "input_idx") -> DataFrame:
    """Per task, the most expensive input (canonical median cost, lowest index on ties) on which every
    solution profiled OK; null when no such input exists."""
    medians = exact_percentile(candidates, [task, inp], "canonical_cost", 0.5, "median_cost")
    per_input = candidates.groupBy(task, inp).agg(F.bool_and("ok").alias("all_ok")).join(medians, [task, inp])
    best = F.max_by(F.when(F.col("all_ok"), F.col(inp)),
                    F.when(F.col("all_ok"), F.struct(F.col("median_cost"), (-F.col(inp)).alias("neg_idx"))))
    return per_input.groupBy(task).agg(best.alias("pe_input_idx"))


MAX_SCALE_EXP = 26


def scale_ladder(generators: DataFrame, status_at: callable, key=("task", "input_idx")) -> DataFrame:
    """Try scales 2^1..2^26 per generator; keep the last scale before the first stop. A generator is
    well defined unless its stop was an error. ``status_at(scale_exp)`` returns 'ok' / 'timeout' /
    'overflow' / 'size' / 'error' for each (generator, scale)."""
    tried = generators.withColumn("scale_exp", F.explode(F.sequence(F.lit(1), F.lit(MAX_SCALE_EXP))))
    tried = tried.withColumn("status", status_at(F.col("scale_exp")))
    stop = F.col("status") != "ok"
    agg = tried.groupBy(*key).agg(
        F.min(F.when(stop, F.col("scale_exp"))).alias("first_stop"),
        F.min_by(F.col("status"), F.when(stop, F.col("scale_exp"))).alias("stop_status"),
    )
    return agg.select(
        *key,
        F.when(F.col("first_stop").isNull(), F.lit(MAX_SCALE_EXP))
        .when(F.col("first_stop") > 1, F.col("first_stop") - 1).alias("last_scale_exp"),
        F.coalesce(F.col("stop_status") != "error", F.lit(True)).alias("well_defined"),
    )


def first_well_defined_generator(ladders: DataFrame, task: str = "task", order: str = "input_idx") -> DataFrame:
    """Generators in order up to and including the first well-defined one."""
    before = Window.partitionBy(task).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.col("well_defined").cast("int")).over(before), F.lit(0))
    return ladders.withColumn("_seen", seen).where(F.col("_seen") == 0).drop("_seen")
