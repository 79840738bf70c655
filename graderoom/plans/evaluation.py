"""End-to-end compositions: evaluation run, ensemble run, perf-task curation, efficiency run and
performance-input curation. Each is a chain of the operators, one logical plan per result."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graderoom.operators import metrics as M
from graderoom.operators import perf as P
from graderoom.operators import relational as Rel
from graderoom.operators import typed as T
from graderoom.operators import vectors as Vec
from graderoom.operators import verdict as V


def evaluate_run(executions: DataFrame, problems: DataFrame, split_ids: DataFrame, limits: V.Limits,
                 ks: Sequence[int] = M.DEFAULT_KS, fast: bool = True,
                 samples: DataFrame | None = None, typed: bool = False, base_only: bool = False,
                 show: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Executions of the split's known tasks -> per-input verdict details -> per-suite status ->
    per-sample report rows (statuses, failing inputs) -> pass@k per model and suite.

    A suite without inputs passes (zero inputs, clean load); plus-correct needs base pass too.

    Without ``samples`` the samples are those of the executions. With it (sample_id, task_id, model and
    a boolean load_error, which may be null) every listed sample of the split's known tasks counts: one
    with a load error fails, and so does one without rows in a suite that other samples of its task
    have run, or of a task that no sample has run. So n holds samples that never ran.

    With ``typed`` outputs are typed values (``typed.matches``) and the problems' entry points choose the special
    rules. ``base_only`` leaves the plus suite out: its status is null, and pass@k is of the base suite.
    ``show`` names the column by which failing inputs are listed, by default their index."""
    ex = Rel.filter_subset(executions, split_ids)
    ex = ex.join(problems.select("task_id"), "task_id", "left_semi")  # unknown tasks are quarantined
    if base_only:
        ex = ex.where("suite = 'base'")
    if typed:
        ex = T.with_rules(ex, problems)
        details = V.verdict_details(ex, limits, fast=fast, matches=lambda tol: T.matches(tol, "rule"), actual="actual_kind")
    else:
        details = V.verdict_details(ex, limits, fast=fast)
    failed = V.failed_tests(details, fast=fast, show=show)
    base_missing = plus_missing = load_error = F.lit(False)
    if samples is None:
        listed = ex.select("sample_id", "task_id", "model").distinct()
    else:
        ran = ex.groupBy("task_id").agg(F.bool_or(F.col("suite") == "base").alias("_base"),
                                        F.bool_or(F.col("suite") == "plus").alias("_plus"))
        listed = Rel.filter_subset(samples, split_ids).join(
            problems.select("task_id"), "task_id", "left_semi").join(ran, "task_id", "left")
        base_missing, plus_missing = F.coalesce("_base", F.lit(True)), F.coalesce("_plus", F.lit(True))
        load_error = F.coalesce("load_error", F.lit(False))
    wide = failed.groupBy("sample_id").pivot("suite", ["base", "plus"]).agg(
        F.first("status").alias("status"), F.first("failed_inputs").alias("fail"))

    def status(found: str, missing: Column) -> Column:
        unrun = F.when(missing, F.lit("fail")).otherwise(F.lit("pass"))
        return F.when(load_error, F.lit("fail")).otherwise(F.coalesce(F.col(found), unrun)).alias(found)

    def failing(found: str, name: str) -> Column:
        return F.when(load_error, F.lit("")).otherwise(F.coalesce(F.col(found), F.lit(""))).alias(name)

    report = listed.join(wide, "sample_id", "left").select(
        "sample_id", "task_id", "model",
        status("base_status", base_missing), status("plus_status", plus_missing),
        failing("base_fail", "base_fail_tests"), failing("plus_fail", "plus_fail_tests"),
    )
    passed = M.pass_at_k(M.task_counts(report), ks)
    if base_only:
        report, passed = report.withColumn("plus_status", F.lit(None).cast("string")), passed.where("suite = 'base'")
    return report, passed


def ensemble_run(fingerprints: DataFrame, centres: list[list[float]], accuracy: DataFrame,
                 reports: DataFrame | None = None) -> DataFrame:
    """Clusters from given centres -> accuracy -> representatives -> plans, each step with the
    accuracy of its model. With ``reports`` (report rows of the steps' samples, as of ``evaluate_run``, with
    model_identifier, step and, if the chains were run apart, ensemble) each step also has its pass@1."""
    assigned = Vec.kmeans_assign(fingerprints, centres).select("model_identifier", "cluster")
    models = Rel.attach_accuracy(assigned, accuracy)
    reps = Vec.cluster_representatives(models)
    plans = Vec.ensemble_plans(reps, models)
    steps = plans.join(models.select("model_identifier", "accuracy"), "model_identifier", "left")
    if reports is None:
        return steps
    on = [c for c in ("ensemble", "step", "model_identifier") if c in reports.columns]
    return steps.join(step_pass_at_1(reports, on), on, "left")


def step_pass_at_1(reports: DataFrame, by: Sequence[str] = ("ensemble", "step", "model_identifier")) -> DataFrame:
    """pass@1 in percent per step and suite: the mean over tasks of the share of a task's samples that pass. Plus
    needs base too."""
    base = F.col("base_status") == "pass"
    tasks = reports.groupBy(*by, "task_id").agg(
        F.avg(F.coalesce(base, F.lit(False)).cast("double")).alias("_base"),
        F.avg(F.coalesce(base & (F.col("plus_status") == "pass"), F.lit(False)).cast("double")).alias("_plus"))
    return tasks.groupBy(*by).agg((F.lit(100.0) * F.avg("_base")).alias("base_pass_at_1"),
                                  (F.lit(100.0) * F.avg("_plus")).alias("plus_pass_at_1"),
                                  F.count(F.lit(1)).alias("n_tasks"))


def curate_perf_tasks(profiles: DataFrame, min_clusters: int = 4) -> DataFrame:
    """Gates in order (profile size, compute cost, P99 CV, cluster count) -> segments -> ladders.
    The per-solution statistics (one pass over all profiled rounds) are checkpointed once and shared
    by every gate and both segmentations; neither needs medians."""
    from graderoom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(profiles.sparkSession)
    stats = P.solution_stats(profiles, medians=False).checkpoint()
    kept = P.gate_profile_size(stats)
    kept = P.gate_compute_cost(stats.join(kept, "task", "left_semi"))
    kept = P.gate_cv(stats.join(kept, "task", "left_semi"))
    kept = P.gate_clusters(stats.join(kept, "task", "left_semi"), min_clusters)
    seg = P.segment_costs(stats.join(kept, "task", "left_semi"), P.EXPORT_SEGMENT_BASE)
    return P.reference_ladder(seg)


def efficiency_run(samples: DataFrame, ladder: DataFrame, n_samples: int, min_correct: int,
                   max_profile: int, stored: DataFrame | None = None, options: dict | None = None,
                   finished: DataFrame | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Perf tasks only: first n samples -> cap profiled passing samples -> ladder match -> dps per
    task (tasks below min_correct get null) -> summary.

    With ``stored`` (profile_key, run, cost) costs come from the profiles stored under the samples' text and
    ``options``; see ``perf.profiles_wanted`` for those to be run first. With ``finished`` (the first result and the
    columns n_samples, min_correct, max_profile and options as written by ``finished_tasks``) tasks finished under
    an equal configuration keep that result and are not computed again. A task with fewer than ``n_samples`` samples
    fails the run; without ``strict`` it is scored on those it has."""
    if not min_correct <= max_profile <= n_samples:
        raise ValueError("need min_correct <= max_profile <= n_samples")
    s = samples.join(ladder.select("task").distinct(), "task", "left_semi")
    done = None
    if finished is not None:
        config = run_config(n_samples, min_correct, max_profile, options)
        equal = reduce(and_, [F.col(name).eqNullSafe(F.lit(value)) for name, value in config.items()])
        done = finished.where(equal).drop(*config).join(ladder.select("task").distinct(), "task", "left_semi")
        s = s.join(done.select("task"), "task", "left_anti")
    s = P.first_n_and_cap(s, n_samples, max_profile, strict=strict)
    if stored is not None:
        s = P.with_stored_costs(P.profile_key(s, options or {}), stored)
    scored = P.match_reference_ladder(s, ladder)
    per_task = P.dps_task(scored, min_correct)
    if done is not None:
        per_task = per_task.unionByName(done.select(*per_task.columns))
    return per_task, P.dps_summary(per_task)


def run_config(n_samples: int, min_correct: int, max_profile: int, options: dict | None = None) -> dict:
    """The columns that tell one configuration of an efficiency run from another."""
    return {"n_samples": n_samples, "min_correct": min_correct, "max_profile": max_profile,
            "options": json.dumps(options or {}, sort_keys=True, default=str)}


def finished_tasks(per_task: DataFrame, n_samples: int, min_correct: int, max_profile: int,
                   options: dict | None = None) -> DataFrame:
    """The first result of ``efficiency_run`` with its configuration, as a later run's ``finished`` reads it."""
    config = run_config(n_samples, min_correct, max_profile, options)
    return per_task.select("*", *[F.lit(value).alias(name) for name, value in config.items()])


def curate_pe_inputs(candidates: DataFrame, generators: DataFrame, status_at) -> DataFrame:
    """Scale ladders per generator -> generators up to the first well-defined one -> the most
    expensive all-ok input among their inputs, per task."""
    ladders = P.scale_ladder(generators, status_at)
    kept = P.first_well_defined_generator(ladders).select("task", "input_idx")
    return P.pick_pe_input(candidates.join(kept, ["task", "input_idx"], "left_semi"))
