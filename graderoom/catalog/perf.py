"""Registered queries: profile statistics, curation gates, segments, ladders, dps."""

from __future__ import annotations

from pyspark.sql import functions as F

from graderoom.fixtures import Inputs, cte
from graderoom.functions.exprs import r6
from graderoom.operators import perf as P
from graderoom.registry import register

# A task with fewer samples than N_SAMPLES is scored on those it has: every query here passes ``strict=False``.
N_SAMPLES, MIN_CORRECT, MAX_PROFILE = 40, 10, 20


def stats_of(x: Inputs, medians: bool = True):
    return P.solution_stats(x.v("f5_profiles"), medians=medians)


def gated_tasks(stats, upto: int):
    """Apply the gates in the curation order, stopping after gate ``upto`` (1..4)."""
    gates = [P.gate_profile_size, P.gate_compute_cost, P.gate_cv, P.gate_clusters]
    kept = None
    for g in gates[:upto]:
        s = stats if kept is None else stats.join(kept, "task", "left_semi")
        kept = g(s)
    return kept


_W = "partition by task order by mean_cost desc, solution_idx"


def _stats_sql(base: float) -> str:
    return cte("f5_profiles") + f""",
stats as (select task, solution_idx,
                 case when bool_or(cost is null) then null else round(avg(cost), 3) end as mean_cost,
                 case when bool_or(cost is null) then null else round(quantile_cont(cost, 0.5), 3) end as median_cost,
                 100.0 * stddev_pop(cost) / avg(cost) as cv, count(*) as n_rounds, bool_or(cost is null) as broken
          from f5_profiles group by task, solution_idx),
cuts as (select *, coalesce(cast((lag(mean_cost) over ({_W}) - mean_cost) / lag(mean_cost) over ({_W})
                      > {base} + sqrt(10000 / lag(mean_cost) over ({_W})) as integer), 0) as cut from stats),
seg as (select *, cast(sum(cut) over ({_W} rows between unbounded preceding and current row) as bigint) as segment,
               row_number() over ({_W}) as rank_in_task from cuts),
g1 as (select task from stats group by task having count(*) >= 10 and not bool_or(broken)),
g2 as (select task from stats where task in (select task from g1) group by task having min(mean_cost) >= 10000),
g3 as (select task from stats where task in (select task from g2) group by task having quantile_cont(cv, 0.99) <= 5),
seg2 as (select *, sum(c2) over (partition by task order by mean_cost desc, solution_idx rows between unbounded preceding and current row) as s2
         from (select *, coalesce(cast((lag(mean_cost) over ({_W}) - mean_cost) / lag(mean_cost) over ({_W})
                      > 0.2 + sqrt(10000 / lag(mean_cost) over ({_W})) as integer), 0) as c2
               from stats where task in (select task from g3))),
g4 as (select task from seg2 group by task having max(s2) + 1 >= 4),
refs as (select task, segment as ref_idx, arg_min(solution_idx, rank_in_task) as solution_idx,
                arg_min(mean_cost, rank_in_task) as ref_cost, arg_min(median_cost, rank_in_task) as ref_median,
                count(*) as seg_size from seg group by task, segment),
ladder as (select task, ref_idx, solution_idx, ref_cost, ref_median,
                  100.0 * sum(seg_size) over (partition by task order by ref_idx rows between unbounded preceding and current row)
                        / sum(seg_size) over (partition by task) as score,
                  count(*) over (partition by task) as n_ref from refs)
"""


_SCORED = """,
smp as (select task, round_id, passed, cost,
               row_number() over (partition by task order by round_id) as rn from f5_profiles),
firstn as (select * from smp where rn <= 40),
capped as (select *, passed and sum(cast(passed as integer)) over (partition by task order by round_id
                  rows between unbounded preceding and current row) <= 20 as profiled from firstn),
matched as (select c.*, coalesce((select max(l.ref_idx) from ladder l where l.task = c.task and l.ref_cost >= round(c.cost, 3)), -1) as matching_idx
            from capped c),
scored as (select m.*, coalesce(l.score, 0.0) as dps,
                  case when m.matching_idx >= 0 then 100.0 * (m.matching_idx + 1) / l.n_ref else 0.0 end as dps_norm
           from matched m left join ladder l on l.task = m.task and l.ref_idx = m.matching_idx),
per_task as (select task,
       case when count(*) filter (where passed) >= 10 then avg(dps) filter (where profiled) end as dps,
       case when count(*) filter (where passed) >= 10 then avg(dps_norm) filter (where profiled) end as dps_norm,
       case when count(*) filter (where passed) >= 10 then count(*) filter (where profiled) end as n_profiled,
       100.0 * avg(cast(passed as double)) as pass_at_1
     from scored group by task)
"""


@register("profile_mean_median", _stats_sql(0.1) + "select task, solution_idx, mean_cost, median_cost from stats")
def q_profile_mean_median(spark, sf_dir):
    return stats_of(Inputs(spark, sf_dir)).select("task", "solution_idx", "mean_cost", "median_cost")


@register("coefficient_of_variation", _stats_sql(0.1) + "select task, solution_idx, round(cv, 6) as cv from stats")
def q_cv(spark, sf_dir):
    return stats_of(Inputs(spark, sf_dir), medians=False).select("task", "solution_idx", r6("cv").alias("cv"))


@register("gate_profile_size", _stats_sql(0.1) + "select task from g1")
def q_gate_profile_size(spark, sf_dir):
    return gated_tasks(stats_of(Inputs(spark, sf_dir), medians=False), 1)


@register("gate_compute_cost", _stats_sql(0.1) + "select task from g2")
def q_gate_compute_cost(spark, sf_dir):
    return gated_tasks(stats_of(Inputs(spark, sf_dir), medians=False), 2)


@register("gate_cv", _stats_sql(0.1) + "select task from g3")
def q_gate_cv(spark, sf_dir):
    return gated_tasks(stats_of(Inputs(spark, sf_dir), medians=False), 3)


@register("gate_clusters", _stats_sql(0.1) + "select task from g4")
def q_gate_clusters(spark, sf_dir):
    return gated_tasks(stats_of(Inputs(spark, sf_dir), medians=False), 4)


@register("segment_costs", _stats_sql(0.1) + "select task, solution_idx, mean_cost, segment from seg")
def q_segment_costs(spark, sf_dir):
    seg = P.segment_costs(stats_of(Inputs(spark, sf_dir), medians=False), P.EXPORT_SEGMENT_BASE)
    return seg.select("task", "solution_idx", "mean_cost", "segment")


def ladder_of(x: Inputs):
    return P.reference_ladder(P.segment_costs(stats_of(x, medians=False), P.EXPORT_SEGMENT_BASE))


@register("reference_ladder", _stats_sql(0.1) + """
select task, ref_idx, solution_idx, ref_cost, round(score, 6) as score, n_ref from ladder""")
def q_reference_ladder(spark, sf_dir):
    lad = ladder_of(Inputs(spark, sf_dir))
    return lad.select("task", "ref_idx", "solution_idx", "ref_cost", r6("score").alias("score"), "n_ref")


@register("ladder_order_check", _stats_sql(0.1) + """
select task, ref_idx from (select task, ref_idx, ref_median, lead(ref_median) over (partition by task order by ref_idx) as nxt from ladder)
where ref_median < nxt""")
def q_ladder_order_check(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    stats = stats_of(x)
    lad = ladder_of(x)
    # re-measured reference cost: the median of the reference solution's rounds
    remeasured = lad.join(stats.select("task", "solution_idx", "median_cost"), ["task", "solution_idx"]) \
        .select("task", "ref_idx", F.col("median_cost").alias("ref_cost"))
    return P.ladder_order_check(remeasured).select("task", "ref_idx")


def scored_samples(x: Inputs):
    s = x.v("f5_profiles").select("task", "round_id", "passed", "cost")
    s = P.first_n_and_cap(s, N_SAMPLES, MAX_PROFILE, strict=False)
    return P.match_reference_ladder(s, ladder_of(x))


@register("match_reference_ladder", _stats_sql(0.1) + _SCORED + """
select task, round_id, matching_idx, round(dps, 6) as dps, round(dps_norm, 6) as dps_norm from scored""")
def q_match_reference_ladder(spark, sf_dir):
    s = scored_samples(Inputs(spark, sf_dir))
    return s.select("task", "round_id", "matching_idx", r6("dps").alias("dps"), r6("dps_norm").alias("dps_norm"))


@register("first_n_samples", _stats_sql(0.1) + _SCORED + "select task, round_id from firstn")
def q_first_n_samples(spark, sf_dir):
    s = Inputs(spark, sf_dir).v("f5_profiles").select("task", "round_id")
    return P.first_n_samples(s, N_SAMPLES, strict=False)


@register("cap_profiled", _stats_sql(0.1) + _SCORED + "select task, round_id, profiled from capped")
def q_cap_profiled(spark, sf_dir):
    s = Inputs(spark, sf_dir).v("f5_profiles").select("task", "round_id", "passed")
    return P.cap_profiled(P.first_n_samples(s, N_SAMPLES, strict=False), MAX_PROFILE).select("task", "round_id", "profiled")


@register("dps_task", _stats_sql(0.1) + _SCORED + """
select task, round(dps, 6) as dps, round(dps_norm, 6) as dps_norm, n_profiled, round(pass_at_1, 6) as pass_at_1 from per_task""")
def q_dps_task(spark, sf_dir):
    t = P.dps_task(scored_samples(Inputs(spark, sf_dir)), MIN_CORRECT)
    return t.select("task", r6("dps").alias("dps"), r6("dps_norm").alias("dps_norm"), "n_profiled",
                    r6("pass_at_1").alias("pass_at_1"))


@register("dps_summary", _stats_sql(0.1) + _SCORED + """
select round(avg(dps), 6) as dps, round(avg(dps_norm), 6) as dps_norm, round(avg(pass_at_1), 6) as pass_at_1,
       count(dps) as n_evaluated from per_task""")
def q_dps_summary(spark, sf_dir):
    s = P.dps_summary(P.dps_task(scored_samples(Inputs(spark, sf_dir)), MIN_CORRECT))
    return s.select(r6("dps").alias("dps"), r6("dps_norm").alias("dps_norm"), r6("pass_at_1").alias("pass_at_1"),
                    "n_evaluated")


@register("preview_list", _stats_sql(0.1) + """,
pv as (select task, segment, list(cast(round_even(1000 * mean_cost, 0) as bigint) order by rank_in_task) as v from seg group by task, segment)
select task, segment,
  case when len(v) <= 8 then '[' || array_to_string(v, ', ') || ']'
       else '[' || array_to_string(v[1:4], ', ') || ', ..., ' || array_to_string(v[len(v) - 3:], ', ') || ']' end as preview
from pv""")
def q_preview_list(spark, sf_dir):
    seg = P.segment_costs(stats_of(Inputs(spark, sf_dir), medians=False), P.EXPORT_SEGMENT_BASE)
    return P.preview_groups(seg, ["task", "segment"], "rank_in_task",
                            F.bround(F.col("mean_cost") * 1000, 0).cast("bigint"))


@register("pick_pe_input", cte("f5b_candidates") + """,
pi as (select task, input_idx, quantile_cont(canonical_cost, 0.5) as median_cost, bool_and(ok) as all_ok
       from f5b_candidates group by task, input_idx)
select task, arg_max(case when all_ok then input_idx end, case when all_ok then (median_cost, -input_idx) end) as pe_input_idx
from pi group by task""")
def q_pick_pe_input(spark, sf_dir):
    return P.pick_pe_input(Inputs(spark, sf_dir).v("f5b_candidates"))


def generators_of(x: Inputs):
    return x.v("f5b_candidates").groupBy("task", "input_idx").agg(
        F.max("canonical_cost").alias("base_cost"), (~F.bool_and("ok")).alias("has_error"))


def generator_status(scale_exp):
    return (F.when(F.col("has_error") & (scale_exp > 10), F.lit("error"))
            .when(F.col("base_cost") * F.pow(F.lit(2.0), scale_exp) > F.pow(F.lit(2.0), F.lit(40)), F.lit("timeout"))
            .otherwise(F.lit("ok")))


_SCALE_SQL = cte("f5b_candidates") + """,
gen as (select task, input_idx, max(canonical_cost) as base_cost, not bool_and(ok) as has_error
        from f5b_candidates group by task, input_idx),
tried as (select *, unnest(range(1, 27)) as scale_exp from gen),
st as (select *, case when has_error and scale_exp > 10 then 'error'
                      when base_cost * pow(2.0, scale_exp) > pow(2.0, 40) then 'timeout' else 'ok' end as status from tried),
lad as (select task, input_idx, min(scale_exp) filter (where status <> 'ok') as first_stop,
               arg_min(status, case when status <> 'ok' then scale_exp end) as stop_status from st group by task, input_idx),
sl as (select task, input_idx,
              cast(case when first_stop is null then 26 when first_stop > 1 then first_stop - 1 end as integer) as last_scale_exp,
              coalesce(stop_status <> 'error', true) as well_defined from lad)
"""


@register("scale_ladder", _SCALE_SQL + "select task, input_idx, last_scale_exp, well_defined from sl")
def q_scale_ladder(spark, sf_dir):
    return P.scale_ladder(generators_of(Inputs(spark, sf_dir)), generator_status)


@register("first_well_defined_generator", _SCALE_SQL + """
select task, input_idx from (select *, coalesce(sum(cast(well_defined as integer)) over (partition by task order by input_idx
  rows between unbounded preceding and 1 preceding), 0) as seen from sl) where seen = 0""")
def q_first_well_defined(spark, sf_dir):
    lad = P.scale_ladder(generators_of(Inputs(spark, sf_dir)), generator_status)
    return P.first_well_defined_generator(lad).select("task", "input_idx")
