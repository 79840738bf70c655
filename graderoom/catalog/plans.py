"""Registered queries: end-to-end compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from graderoom.catalog.perf import _SCORED, _stats_sql, generator_status, generators_of, ladder_of, MAX_PROFILE, MIN_CORRECT, N_SAMPLES
from graderoom.catalog.perf import _SCALE_SQL
from graderoom.catalog.vectors import _FP, fingerprints, given_centres
from graderoom.catalog.verdict import F2_LIMITS
from graderoom.fixtures import VIEWS, Inputs, cte
from graderoom.functions.exprs import r6
from graderoom.operators import perf as P
from graderoom.operators import verdict as V
from graderoom.plans import evaluation as E
from graderoom.registry import register

_RUN = "partition by sample_id, suite order by input_idx rows between unbounded preceding and current row"
_BEFORE = "partition by sample_id, suite order by input_idx rows between unbounded preceding and 1 preceding"

_EVAL_SQL = cte("f0_problems", "problems_catalog", "f2_executions") + f""",
ex as (select *, 'm' || cast(cast(sample_id as bigint) % 4 as varchar) as model from f2_executions
       where task_id in (select task_id from problems_catalog where variant <> 'noextreme')
         and task_id in (select task_id from f0_problems)),
a as (select *, greatest(0.1, 4.0 * ref_time) as lim,
             actual is not null and run_time <= greatest(0.1, 4.0 * ref_time) as produced from ex),
b as (select *, max(case when produced and expected_is_float then 1 else 0 end) over ({_RUN}) as seen_float,
             sum(least(run_time, lim)) over ({_RUN}) as elapsed_total from a),
c as (select *, case when atol <> 0 then atol when seen_float = 1 then 0.000001 else 0.0 end as tol from b),
d as (select *, coalesce(produced and (actual = expected or (tol <> 0 and abs(actual - expected) <= tol + 0.0000001 * abs(expected))), false) as ok from c),
e as (select *, coalesce(sum(case when ok then 0 else 1 end) over ({_BEFORE}), 0) = 0 as kept, elapsed_total <= 0.3 as in_budget from d),
det as (select *, kept and in_budget as detail from e),
ver as (select sample_id, suite,
          case when bool_or(kept and not in_budget) then 'timeout' when bool_or(detail and not ok) then 'fail' else 'pass' end as status,
          max(input_idx) filter (where detail) as last_idx
        from det group by sample_id, suite),
smp as (select distinct sample_id, task_id, model from ex),
rep as (select s.sample_id, s.task_id, s.model,
               coalesce(vb.status, 'pass') as base_status, coalesce(vp.status, 'pass') as plus_status,
               case when vb.status is null or vb.status = 'pass' then '' else coalesce(cast(vb.last_idx as varchar), '') end as base_fail_tests,
               case when vp.status is null or vp.status = 'pass' then '' else coalesce(cast(vp.last_idx as varchar), '') end as plus_fail_tests
        from smp s left join ver vb on vb.sample_id = s.sample_id and vb.suite = 'base'
                   left join ver vp on vp.sample_id = s.sample_id and vp.suite = 'plus'),
cnt as (select model, task_id, count(*) as n, count(*) filter (where base_status = 'pass') as c_base,
               count(*) filter (where base_status = 'pass' and plus_status = 'pass') as c_plus from rep group by model, task_id),
l as (select model, task_id, n, 'base' as suite, c_base as c from cnt union all select model, task_id, n, 'plus', c_plus from cnt),
kk as (select cast(unnest([1, 5, 10, 100]) as integer) as k),
pt as (select model, task_id, suite, k, n,
              case when n - c < k then 1.0 else 1.0 - list_reduce(list_transform(range(k), lambda j: (n - c - j) / (n - j)), lambda x, y: x * y) end as p
       from l, kk),
pk as (select model, suite, k, avg(p) as pass_at_k, min(n) as min_n from pt group by model, suite, k)
"""


def _evaluate(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    ex = x.v("f2_executions").withColumn(
        "model", F.concat(F.lit("m"), (F.col("sample_id").cast("bigint") % 4).cast("string")))
    split = x.v("problems_catalog").where(F.col("variant") != "noextreme").select("task_id")
    return E.evaluate_run(ex, x.v("f0_problems"), split, F2_LIMITS, ks=(1, 5, 10, 100), fast=True)


@register("evaluate_run", _EVAL_SQL + "select model, suite, k, round(pass_at_k, 6) as pass_at_k from pk where min_n >= k")
def q_evaluate_run(spark, sf_dir):
    _, pk = _evaluate(spark, sf_dir)
    return pk.select("model", "suite", "k", r6("pass_at_k").alias("pass_at_k"))


@register("evaluate_report", _EVAL_SQL + """
select sample_id, task_id, model, base_status, plus_status, base_fail_tests, plus_fail_tests from rep""")
def q_evaluate_report(spark, sf_dir):
    report, _ = _evaluate(spark, sf_dir)
    return report


@register("evaluate_typed", cte("f9_problems", "f9_typed") + """,
smp as (select cast(o_orderkey as varchar) as sample_id, 'Typed/' || cast(o_orderkey % 32 as varchar) as task_id,
               'm' || cast(o_orderkey % 3 as varchar) as model, o_orderkey % 11 = 0 as load_error from orders),
ver as (select sample_id, suite, case when bool_and(truth) then 'pass' else 'fail' end as status,
               string_agg(inputs, ',' order by input_idx) filter (where not truth) as bad from f9_typed group by sample_id, suite),
ran as (select task_id, suite from f9_typed group by task_id, suite),
j as (select s.*, r.suite, case when load_error then 'fail' when v.status is null then 'fail' else v.status end as status,
             case when load_error then '' else coalesce(v.bad, '') end as bad
      from smp s join ran r using (task_id) left join ver v on v.sample_id = s.sample_id and v.suite = r.suite)
select sample_id, task_id, model, max(status) filter (where suite = 'base') as base_status, max(status) filter (where suite = 'plus') as plus_status,
       max(bad) filter (where suite = 'base') as base_fail_tests, max(bad) filter (where suite = 'plus') as plus_fail_tests
from j group by sample_id, task_id, model""")
def q_evaluate_typed(spark, sf_dir):
    """All orders are samples: some have load errors, some never ran. Failing inputs are listed as values."""
    x = Inputs(spark, sf_dir)
    key = F.col("o_orderkey")
    samples = x.t("orders").select(
        key.cast("string").alias("sample_id"), F.concat(F.lit("Typed/"), (key % 32).cast("string")).alias("task_id"),
        F.concat(F.lit("m"), (key % 3).cast("string")).alias("model"), (key % 11 == 0).alias("load_error"))
    problems = x.v("f9_problems")
    report, _ = E.evaluate_run(x.v("f9_typed"), problems, problems.select("task_id"), V.Limits(), fast=False,
                               samples=samples, typed=True, show="inputs")
    return report


@register("ensemble_run", _FP + f""", f1_samples as ({VIEWS["f1_samples"]}),
n as (select count(*) as n from reps),
ranked as (select model_identifier, accuracy, row_number() over (order by accuracy desc, model_identifier) as r from acc where accuracy is not null),
plans as (
  select 'cluster' as ensemble, cast(rank - 1 as integer) as step, model_identifier from reps
  union all select 'top', cast(r - 1 as integer), model_identifier from ranked where r <= (select n from n)
  union all select 'best', cast(unnest(range(0, (select n from n))) as integer), model_identifier from reps where rank = 1
  union all select 'least', cast(unnest(range(0, (select n from n))) as integer), model_identifier from reps where rank = (select n from n)
  union all select 'baseline:' || model_identifier, 0, model_identifier from ranked),
st as (select 'org--model' || substr(model, 2) || '_hf_temp_0.0' as model_identifier, cast(cast(split_part(sample_id, '-', 2) as integer) % 3 as integer) as step,
              task_id, base_status = 'pass' as b, base_status = 'pass' and plus_status = 'pass' as p from f1_samples),
tk as (select model_identifier, step, task_id, avg(cast(b as double)) as b, avg(cast(p as double)) as p from st group by 1, 2, 3),
pk as (select model_identifier, step, 100.0 * avg(b) as b, 100.0 * avg(p) as p from tk group by 1, 2)
select p.ensemble, p.step, p.model_identifier, lag(p.model_identifier) over (partition by p.ensemble order by p.step) as previous_model,
       round(a.accuracy, 6) as accuracy, round(pk.b, 6) as base_pass_at_1, round(pk.p, 6) as plus_pass_at_1
from plans p left join acc a using (model_identifier) left join pk on pk.model_identifier = p.model_identifier and pk.step = p.step""")
def q_ensemble_run(spark, sf_dir):
    """The samples of F1 are those of four of the models; their line number gives the step."""
    x = Inputs(spark, sf_dir)
    fps = fingerprints(x)
    reports = x.v("f1_samples").select(
        F.concat(F.lit("org--model"), F.substring("model", 2, 9), F.lit("_hf_temp_0.0")).alias("model_identifier"),
        (F.split("sample_id", "-")[1].cast("int") % 3).alias("step"), "task_id", "base_status", "plus_status")
    out = E.ensemble_run(fps, given_centres(fps), x.v("f4_accuracy"), reports)
    return out.select("ensemble", "step", "model_identifier", "previous_model", r6("accuracy").alias("accuracy"),
                      r6("base_pass_at_1").alias("base_pass_at_1"), r6("plus_pass_at_1").alias("plus_pass_at_1"))


_CURATED = _stats_sql(0.1) + """,
cur as (select * from ladder where task in (select task from g4))
"""


@register("curate_perf_tasks", _CURATED + "select task, ref_idx, solution_idx, ref_cost, round(score, 6) as score from cur")
def q_curate_perf_tasks(spark, sf_dir):
    lad = E.curate_perf_tasks(Inputs(spark, sf_dir).v("f5_profiles"))
    return lad.select("task", "ref_idx", "solution_idx", "ref_cost", r6("score").alias("score"))


_EFF = _SCORED.replace("from ladder l where l.task = c.task", "from cur l where l.task = c.task") \
    .replace("left join ladder l on", "left join cur l on") \
    .replace("from f5_profiles),", "from f5_profiles where task in (select task from g4)),")


@register("efficiency_run", _CURATED + _EFF + """
select round(avg(dps), 6) as dps, round(avg(dps_norm), 6) as dps_norm, round(avg(pass_at_1), 6) as pass_at_1,
       count(dps) as n_evaluated from per_task""")
def q_efficiency_run(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    lad = E.curate_perf_tasks(x.v("f5_profiles"))
    samples = x.v("f5_profiles").select("task", "round_id", "passed", "cost")
    _, summary = E.efficiency_run(samples, lad, N_SAMPLES, MIN_CORRECT, MAX_PROFILE, strict=False)
    return summary.select(r6("dps").alias("dps"), r6("dps_norm").alias("dps_norm"), r6("pass_at_1").alias("pass_at_1"),
                          "n_evaluated")


# Samples of F5 as solution texts with many copies; a third of the profiles was stored under these options, twice
# and at different costs, a third under others, the rest never. A fifth of the tasks is finished under this
# configuration, a fifth under another one.
OPTIONS = {"rounds": 3, "timeout": 20}
OTHER_OPTIONS = {"rounds": 1, "timeout": 20}
_REUSE = _stats_sql(0.1) + """,
sol as (select task, round_id, passed, 'solve(' || cast(solution_idx as varchar) || ')' as solution, solution_idx from f5_profiles),
fst as (select *, passed and sum(cast(passed as integer)) over (partition by task order by round_id) <= 20 as profiled
        from (select *, row_number() over (partition by task order by round_id) as rn from sol) where rn <= 40)
"""


def solutions_of(x: Inputs):
    text = F.concat(F.lit("solve("), F.col("solution_idx").cast("string"), F.lit(")"))
    return x.v("f5_profiles").select("task", "round_id", "passed", "solution_idx", text.alias("solution"))


def stored_profiles(solutions):
    """(profile_key, run, cost) of earlier runs over the distinct solutions."""
    each = solutions.select("task", "solution_idx", "solution").distinct()
    cost = 1000000.0 * (F.col("task") % 7 + 1) * (F.col("solution_idx") + 1)
    here = P.profile_key(each.where("solution_idx % 3 = 0"), OPTIONS).withColumn("cost", cost)
    there = P.profile_key(each.where("solution_idx % 3 = 1"), OTHER_OPTIONS).withColumn("cost", cost)
    runs = here.withColumn("run", F.lit(1)).unionByName(here.withColumn("run", F.lit(2)).withColumn("cost", cost / 2))
    return runs.unionByName(there.withColumn("run", F.lit(1))).select("profile_key", "run", "cost")


@register("profiles_wanted", _REUSE + """
select task, solution, count(*) as n_samples from fst where profiled and solution_idx % 3 <> 0 group by task, solution""")
def q_profiles_wanted(spark, sf_dir):
    s = solutions_of(Inputs(spark, sf_dir))
    capped = P.profile_key(P.first_n_and_cap(s, N_SAMPLES, MAX_PROFILE, strict=False), OPTIONS)
    return P.profiles_wanted(capped, stored_profiles(s)).select("task", "solution", "n_samples")


@register("efficiency_reuse", _REUSE + """,
ct as (select *, case when solution_idx % 3 = 0 then 1000000.0 * (task % 7 + 1) * (solution_idx + 1) end as cost from fst
       where task in (select task from ladder) and task % 5 <> 0),
mt as (select c.*, coalesce((select max(l.ref_idx) from ladder l where l.task = c.task and l.ref_cost >= round(c.cost, 3)), -1) as m from ct c),
sc as (select m.*, coalesce(l.score, 0.0) as d, case when m.m >= 0 then 100.0 * (m.m + 1) / l.n_ref else 0.0 end as dn
       from mt m left join ladder l on l.task = m.task and l.ref_idx = m.m),
pt as (select task, count(*) filter (where passed) >= 10 as enough, avg(d) filter (where profiled) as d, avg(dn) filter (where profiled) as dn,
              count(*) filter (where profiled) as n, 100.0 * avg(cast(passed as double)) as pass_at_1 from sc group by task)
select task, round(case when enough then d end, 6) as dps, round(case when enough then dn end, 6) as dps_norm,
       case when enough then n end as n_profiled, round(pass_at_1, 6) as pass_at_1 from pt
union all select task, 50.0, 60.0, 7, 70.0 from (select distinct task from ladder where task % 5 = 0)""")
def q_efficiency_reuse(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    lad = ladder_of(x)
    s = solutions_of(x)
    earlier = s.select("task").distinct().select(
        "task", F.lit(50.0).alias("dps"), F.lit(60.0).alias("dps_norm"), F.lit(7).cast("long").alias("n_profiled"), F.lit(70.0).alias("pass_at_1"))
    sizes = (N_SAMPLES, MIN_CORRECT, MAX_PROFILE)
    finished = E.finished_tasks(earlier.where("task % 5 = 0"), *sizes, OPTIONS).unionByName(
        E.finished_tasks(earlier.where("task % 5 = 1"), *sizes, OTHER_OPTIONS))
    per_task, _ = E.efficiency_run(s, lad, *sizes, stored=stored_profiles(s), options=OPTIONS, finished=finished, strict=False)
    return per_task.select("task", r6("dps").alias("dps"), r6("dps_norm").alias("dps_norm"), "n_profiled", r6("pass_at_1").alias("pass_at_1"))


@register("curate_pe_inputs", _SCALE_SQL + """,
kept as (select task, input_idx from (select *, coalesce(sum(cast(well_defined as integer)) over (partition by task order by input_idx
           rows between unbounded preceding and 1 preceding), 0) as seen from sl) where seen = 0),
pi as (select c.task, c.input_idx, quantile_cont(c.canonical_cost, 0.5) as median_cost, bool_and(c.ok) as all_ok
       from f5b_candidates c join kept k on k.task = c.task and k.input_idx = c.input_idx group by c.task, c.input_idx)
select task, arg_max(case when all_ok then input_idx end, case when all_ok then (median_cost, -input_idx) end) as pe_input_idx
from pi group by task""")
def q_curate_pe_inputs(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return E.curate_pe_inputs(x.v("f5b_candidates"), generators_of(x), generator_status)
