"""Registered queries: comparisons, special oracles, time limits, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graderoom.fixtures import F2_PARAMS, Inputs, cte
from graderoom.functions.exprs import r6
from graderoom.operators import typed as T
from graderoom.operators import verdict as V
from graderoom.registry import register

F2_LIMITS = V.Limits(**F2_PARAMS)


def executions(spark, sf_dir):
    return Inputs(spark, sf_dir).v("f2_executions")


# Shared oracle chain for F2 (min_limit 0.1, factor 4, cap 0.3, extra 0).
_RUN = "partition by sample_id, suite order by input_idx rows between unbounded preceding and current row"
_BEFORE = "partition by sample_id, suite order by input_idx rows between unbounded preceding and 1 preceding"


def _details_sql(fast: bool) -> str:
    kept = (f"coalesce(sum(case when ok then 0 else 1 end) over ({_BEFORE}), 0) = 0" if fast else "true")
    return cte("f2_executions") + f""",
a as (select *, greatest(0.1, 4.0 * ref_time) as lim,
             actual is not null and run_time <= greatest(0.1, 4.0 * ref_time) as produced from f2_executions),
b as (select *, max(case when produced and expected_is_float then 1 else 0 end) over ({_RUN}) as seen_float,
             sum(least(run_time, lim)) over ({_RUN}) as elapsed_total from a),
c as (select *, case when atol <> 0 then atol when seen_float = 1 then 0.000001 else 0.0 end as tol from b),
d as (select *, coalesce(produced and (actual = expected or (tol <> 0 and abs(actual - expected) <= tol + 0.0000001 * abs(expected))), false) as ok from c),
e as (select *, {kept} as kept, elapsed_total <= 0.3 as in_budget from d),
det as (select *, kept and in_budget as detail from e),
ver as (select sample_id, suite,
          case when bool_or(kept and not in_budget) then 'timeout'
               when bool_or(detail and not ok) then 'fail' else 'pass' end as status,
          count(*) filter (where detail) as n_details
        from det group by sample_id, suite)
"""


@register("compare_outputs", cte("f2_executions") + """
select sample_id, suite, input_idx,
  coalesce(actual is not null and (actual = expected or
    ((case when atol <> 0 then atol when expected_is_float then 0.000001 else 0.0 end) <> 0 and
     abs(actual - expected) <= (case when atol <> 0 then atol when expected_is_float then 0.000001 else 0.0 end)
                               + 0.0000001 * abs(expected))), false) as ok
from f2_executions""")
def q_compare_outputs(spark, sf_dir):
    return V.compare_outputs(executions(spark, sf_dir)).select("sample_id", "suite", "input_idx", "ok")


@register("sticky_tolerance", _details_sql(True) + "select sample_id, suite, input_idx, tol from c")
def q_sticky_tolerance(spark, sf_dir):
    t = V.sticky_tolerance(executions(spark, sf_dir), F2_LIMITS)
    return t.select("sample_id", "suite", "input_idx", "tol")


@register("input_time_limit", cte("f2_executions") + """
select sample_id, suite, count(*) as n_inputs, round(least(0.3, sum(greatest(0.1, 4.0 * ref_time))) + 0.0, 6) as budget
from f2_executions group by sample_id, suite""")
def q_input_time_limit(spark, sf_dir):
    t = V.input_time_limit(executions(spark, sf_dir), F2_LIMITS)
    return t.select("sample_id", "suite", "n_inputs", r6("budget").alias("budget"))


@register("derive_verdict", _details_sql(True) + "select sample_id, suite, status, n_details from ver")
def q_derive_verdict(spark, sf_dir):
    d = V.verdict_details(executions(spark, sf_dir), F2_LIMITS, fast=True)
    return V.derive_verdict(d).select("sample_id", "suite", "status", "n_details")


@register("fast_check_details", _details_sql(True) + "select sample_id, suite, input_idx, ok from det where detail")
def q_fast_check_details(spark, sf_dir):
    d = V.verdict_details(executions(spark, sf_dir), F2_LIMITS, fast=True)
    return d.where("detail").select("sample_id", "suite", "input_idx", "ok")


@register("failed_tests", _details_sql(False) + """
select v.sample_id, v.suite, v.status,
       case when v.status = 'pass' then '' else coalesce(
         (select string_agg(cast(d.input_idx as varchar), ',' order by d.input_idx) from det d
          where d.sample_id = v.sample_id and d.suite = v.suite and d.detail and not d.ok), '') end as failed_inputs
from ver v""")
def q_failed_tests(spark, sf_dir):
    d = V.verdict_details(executions(spark, sf_dir), F2_LIMITS, fast=False)
    return V.failed_tests(d, fast=False)


@register("concat_suites_verdict", cte("f2_executions") + f""",
nb as (select sample_id, count(*) filter (where suite = 'base') as n_base from f2_executions group by sample_id),
f2c as (select x.sample_id, 'all' as suite, x.task_id,
               case when x.suite = 'plus' then x.input_idx + nb.n_base else x.input_idx end as input_idx,
               x.expected, x.actual, x.expected_is_float, x.atol, x.ref_time, x.run_time
        from f2_executions x join nb using (sample_id)),
a as (select *, greatest(0.1, 4.0 * ref_time) as lim,
             actual is not null and run_time <= greatest(0.1, 4.0 * ref_time) as produced from f2c),
b as (select *, max(case when produced and expected_is_float then 1 else 0 end) over ({_RUN}) as seen_float,
             sum(least(run_time, lim)) over ({_RUN}) as elapsed_total from a),
c as (select *, case when atol <> 0 then atol when seen_float = 1 then 0.000001 else 0.0 end as tol from b),
d as (select *, coalesce(produced and (actual = expected or (tol <> 0 and abs(actual - expected) <= tol + 0.0000001 * abs(expected))), false) as ok from c),
e as (select *, coalesce(sum(case when ok then 0 else 1 end) over ({_BEFORE}), 0) = 0 as kept, elapsed_total <= 0.3 as in_budget from d)
select sample_id,
       case when bool_or(kept and not in_budget) then 'timeout'
            when bool_or(kept and in_budget and not ok) then 'fail' else 'pass' end as status,
       count(*) filter (where kept and in_budget) as n_details
from e group by sample_id""")
def q_concat_suites_verdict(spark, sf_dir):
    ex = executions(spark, sf_dir)
    n_base = ex.groupBy("sample_id").agg(F.count_if(F.col("suite") == "base").alias("n_base"))
    both = ex.join(n_base, "sample_id").select(
        "sample_id", F.lit("all").alias("suite"), "task_id",
        F.when(F.col("suite") == "plus", F.col("input_idx") + F.col("n_base")).otherwise(F.col("input_idx")).alias("input_idx"),
        "expected", "actual", "expected_is_float", "atol", "ref_time", "run_time")
    d = V.verdict_details(both, F2_LIMITS, fast=True)
    return V.derive_verdict(d).select("sample_id", "status", "n_details")


@register("typed_comparison", cte("f9_typed") + "select sample_id, suite, input_idx, truth as ok from f9_typed")
def q_typed_comparison(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    ex = T.with_rules(x.v("f9_typed"), x.v("f9_problems"))
    d = V.verdict_details(ex, V.Limits(), fast=False, matches=lambda tol: T.matches(tol, "rule"), actual="actual_kind")
    return d.select("sample_id", "suite", "input_idx", "ok")


# ---------------------------------------------------------------- special oracles


@register("oracle_set_equal", cte("f7_values") + """,
l as (select seed_id, cast(value_text as double[]) as out_list from f7_values where kind = 'list'),
e as (select seed_id, out_list,
             case when seed_id % 3 = 0 then list_concat(list_reverse(out_list), out_list)
                  when seed_id % 3 = 1 then list_append(out_list, 99.0) else out_list end as exp_list from l)
select seed_id, list_sort(list_distinct(out_list)) = list_sort(list_distinct(exp_list)) as set_equal from e""")
def q_oracle_set_equal(spark, sf_dir):
    v = Inputs(spark, sf_dir).v("f7_values").where(F.col("kind") == "list")
    v = v.select("seed_id", F.from_json("value_text", "array<double>").alias("out_list"))
    exp = (F.when(F.col("seed_id") % 3 == 0, F.concat(F.reverse("out_list"), F.col("out_list")))
           .when(F.col("seed_id") % 3 == 1, F.array_append("out_list", F.lit(99.0))).otherwise(F.col("out_list")))
    return v.select("seed_id", V.set_equal(F.col("out_list"), exp).alias("set_equal"))


@register("oracle_not_none", cte("f2_executions") + """
select sample_id, suite, input_idx,
  case when input_idx % 3 = 0 and actual is not null then (actual >= expected) = (expected > 50000)
       else (expected > 50000) = (actual is not null) end as ok
from f2_executions""")
def q_oracle_not_none(spark, sf_dir):
    ex = executions(spark, sf_dir)
    is_bool = (F.col("input_idx") % 3 == 0) & F.col("actual").isNotNull()
    ok = V.not_none_oracle(is_bool, F.col("actual") >= F.col("expected"), F.col("actual").isNotNull(),
                           F.col("expected") > 50000)
    return ex.select("sample_id", "suite", "input_idx", ok.alias("ok"))


_ENTRY_POINTS = "('are_equivalent', 'sum_div', 'surface_Area', 'digit_distance_nums', 'plain_task')"


@register("oracle_alternatives", cte("f2_executions") + """,
rules as (select * from (values ('are_equivalent', 'always'), ('sum_div', 'zero'), ('surface_Area', 'surface_area'),
  ('digit_distance_nums', 'digit_distance'), ('check_str', 'not_none'), ('text_match_three', 'not_none'),
  ('text_starta_endb', 'not_none'), ('similar_elements', 'set_equal'), ('find_char_long', 'set_equal'),
  ('common_in_nested_lists', 'set_equal'), ('extract_singly', 'set_equal'), ('larg_nnum', 'set_equal'),
  ('intersection_array', 'set_equal'), ('find_dissimilar', 'set_equal'), ('Diff', 'set_equal'),
  ('find_zero', 'polynomial_root')) t(entry_point, rule)),
x as (select e.*, (['are_equivalent', 'sum_div', 'surface_Area', 'digit_distance_nums', 'plain_task'])
                    [cast(split_part(task_id, '/', 2) as integer) % 5 + 1] as entry_point
      from f2_executions e),
y as (select x.*, coalesce(r.rule, 'plain') as rule from x left join rules r using (entry_point))
select sample_id, suite, input_idx, rule,
  coalesce(actual = expected, false) or rule = 'always' or (rule = 'zero' and coalesce(actual = 0, false))
  or (rule = 'surface_area' and coalesce(abs(actual - round(expected)) <= 1.0, false))
  or (rule = 'digit_distance' and coalesce(actual = floor(expected), false)) as ok
from y""")
def q_oracle_alternatives(spark, sf_dir):
    ex = executions(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in ["are_equivalent", "sum_div", "surface_Area", "digit_distance_nums", "plain_task"]])
    idx = F.split("task_id", "/").getItem(1).cast("int") % 5
    x = ex.withColumn("entry_point", F.element_at(names, idx + 1))
    y = x.join(V.oracle_rule_table(spark), "entry_point", "left").fillna("plain", ["rule"])
    alt = F.when(F.col("rule") == "surface_area", F.round("expected")).otherwise(F.floor("expected").cast("double"))
    atol = F.when(F.col("rule") == "surface_area", F.lit(1.0)).otherwise(F.lit(0.0))
    ok = V.alternatives_oracle(F.col("rule"), F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)),
                               F.col("actual"), alt, atol)
    return y.select("sample_id", "suite", "input_idx", "rule", F.coalesce(ok, F.lit(False)).alias("ok"))


@register("oracle_surface_area", """
select p_partkey, round_even(power(p_size, 2) + 4 * (p_size * sqrt(power(p_size / 2, 2) + power(p_retailprice / 100, 2))) / 2, 0) as surface
from part""")
def q_oracle_surface_area(spark, sf_dir):
    p = Inputs(spark, sf_dir).t("part")
    return p.select("p_partkey", V.surface_area(F.col("p_size").cast("double"), F.col("p_retailprice") / 100).alias("surface"))


@register("oracle_digit_distance", """
with s as (select l_partkey, l_suppkey, cast(l_partkey as varchar) as a, cast(l_suppkey as varchar) as b from lineitem),
w as (select *, cast(greatest(length(a), length(b)) as integer) as width from s),
p as (select *, lpad(a, width, '0') as pa, lpad(b, width, '0') as pb from w)
select l_partkey, l_suppkey,
  cast(list_sum(list_transform(range(1, width + 1),
    lambda i: abs(cast(substr(pa, i, 1) as integer) - cast(substr(pb, i, 1) as integer)))) as integer) as distance
from p""")
def q_oracle_digit_distance(spark, sf_dir):
    li = Inputs(spark, sf_dir).t("lineitem")
    return li.select("l_partkey", "l_suppkey", V.digit_distance(F.col("l_partkey"), F.col("l_suppkey")).alias("distance"))


@register("oracle_polynomial_root", cte("f7_values") + """,
l as (select seed_id, cast(value_text as double[]) as coeffs, cast(seed_id % 3 as double) - 1 as x from f7_values where kind = 'list'),
p as (select seed_id, list_reduce(list_transform(range(len(coeffs)), lambda i: coeffs[i + 1] * pow(x, i)), lambda a, b: a + b, 0.0) as value from l)
select seed_id, round(value, 6) as value, abs(value) <= 0.000001 as is_root from p""")
def q_oracle_polynomial_root(spark, sf_dir):
    v = Inputs(spark, sf_dir).v("f7_values").where(F.col("kind") == "list")
    v = v.select("seed_id", F.from_json("value_text", "array<double>").alias("coeffs"),
                 ((F.col("seed_id") % 3).cast("double") - 1).alias("x"))
    val = V.polynomial(F.col("coeffs"), F.col("x"))
    return v.select("seed_id", r6(val).alias("value"), (F.abs(val) <= 1e-6).alias("is_root"))
