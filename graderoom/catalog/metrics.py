"""Registered queries: sample counts, pass@k, leaderboard, ordering windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from graderoom.fixtures import Inputs, cte
from graderoom.functions.exprs import r6
from graderoom.operators import metrics as M
from graderoom.operators import ranking as R
from graderoom.registry import register

KS = (1, 5, 10, 100, 1000)  # 1000 exceeds every task's n at sf0.01, so the min-n gate drops it


def known_samples(x: Inputs):
    """F1 samples whose task exists in F0 (what an evaluation keeps)."""
    return x.v("f1_samples").join(x.v("f0_problems").select("task_id"), "task_id", "left_semi")


_KNOWN = cte("f0_problems", "f1_samples") + """,
s as (select * from f1_samples where task_id in (select task_id from f0_problems)),
c as (select model, task_id, count(*) as n,
             count(*) filter (where base_status = 'pass') as c_base,
             count(*) filter (where base_status = 'pass' and plus_status = 'pass') as c_plus
      from s group by model, task_id),
l as (select model, task_id, n, 'base' as suite, c_base as c from c
      union all select model, task_id, n, 'plus' as suite, c_plus as c from c),
kk as (select cast(unnest([1, 5, 10, 100, 1000]) as integer) as k),
pt as (select model, task_id, suite, k, n, c,
              case when n - c < k then 1.0
                   else 1.0 - list_reduce(list_transform(range(k), lambda j: (n - c - j) / (n - j)), lambda a, b: a * b)
              end as pass_at_k
       from l, kk)
"""


@register("task_counts", _KNOWN + "select model, task_id, n, c_base, c_plus from c")
def q_task_counts(spark, sf_dir):
    return M.task_counts(known_samples(Inputs(spark, sf_dir)))


@register("plus_pass", cte("f1_samples") + """
select sample_id, base_status, plus_status, base_status = 'pass' and plus_status = 'pass' as plus_correct
from f1_samples""")
def q_plus_pass(spark, sf_dir):
    s = Inputs(spark, sf_dir).v("f1_samples").select("sample_id", "base_status", "plus_status")
    return M.plus_pass(s)


@register("pass_at_k_task", _KNOWN + """
select model, task_id, suite, k, n, c, round(pass_at_k, 6) as pass_at_k from pt""")
def q_pass_at_k_task(spark, sf_dir):
    counts = M.task_counts(known_samples(Inputs(spark, sf_dir)))
    out = M.pass_at_k_task(counts, KS)
    return out.select("model", "task_id", "suite", "k", "n", "c", r6("pass_at_k").alias("pass_at_k"))


_PASS_AT_K_SQL = _KNOWN + """,
agg as (select model, suite, k, avg(pass_at_k) as pass_at_k, min(n) as min_n from pt group by model, suite, k)
select model, suite, k, round(pass_at_k, 6) as pass_at_k from agg where min_n >= k"""


def pass_at_k_query(spark, sf_dir):
    counts = M.task_counts(known_samples(Inputs(spark, sf_dir)))
    return M.pass_at_k(counts, KS).select("model", "suite", "k", r6("pass_at_k").alias("pass_at_k"))


register("pass_at_k", _PASS_AT_K_SQL)(pass_at_k_query)


@register("model_leaderboard", _KNOWN + """,
acc as (select model, avg(pass_at_k) filter (where suite = 'base') as base_accuracy,
               avg(pass_at_k) filter (where suite = 'plus') as plus_accuracy
        from pt where k = 1 group by model)
select model, round(base_accuracy, 6) as base_accuracy, round(plus_accuracy, 6) as plus_accuracy,
       cast(row_number() over (order by plus_accuracy desc, base_accuracy desc, model) as integer) as rank
from acc""")
def q_model_leaderboard(spark, sf_dir):
    counts = M.task_counts(known_samples(Inputs(spark, sf_dir)))
    lb = M.model_leaderboard(counts, k=1)
    return lb.select("model", r6("base_accuracy").alias("base_accuracy"),
                     r6("plus_accuracy").alias("plus_accuracy"), "rank")


@register("pass_at_1_percent", cte("f5_profiles") + """
select task, round(avg(cast(passed as double)) * 100, 6) as pass_at_1, count(*) as n_samples
from f5_profiles group by task""")
def q_pass_at_1_percent(spark, sf_dir):
    out = M.pass_at_1_percent(Inputs(spark, sf_dir).v("f5_profiles"))
    return out.select("task", r6("pass_at_1").alias("pass_at_1"), "n_samples")


@register("completion_index", cte("f1_samples") + """
select sample_id, task_id, cast(row_number() over (partition by task_id order by sample_id) - 1 as integer) as completion_id
from f1_samples""")
def q_completion_index(spark, sf_dir):
    s = Inputs(spark, sf_dir).v("f1_samples").select("sample_id", "task_id")
    return R.completion_index(s, "task_id", "sample_id")


@register("top_n_models", _KNOWN + """,
acc as (select model, avg(pass_at_k) as accuracy from pt where k = 1 and suite = 'plus' group by model)
select model, round(accuracy, 6) as accuracy from acc order by accuracy desc, model limit 3""")
def q_top_n_models(spark, sf_dir):
    counts = M.task_counts(known_samples(Inputs(spark, sf_dir)))
    acc = M.pass_at_k(counts, ks=[1]).where(F.col("suite") == "plus").select(
        "model", F.col("pass_at_k").alias("accuracy"))
    top = R.top_n(acc, 3, F.desc("accuracy"), F.asc("model"))
    return top.select("model", r6("accuracy").alias("accuracy"))


@register("sample_completeness", cte("f0_problems", "f1_samples") + """,
c as (select task_id, count(*) as n from f1_samples group by task_id),
j as (select p.task_id, coalesce(c.n, 0) as n from f0_problems p left join c using (task_id))
select count(*) as n_tasks, count(*) filter (where n >= 120) as n_done, count(*) filter (where n < 120) as n_incomplete,
       count(*) filter (where n <= 120) as n_done_inverted from j""")
def q_sample_completeness(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return M.sample_completeness(x.v("f0_problems"), x.v("f1_samples"), 120)
