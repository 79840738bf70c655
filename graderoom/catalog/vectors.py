"""Registered queries: fingerprints, clustering, representatives, plans, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from graderoom.fixtures import Inputs, cte
from graderoom.functions.exprs import r6
from graderoom.operators import relational as Rel
from graderoom.operators import vectors as Vec
from graderoom.registry import register

K = 3
CENTRE_MODELS = [f"org--model{i}_hf_temp_0.0" for i in range(K)]


def fingerprints(x: Inputs):
    return Vec.mean_pool_fingerprint(x.v("f4_responses"))


def given_centres(fps):
    """Initial centres: fingerprints of the first K labels (K rows x dims, a bounded collect)."""
    rows = fps.where(F.col("model_identifier").isin(CENTRE_MODELS)).collect()
    by_id = {r["model_identifier"]: list(r["embedding"]) for r in rows}
    return [by_id[m] for m in CENTRE_MODELS]


def assigned_models(x: Inputs):
    fps = fingerprints(x)
    return Vec.kmeans_assign(fps, given_centres(fps))


def models_with_accuracy(x: Inputs):
    return Rel.attach_accuracy(assigned_models(x).select("model_identifier", "cluster"), x.v("f4_accuracy"))


_FP = cte("f4_responses", "f4_accuracy") + """,
e as (select model_identifier, unnest(embedding) as x, unnest(generate_series(0, len(embedding) - 1)) as dim from f4_responses),
lng as (select model_identifier, cast(dim as integer) as dim, avg(x) as value from e group by model_identifier, dim),
fp as (select model_identifier, list(value order by dim) as emb from lng group by model_identifier),
cen as (select cast(regexp_extract(model_identifier, 'model([0-9]+)_', 1) as integer) as cluster, emb as centre from fp
        where model_identifier in ('org--model0_hf_temp_0.0', 'org--model1_hf_temp_0.0', 'org--model2_hf_temp_0.0')),
dist as (select fp.model_identifier, cen.cluster,
                list_reduce(list_transform(range(len(fp.emb)), lambda i: (fp.emb[i + 1] - cen.centre[i + 1]) * (fp.emb[i + 1] - cen.centre[i + 1])), lambda a, b: a + b) as d
         from fp, cen),
asg as (select model_identifier, arg_min(cluster, (d, cluster)) as cluster from dist group by model_identifier),
acc as (select a.model_identifier, a.cluster, f.accuracy from asg a left join f4_accuracy f using (model_identifier)),
reps0 as (select *, row_number() over (partition by cluster order by accuracy desc, model_identifier) as r from acc where accuracy is not null),
reps as (select model_identifier, cluster, accuracy, cast(row_number() over (order by accuracy desc, cluster) as integer) as rank from reps0 where r = 1)
"""


@register("mean_pool_fingerprint", _FP + "select model_identifier, dim, round(value, 6) as value from lng")
def q_mean_pool(spark, sf_dir):
    long = Vec.mean_pool_long(Inputs(spark, sf_dir).v("f4_responses"))
    return long.select("model_identifier", "dim", r6("value").alias("value"))


@register("fingerprint_dims", _FP + "select model_identifier, cast(len(emb) as integer) as dims from fp")
def q_fingerprint_dims(spark, sf_dir):
    fps = Vec.check_dimensions(fingerprints(Inputs(spark, sf_dir)))
    return fps.select("model_identifier", F.size("embedding").alias("dims"))


@register("kmeans_assign", _FP + "select model_identifier, cluster from asg")
def q_kmeans_assign(spark, sf_dir):
    return assigned_models(Inputs(spark, sf_dir)).select("model_identifier", "cluster")


@register("cluster_members", _FP + """
select cluster, string_agg(model_identifier, ',' order by model_identifier) as members, count(*) as n_members
from asg group by cluster""")
def q_cluster_members(spark, sf_dir):
    return Vec.cluster_members(assigned_models(Inputs(spark, sf_dir)))


@register("cluster_representatives", _FP + """
select cluster, model_identifier, round(accuracy, 6) as accuracy, rank from reps""")
def q_cluster_representatives(spark, sf_dir):
    reps = Vec.cluster_representatives(models_with_accuracy(Inputs(spark, sf_dir)))
    return reps.select("cluster", "model_identifier", r6("accuracy").alias("accuracy"), "rank")


@register("select_ensemble", _FP + "select rank, model_identifier from reps")
def q_select_ensemble(spark, sf_dir):
    reps = Vec.cluster_representatives(models_with_accuracy(Inputs(spark, sf_dir)))
    return reps.select("rank", "model_identifier")


@register("ensemble_plans", _FP + """,
n as (select count(*) as n from reps),
ranked as (select model_identifier, accuracy, row_number() over (order by accuracy desc, model_identifier) as r from acc where accuracy is not null),
plans as (
  select 'cluster' as ensemble, cast(rank - 1 as integer) as step, model_identifier from reps
  union all select 'top', cast(r - 1 as integer), model_identifier from ranked where r <= (select n from n)
  union all select 'best', cast(unnest(range(0, (select n from n))) as integer), model_identifier from reps where rank = 1
  union all select 'least', cast(unnest(range(0, (select n from n))) as integer), model_identifier from reps where rank = (select n from n)
  union all select 'baseline:' || model_identifier, 0, model_identifier from ranked)
select ensemble, step, model_identifier, lag(model_identifier) over (partition by ensemble order by step) as previous_model from plans""")
def q_ensemble_plans(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    models = models_with_accuracy(x)
    reps = Vec.cluster_representatives(models)
    return Vec.ensemble_plans(reps, models)


@register("kmeans_models")
def q_kmeans_models(spark, sf_dir):
    return Vec.kmeans_models(fingerprints(Inputs(spark, sf_dir)), k=K, seed=42)


@register("pca_project")
def q_pca_project(spark, sf_dir):
    return Vec.pca_project(fingerprints(Inputs(spark, sf_dir)))


_HEX = "(instr('0123456789abcdef', substr(md5(w), {i}, 1)) - 1)"

# 64 buckets: the last six bits of the first eight hex digits
@register("embed_responses", cte("f3_generations") + f""",
w as (select task_id, step, list_transform(list_filter(string_split_regex(lower(solution), '[^0-9a-z_]+'), lambda w: w <> ''),
             lambda w: ({_HEX.format(i=7)} % 4) * 16 + {_HEX.format(i=8)}) as b from f3_generations),
n as (select task_id, step, list_transform(range(64), lambda i: len(list_filter(b, lambda x: x = i))) as n from w)
select task_id, step, list_transform(n, lambda v: case when list_sum(n) = 0 then 0.0 else
       round(v / sqrt(list_sum(list_transform(n, lambda u: u * u))), 6) end) as embedding from n""")
def q_embed_responses(spark, sf_dir):
    g = Inputs(spark, sf_dir).v("f3_generations").select("task_id", "step", "solution")
    e = Vec.embed_responses(g, "solution", 64)
    return e.select("task_id", "step", F.transform("embedding", lambda v: F.round(v, 6)).alias("embedding"))


@register("seeded_split", cte("problems_catalog") + """,
h as (select task_id, md5(task_id || ':42') as hh from problems_catalog)
select task_id, case when row_number() over (order by hh, task_id) <= floor(count(*) over () * 0.8) then 'val' else 'test' end as split
from h""")
def q_seeded_split(spark, sf_dir):
    return Vec.seeded_split(Inputs(spark, sf_dir).v("problems_catalog"), seed=42, ratio=0.8)
