"""Registered queries: projections, predicates and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from graderoom.fixtures import Inputs, cte
from graderoom.functions.exprs import r6
from graderoom.operators import relational as Rel
from graderoom.registry import register


@register("filter_subset", cte("problems_catalog", "f1_samples") + """
select sample_id, task_id from f1_samples
where task_id in (select task_id from problems_catalog where variant = 'mini')""")
def q_filter_subset(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    split = x.v("problems_catalog").where(F.col("variant") == "mini")
    return Rel.filter_subset(x.v("f1_samples").select("sample_id", "task_id"), split)


@register("filter_id_range", cte("f1_samples") + """
select sample_id, task_id from f1_samples
where cast(split_part(task_id, '/', 2) as integer) >= 10 and cast(split_part(task_id, '/', 2) as integer) < 40""")
def q_filter_id_range(spark, sf_dir):
    s = Inputs(spark, sf_dir).v("f1_samples").select("sample_id", "task_id")
    return Rel.filter_id_range(s, 10, 40)


@register("quarantine_unknown_tasks", cte("f0_problems", "f1_samples") + """
select sample_id, task_id from f1_samples where task_id not in (select task_id from f0_problems)""")
def q_quarantine(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return Rel.quarantine_unknown_tasks(x.v("f1_samples").select("sample_id", "task_id"), x.v("f0_problems"))


def completion_samples(x: Inputs):
    """F3 turns as samples: odd steps carry a full solution, even steps only a completion."""
    g = x.v("f3_generations")
    return g.select(
        "task_id", "step", "prompt",
        F.when(F.col("step") % 2 == 1, F.col("solution")).alias("solution"),
        F.when(F.col("step") % 2 == 0, F.col("solution")).alias("completion"),
    )


_COMPLETION_SQL = """,
cs as (select task_id, step, prompt,
              case when step % 2 = 1 then solution end as solution,
              case when step % 2 = 0 then solution end as completion from f3_generations)
"""


@register("resolve_solution", cte("f3_generations") + _COMPLETION_SQL + """
select task_id, step, coalesce(solution, prompt || completion) as solution from cs""")
def q_resolve_solution(spark, sf_dir):
    s = completion_samples(Inputs(spark, sf_dir))
    return Rel.resolve_solution(s, "").select("task_id", "step", "solution")


_RAW_MODELS = """
raw_models as (select s_suppkey,
    concat('./org', cast(s_nationkey as string), '/', replace(s_name, '#', '-'), '/') as model,
    case s_suppkey % 3 when 0 then 'vllm' when 1 then 'hf' else 'openai' end as backend,
    cast(s_suppkey % 5 as double) / 5 as temperature
  from supplier)"""


def raw_models(x: Inputs):
    s = x.t("supplier")
    return s.select(
        "s_suppkey",
        F.concat(F.lit("./org"), F.col("s_nationkey").cast("string"), F.lit("/"),
                 F.regexp_replace("s_name", "#", "-"), F.lit("/")).alias("model"),
        F.when(F.col("s_suppkey") % 3 == 0, "vllm").when(F.col("s_suppkey") % 3 == 1, "hf")
        .otherwise("openai").alias("backend"),
        ((F.col("s_suppkey") % 5).cast("double") / 5).alias("temperature"),
    )


@register("encode_identifier", "with" + _RAW_MODELS + """
select s_suppkey, replace(trim(model, './'), '/', '--') || '_' || backend || '_temp_' || cast(temperature as varchar)
       as model_identifier from raw_models""")
def q_encode_identifier(spark, sf_dir):
    return Rel.encode_identifier(raw_models(Inputs(spark, sf_dir))).select("s_suppkey", "model_identifier")


_DECODE_INPUT = "with" + _RAW_MODELS + """,
enc as (select s_suppkey, case when s_suppkey % 7 = 0 then model
          else replace(trim(model, './'), '/', '--') || '_' || backend || '_temp_' || cast(temperature as varchar) end
        as model_identifier from raw_models)
"""


@register("decode_identifier", _DECODE_INPUT + """
select s_suppkey, model_identifier,
       replace(regexp_extract(model_identifier, '^(.*)_([^_]*)_temp_(.*)$', 1), '--', '/') as model,
       regexp_extract(model_identifier, '^(.*)_([^_]*)_temp_(.*)$', 2) as backend,
       regexp_extract(model_identifier, '^(.*)_([^_]*)_temp_(.*)$', 3) as temperature
from enc where regexp_matches(model_identifier, '^(.*)_([^_]*)_temp_(.*)$')""")
def q_decode_identifier(spark, sf_dir):
    enc = Rel.encode_identifier(raw_models(Inputs(spark, sf_dir)))
    enc = enc.select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, F.col("model"))
                     .otherwise(F.col("model_identifier")).alias("model_identifier"))
    return Rel.decode_identifier(enc)


@register("audit_columns", cte("problems_catalog") + """
select column_name, n_missing from (
  select 'task_id' as column_name, count(*) filter (where task_id is null) as n_missing from problems_catalog
  union all select 'prompt', count(*) filter (where prompt is null) from problems_catalog
  union all select 'contract', count(*) filter (where contract is null) from problems_catalog
  union all select 'canonical_solution', count(*) filter (where canonical_solution is null) from problems_catalog
  union all select 'entry_point', count(*) filter (where entry_point is null) from problems_catalog
  union all select 'atol', count(*) filter (where atol is null) from problems_catalog)""")
def q_audit_columns(spark, sf_dir):
    return Rel.audit_columns(Inputs(spark, sf_dir).v("problems_catalog"))


@register("guard_int64_and_size", cte("f7_values") + """,
c as (select seed_id, kind, seed_id % 7 = 0 as large, case when seed_id % 7 = 0 then
             case kind when 'int' then value_text || '99999999999999999999'
                       when 'list' then (case seed_id % 3 when 0 then '(' || substr(value_text, 2, length(value_text) - 2) || ', 99999999999999999999)'
                                                          when 1 then '{1: ' || value_text || ', 2: -99999999999999999999}'
                                                          else '[' || value_text || ', [99999999999999999999]]' end)
                       when 'str' then '["' || value_text || ' 99999999999999999999"]' else value_text end else value_text end as value_text
      from f7_values)
select seed_id, kind, value_text, case when kind = 'int' then cast(value_text as bigint) end as int_value from c
where not (large and kind in ('int', 'list')) and strlen(value_text) <= 67108864""")
def q_guard_int64(spark, sf_dir):
    v, text, big = Inputs(spark, sf_dir).v("f7_values"), F.col("value_text"), F.lit("99999999999999999999")
    inside = F.substring(text, F.lit(2), F.length(text) - 2)
    lists = (F.when(F.col("seed_id") % 3 == 0, F.concat(F.lit("("), inside, F.lit(", "), big, F.lit(")")))
             .when(F.col("seed_id") % 3 == 1, F.concat(F.lit("{1: "), text, F.lit(", 2: -"), big, F.lit("}")))
             .otherwise(F.concat(F.lit("["), text, F.lit(", ["), big, F.lit("]]"))))
    large = (F.when(F.col("kind") == "int", F.concat(text, big)).when(F.col("kind") == "list", lists)
             .when(F.col("kind") == "str", F.concat(F.lit('["'), text, F.lit(" "), big, F.lit('"]'))).otherwise(text))
    v = v.select("seed_id", "kind", F.when(F.col("seed_id") % 7 == 0, large).otherwise(text).alias("value_text"))
    return Rel.guard_int64_and_size(v).select("seed_id", "kind", "value_text", "int_value")


def contract_rules(x: Inputs):
    p = x.v("f0_problems").where(F.col("contract").isNotNull())
    return p.select(
        "task_id", F.lit(0.0).alias("min_value"), F.lit(30.0).alias("max_value"),
        F.lit(30).alias("max_len"), F.lit(r"^[a-z ]+$").alias("pattern"),
    )


@register("contract_filter", cte("f0_problems", "f7_values") + """,
r as (select task_id, 0.0 as min_value, 30.0 as max_value, 30 as max_len, '^[a-z ]+$' as pattern
      from f0_problems where contract is not null),
j as (select v.*, r.min_value, r.max_value, r.max_len, r.pattern from f7_values v left join r using (task_id))
select task_id, seed_id, kind, value_text from j
where case when min_value is null then true
           when kind in ('int', 'float') then cast(value_text as double) between min_value and max_value
           when kind = 'str' then length(value_text) <= max_len and regexp_matches(value_text, pattern)
           when kind = 'list' then list_min(cast(value_text as double[])) >= min_value
                               and list_max(cast(value_text as double[])) <= max_value
           else false end""")
def q_contract_filter(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return Rel.contract_filter(x.v("f7_values"), contract_rules(x))


_FLOAT_RE = r"-?([0-9]+\.[0-9]*([eE][-+]?[0-9]+)?|[0-9]+[eE][-+]?[0-9]+|[iI]nf(inity)?|NaN|nan)"
_FLOAT_LIST_RE = rf"^\[\s*{_FLOAT_RE}(\s*,\s*{_FLOAT_RE})*\s*\]$"


@register("is_float_value", cte("f7_values") + f""",
vals as (select seed_id, kind, value_text from f7_values
         union all select seed_id + 1000000000, 'list', '[' || value_text || ', ' || value_text || ']'
         from f7_values where kind in ('float', 'int'))
select seed_id, kind, value_text,
       kind = 'float' or (kind = 'list' and regexp_matches(value_text, '{_FLOAT_LIST_RE}')) as is_float
from vals""")
def q_is_float_value(spark, sf_dir):
    v = Inputs(spark, sf_dir).v("f7_values")
    lists = v.where(F.col("kind").isin("float", "int")).select(
        (F.col("seed_id") + 1000000000).alias("seed_id"), F.lit("list").alias("kind"),
        F.concat(F.lit("["), "value_text", F.lit(", "), "value_text", F.lit("]")).alias("value_text"))
    vals = v.select("seed_id", "kind", "value_text").unionByName(lists)
    return vals.withColumn("is_float", Rel.is_float_value("kind", "value_text"))


# ---------------------------------------------------------------- joins


@register("join_samples_problems", cte("f0_problems", "f1_samples") + """
select s.sample_id, s.task_id, p.entry_point, p.atol from f1_samples s join f0_problems p using (task_id)""")
def q_join_samples_problems(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return Rel.join_samples_problems(x.v("f1_samples").select("sample_id", "task_id"), x.v("f0_problems"),
                                     ["entry_point", "atol"])


@register("join_ground_truth", cte("f2_executions") + """,
gt as (select task_id, suite, input_idx, min(expected) as gt_expected, max(ref_time) as gt_ref_time
       from f2_executions group by all)
select e.sample_id, e.suite, e.input_idx, gt.gt_expected, gt.gt_ref_time
from f2_executions e join gt using (task_id, suite, input_idx)""")
def q_join_ground_truth(spark, sf_dir):
    e = Inputs(spark, sf_dir).v("f2_executions")
    j = Rel.join_ground_truth(e, Rel.ground_truth_from(e))
    return j.select("sample_id", "suite", "input_idx", "gt_expected", "gt_ref_time")


def plus_suite(x: Inputs):
    c = x.v("problems_catalog").where(F.col("variant") == "mini")
    return c.select("task_id", F.concat("prompt", F.lit(" # plus")).alias("prompt"), F.lit("plus").alias("source"))


_MERGED_BODY = """,
r as (select task_id, prompt || ' # plus' as prompt, 'plus' as source from problems_catalog where variant = 'mini'),
l as (select task_id, prompt, 'base' as source from f0_problems),
merged as (select * from l where task_id not in (select task_id from r) union all select * from r)
"""


def merged_suites(x: Inputs):
    left = x.v("f0_problems").select("task_id", "prompt", F.lit("base").alias("source"))
    return Rel.merge_datasets(left, plus_suite(x))


@register("merge_datasets", cte("f0_problems", "problems_catalog") + _MERGED_BODY + "select task_id, prompt, source from merged")
def q_merge_datasets(spark, sf_dir):
    return merged_suites(Inputs(spark, sf_dir))


@register("select_perf_tasks", cte("f0_problems", "problems_catalog", "f5_profiles") + _MERGED_BODY + """
select task_id, prompt, source from merged
where task_id in (select distinct 'Task/' || cast(task as varchar) from f5_profiles)""")
def q_select_perf_tasks(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    perf_ids = x.v("f5_profiles").select(F.concat(F.lit("Task/"), F.col("task").cast("string")).alias("task_id"))
    return Rel.filter_subset(merged_suites(x), perf_ids)


@register("missing_tasks", cte("f0_problems", "f1_samples") + """
select task_id from f0_problems where task_id not in (select task_id from f1_samples)""")
def q_missing_tasks(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return Rel.missing_tasks(x.v("f0_problems"), x.v("f1_samples"))


@register("attach_accuracy", cte("f4_accuracy", "f4_responses") + """
select m.model_identifier, round(a.accuracy, 6) as accuracy
from (select distinct model_identifier from f4_responses) m left join f4_accuracy a using (model_identifier)""")
def q_attach_accuracy(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    models = x.v("f4_responses").select("model_identifier").distinct()
    out = Rel.attach_accuracy(models, x.v("f4_accuracy"))
    return out.select("model_identifier", r6("accuracy").alias("accuracy"))


@register("generation_worklist", cte("f0_problems", "f1_samples") + """,
c as (select task_id, count(*) as existing from f1_samples group by task_id),
j as (select p.task_id, coalesce(c.existing, 0) as existing from f0_problems p left join c using (task_id))
select task_id, unnest(range(existing, 120)) as sample_idx from j where existing < 120""")
def q_generation_worklist(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return Rel.generation_worklist(x.v("f0_problems"), x.v("f1_samples"), 120)


@register("pad_samples", cte("f3_generations") + """,
slots as (select task_id, cast(unnest(range(0, 4)) as integer) as step from (select distinct task_id from f3_generations))
select s.task_id, s.step, coalesce(g.solution, '') as solution
from slots s left join f3_generations g on g.task_id = s.task_id and g.step = s.step
union all select task_id, cast(step as integer), coalesce(solution, '') from f3_generations where step >= 4""")
def q_pad_samples(spark, sf_dir):
    return Rel.pad_samples(Inputs(spark, sf_dir).v("f3_generations"), 4)


@register("resume_finished", cte("f5_profiles", "f5b_candidates") + """,
todo as (select distinct task, 100 as n_samples, 10 as min_correct, 20 as max_profile from f5_profiles),
fin as (select distinct task, 100 as n_samples, 10 as min_correct,
               case when task % 3 = 0 then 20 else 40 end as max_profile from f5b_candidates)
select task from todo where not exists (select 1 from fin where fin.task = todo.task and fin.n_samples = todo.n_samples
  and fin.min_correct = todo.min_correct and fin.max_profile = todo.max_profile)""")
def q_resume_finished(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    cfg = [F.lit(100).alias("n_samples"), F.lit(10).alias("min_correct")]
    todo = x.v("f5_profiles").select("task").distinct().select("task", *cfg, F.lit(20).alias("max_profile"))
    fin = x.v("f5b_candidates").select("task").distinct().select(
        "task", *cfg, F.when(F.col("task") % 3 == 0, 20).otherwise(40).alias("max_profile"))
    return Rel.resume_finished(todo, fin, ["task", "n_samples", "min_correct", "max_profile"]).select("task")


_CHAINS = cte("f3_generations") + """,
chains as (select 'chain' || cast(unnest([0, 1]) as varchar) as chain, * from f3_generations),
gen as (select chain, task_id, step, solution, 'm' || cast((step + length(task_id)) % 3 as varchar) as model,
               case when step > 0 then 'm' || cast((step - 1 + length(task_id) + case when length(solution) % 5 = 0 then 1 else 0 end) % 3 as varchar)
               end as previous_model from chains)
"""


@register("chain_previous_solution", _CHAINS + """
select a.chain, a.task_id, a.step, a.model, a.previous_model, a.solution, b.solution as previous_solution
from gen a left join gen b on a.chain = b.chain and a.task_id = b.task_id and b.step = a.step - 1 and b.model = a.previous_model""")
def q_chain_previous(spark, sf_dir):
    """Two chains of steps; some rows name a previous model that gave no solution at that step."""
    g = Inputs(spark, sf_dir).v("f3_generations").select("task_id", "step", "solution")
    at = F.col("step") + F.length("task_id")
    wrong = F.when(F.length("solution") % 5 == 0, 1).otherwise(0)
    g = g.withColumn("chain", F.explode(F.array(F.lit("chain0"), F.lit("chain1")))).withColumn(
        "model", F.concat(F.lit("m"), (at % 3).cast("string"))).withColumn(
        "previous_model", F.when(F.col("step") > 0, F.concat(F.lit("m"), ((at - 1 + wrong) % 3).cast("string"))))
    return Rel.chain_previous_solution(g, chain="chain", model="model")
