"""Registered queries: sources and sinks as write -> read round trips.

Every round trip writes under a fresh folder inside the session's shared checkpoint directory.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graderoom.catalog.perf import _SCORED, _stats_sql
from graderoom.catalog.vectors import fingerprints
from graderoom.catalog.vectors import _FP as FP_SQL
from graderoom.fixtures import Inputs, cte
from graderoom.functions.exprs import r6
from graderoom.operators import vectors as Vec
from graderoom.registry import register
from graderoom.session import scratch_path
from graderoom.sources import io


def f1_with_solution(x: Inputs):
    """F1 samples as sample files: a solution per sample, none for 'timeout' rows (invalid records)."""
    s = x.v("f1_samples")
    return s.select("task_id", "sample_id", "model",
                    F.when(F.col("base_status") != "timeout", F.concat(F.lit("def f():\n    return '"),
                                                                        F.col("sample_id"), F.lit("'\n"))).alias("solution"),
                    F.lit(None).cast("string").alias("completion"))


_F1_SOL = cte("f1_samples") + """,
s as (select task_id, sample_id, model, base_status,
             'def f():' || chr(10) || '    return ''' || sample_id || '''' || chr(10) as solution from f1_samples)
"""

SAMPLE_FILE_SCHEMA = "task_id string, completion string, solution string, sample_id string, model string"


@register("read_samples_jsonl", _F1_SOL + "select task_id, sample_id, solution from s where base_status <> 'timeout'")
def q_read_samples_jsonl(spark, sf_dir):
    path = scratch_path(spark, "samples-jsonl")
    io.write_samples_jsonl(f1_with_solution(Inputs(spark, sf_dir)), path, gzip=True)
    valid, _bad = io.read_samples_jsonl(spark, path, SAMPLE_FILE_SCHEMA)
    return valid.select("task_id", "sample_id", "solution")


@register("write_samples_jsonl", _F1_SOL + "select task_id, sample_id, model from s")
def q_write_samples_jsonl(spark, sf_dir):
    path = scratch_path(spark, "samples-out")
    df = f1_with_solution(Inputs(spark, sf_dir)).withColumn("_identifier", F.col("sample_id"))
    io.write_samples_jsonl(df, path, append=False, drop_builtin=True)
    back = spark.read.json(path)
    if "_identifier" in back.columns:
        raise AssertionError("builtin column written")
    return back.select("task_id", "sample_id", "model")


@register("sample_identity", cte("f1_samples") + "select sample_id, task_id, true as identifier_unique from f1_samples")
def q_sample_identity(spark, sf_dir):
    path = scratch_path(spark, "samples-id")
    io.write_samples_jsonl(f1_with_solution(Inputs(spark, sf_dir)), path)
    ided = io.sample_identity(spark.read.schema(SAMPLE_FILE_SCHEMA).json(path))
    counts = ided.groupBy("_identifier").agg(F.count(F.lit(1)).alias("_c"))
    return ided.join(counts, "_identifier").select("sample_id", "task_id", (F.col("_c") == 1).alias("identifier_unique"))


@register("write_samples_by_task", cte("f3_generations") + """
select task_id, cast(row_number() over (partition by task_id order by step) - 1 as bigint) as n, solution from f3_generations""")
def q_write_samples_by_task(spark, sf_dir):
    root = scratch_path(spark, "samples-dir")
    g = Inputs(spark, sf_dir).v("f3_generations").select("task_id", "solution", F.col("step").alias("_order"))
    io.write_samples_by_task(g, root, root + "-manifest")
    back = io.read_samples_dir(spark, root)
    return back.select("task_id", F.col("n").cast("bigint").alias("n"), "solution")


@register("read_samples_dir", cte("f3_generations") + "select task_id, step, solution from f3_generations")
def q_read_samples_dir(spark, sf_dir):
    root = scratch_path(spark, "samples-dir-in")
    g = Inputs(spark, sf_dir).v("f3_generations").select("task_id", "solution", F.col("step").alias("_order"))
    io.write_samples_by_task(g, root, root + "-manifest")
    back = io.read_samples_dir(spark, root)
    return back.select("task_id", F.col("n").cast("bigint").alias("step"), "solution")


@register("load_problems", cte("problems_catalog") + """
select task_id, case when variant = 'mini' then prompt || ' # v2' else prompt end as prompt, entry_point
from problems_catalog""")
def q_load_problems(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    base = scratch_path(spark, "problems")
    p = x.v("problems_catalog")
    p.write.mode("overwrite").json(base + "/a")
    # a later file repeats the mini tasks with a new prompt: the later record must win
    p.where(F.col("variant") == "mini").withColumn("prompt", F.concat("prompt", F.lit(" # v2"))) \
        .write.mode("overwrite").json(base + "/b")
    loaded = io.load_problems(spark, base + "/*")
    return loaded.select("task_id", "prompt", "entry_point")


@register("resolve_variant", cte("problems_catalog") + "select task_id, variant from problems_catalog where variant = 'mini'")
def q_resolve_variant(spark, sf_dir):
    path = scratch_path(spark, "variants")
    Inputs(spark, sf_dir).v("problems_catalog").write.mode("overwrite").partitionBy("variant").parquet(path)
    return io.resolve_variant(spark.read.parquet(path), "humaneval", mini=True).select("task_id", "variant")


_FINGERPRINT_SQL = cte("problems_catalog") + """,
r as (select md5(concat_ws(chr(31), task_id, prompt, coalesce(contract, '<null>'), canonical_solution, entry_point,
                 cast(cast(atol * 1000000000 as bigint) as varchar))) as h from problems_catalog),
s as (select cast(sum(cast('0x' || substr(h, 1, 8) as bigint)) as varchar) as s0, cast(sum(cast('0x' || substr(h, 9, 8) as bigint)) as varchar) as s1,
             cast(sum(cast('0x' || substr(h, 17, 8) as bigint)) as varchar) as s2, cast(sum(cast('0x' || substr(h, 25, 8) as bigint)) as varchar) as s3,
             count(*) as n from r)
select md5(concat_ws(':', s0, s1, s2, s3, cast(n as varchar))) as fingerprint, cast(n as bigint) as n_rows from s"""


@register("dataset_fingerprint", _FINGERPRINT_SQL)
def q_dataset_fingerprint(spark, sf_dir):
    p = Inputs(spark, sf_dir).v("problems_catalog")
    cols = ["task_id", "prompt", "contract", "canonical_solution", "entry_point",
            (F.col("atol") * 1000000000).cast("bigint")]
    return io.dataset_fingerprint(p, cols)


@register("load_split_ids", cte("problems_catalog") + """,
h as (select task_id, md5(task_id || ':42') as hh from problems_catalog),
s as (select task_id, row_number() over (order by hh, task_id) <= floor(count(*) over () * 0.8) as is_val from h)
select task_id from s where is_val""")
def q_load_split_ids(spark, sf_dir):
    path = scratch_path(spark, "split")
    split = Vec.seeded_split(Inputs(spark, sf_dir).v("problems_catalog"))
    io.export_split_ids(split.where(F.col("split") == "val"), path)
    return io.load_split_ids(spark, path)


@register("load_responses", cte("f3_generations") + "select task_id, step, solution from f3_generations")
def q_load_responses(spark, sf_dir):
    path = scratch_path(spark, "responses")
    g = Inputs(spark, sf_dir).v("f3_generations").select("task_id", "step", "solution")
    io.write_samples_jsonl(g, path)
    valid, _ = io.read_samples_jsonl(spark, path, "task_id string, step bigint, completion string, solution string")
    return valid.select("task_id", "step", "solution")


@register("load_perf_tasks", cte("f7_values") + """,
t as (select 'Task/' || cast(seed_id as varchar) as task_id, '[' || value_text || ']' as pe_input from f7_values where kind = 'list')
select task_id, cast(json_array_length(pe_input) as integer) as n_args,
       cast(list_sum(cast(json_extract(pe_input, '$[0]') as bigint[])) as bigint) as first_arg_sum from t""")
def q_load_perf_tasks(spark, sf_dir):
    path = scratch_path(spark, "perf-tasks")
    v = Inputs(spark, sf_dir).v("f7_values").where(F.col("kind") == "list")
    v.select(F.concat(F.lit("Task/"), F.col("seed_id").cast("string")).alias("task_id"),
             F.concat(F.lit("["), "value_text", F.lit("]")).alias("pe_input")).write.mode("overwrite").json(path)
    t = spark.read.schema("task_id string, pe_input string").json(path)
    parsed = t.withColumn("args", F.from_json("pe_input", "array<array<bigint>>"))
    return parsed.select("task_id", F.size("args").alias("n_args"),
                         F.aggregate(F.col("args")[0], F.lit(0).cast("bigint"), lambda a, b: a + b).alias("first_arg_sum"))


@register("load_fingerprints", FP_SQL + "select model_identifier, cast(len(emb) as integer) as dims from fp")
def q_load_fingerprints(spark, sf_dir):
    path = scratch_path(spark, "fingerprints")
    fingerprints(Inputs(spark, sf_dir)).write.mode("overwrite").partitionBy("model_identifier").parquet(path)
    fps = io.load_fingerprints(spark, path)
    return fps.select("model_identifier", F.size("embedding").alias("dims"))


@register("write_eval_report", cte("f1_samples") + "select sample_id, task_id, base_status, plus_status, 'run-1' as run_id from f1_samples")
def q_write_eval_report(spark, sf_dir):
    root = scratch_path(spark, "reports")
    rows = Inputs(spark, sf_dir).v("f1_samples").select("sample_id", "task_id", "base_status", "plus_status")
    io.write_eval_report(rows.where(F.col("base_status") == "pass"), root, "run-0")
    io.write_eval_report(rows.where(F.col("base_status") == "fail"), root, "run-1")
    io.write_eval_report(rows, root, "run-1", existing="backup")
    out = io.write_eval_report(rows.limit(0), root, "run-1", existing="reuse")
    return out.select("sample_id", "task_id", "base_status", "plus_status", "run_id")


@register("write_selection", FP_SQL + "select rank, model_identifier from reps")
def q_write_selection(spark, sf_dir):
    from graderoom.catalog.vectors import models_with_accuracy

    path = scratch_path(spark, "selection")
    reps = Vec.cluster_representatives(models_with_accuracy(Inputs(spark, sf_dir)))
    io.write_selection(reps, path)
    return io.load_selection(spark, path)


@register("load_selection", FP_SQL + "select rank, model_identifier from reps")
def q_load_selection(spark, sf_dir):
    from graderoom.catalog.vectors import models_with_accuracy

    path = scratch_path(spark, "selection-padded")
    reps = Vec.cluster_representatives(models_with_accuracy(Inputs(spark, sf_dir)))
    # padded identifiers and blank lines, as hand-edited selection files have
    padded = reps.select("rank", F.concat(F.lit("  "), "model_identifier", F.lit(" \n")).alias("model_identifier"))
    io.write_selection(padded, path)
    return io.load_selection(spark, path)


@register("run_provenance", cte("f3_generations") + """
select task_id, step, prompt, case when step % 2 = 0 and step > 0 then regexp_replace(prompt, '^\\s+|\\s+$', '', 'g') || chr(10) end as refinement,
       solution, step % 2 = 0 as direct_completion
from f3_generations""")
def q_run_provenance(spark, sf_dir):
    from graderoom.operators.text import py_strip

    g = Inputs(spark, sf_dir).v("f3_generations")
    direct = F.col("step") % 2 == 0
    prov = g.select("task_id", "step", "prompt", F.when(direct & (F.col("step") > 0), F.concat(py_strip("prompt"), F.lit("\n"))).alias("refinement"),
                    "solution", direct.alias("direct_completion"))
    root = scratch_path(spark, "provenance")
    io.write_provenance(prov.where("step = 0"), root, "run-0", step=0)
    io.write_provenance(prov.where("step = 1"), root, "run-0", step=1)  # the next step of a run that goes on
    back = io.write_provenance(prov, root, "run-1")
    return back.select("task_id", F.col("step").cast("bigint").alias("step"), "prompt", "refinement", "solution", "direct_completion")


@register("upgrade_legacy_report", cte("f1_samples") + """
select sample_id, case when model in ('m0', 'm1') then 3 else 1 end as nfiles from f1_samples""")
def q_upgrade_legacy_report(spark, sf_dir):
    s = Inputs(spark, sf_dir).v("f1_samples")
    legacy = s.select("sample_id",
                      F.when(F.col("model").isin("m0", "m1"), F.split("sample_id", "-")).alias("files"),
                      F.when(~F.col("model").isin("m0", "m1"), F.lit(1)).alias("nfiles"))
    return io.upgrade_legacy_report(legacy).select("sample_id", "nfiles")


@register("write_perf_brief", _stats_sql(0.1) + _SCORED + """,
np as (select task, count(*) filter (where profiled) as n_listed from scored group by task)
select p.task, round(p.dps, 6) as dps, round(p.dps_norm, 6) as dps_norm, p.n_profiled, n.n_listed
from per_task p join np n using (task)""")
def q_write_perf_brief(spark, sf_dir):
    """Brief perf result: per task dps and its profiled samples, written as JSON and read back."""
    from graderoom.catalog.perf import scored_samples
    from graderoom.operators import perf as P

    x = Inputs(spark, sf_dir)
    scored = scored_samples(x)
    per_task = P.dps_task(scored, 10)
    profiled = scored.where("profiled").groupBy("task").agg(
        F.sort_array(F.collect_list(F.struct("round_id", "dps"))).alias("profiled_solutions"))  # <= max_profile each
    brief = per_task.join(profiled, "task", "left")
    path = scratch_path(spark, "perf-brief")
    brief.write.mode("overwrite").json(path)
    back = spark.read.schema(brief.schema).json(path)  # JSON leaves nulls out: a column without values would be lost
    return back.select("task", r6("dps").alias("dps"), r6("dps_norm").alias("dps_norm"), "n_profiled",
                       F.coalesce(F.size("profiled_solutions"), F.lit(0)).cast("bigint").alias("n_listed"))
