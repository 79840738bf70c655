"""Tasks with few samples, stalls as sessions, literals, files of micro-batches, draws."""

import datetime as dt
import math
from collections import Counter

import duckdb
import pytest
from graderoom.catalog.streaming import N_BATCHES, batch_files
from graderoom.functions import values as V
from graderoom.operators import code as C
from graderoom.operators import perf as P
from graderoom.operators import values as Val
from graderoom.operators.inputs import index_ingredients
from graderoom.registry import ORACLES, QUERIES, load_all
from graderoom.session import scratch_path
from graderoom.streaming import jobs as S
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

load_all()

SHORT = ["cap_profiled", "dps_summary", "dps_task", "efficiency_reuse", "efficiency_run", "first_n_samples",
         "match_reference_ladder", "profiles_wanted", "write_perf_brief"]


@pytest.fixture(scope="module")
def few(spark):
    """Events of 24 users, 60 each but 15 of user 8, who has a curated ladder, and 3 of user 11."""
    folder = scratch_path(spark, "few")
    e = spark.range(60 * 24).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("ts"),
        (F.col("id") % 24).alias("user_id"), F.when(F.col("id") % 11 == 0, "error").otherwise("view").alias("event_type"),
        (F.col("id") % 97).cast("double").alias("value"), F.lit("{}").alias("props"))
    e = e.withColumn("event_id", F.floor(F.col("event_id") / 24) + F.col("user_id") * 1000)
    e.where("not (user_id = 8 and event_id % 1000 >= 15) and not (user_id = 11 and event_id % 1000 >= 3)").write.parquet(
        f"{folder}/events.parquet")
    return folder


def _bag(rows):
    norm = lambda v: ("nan" if math.isnan(v) else round(v, 5)) if isinstance(v, float) else v
    return Counter(tuple(map(norm, r)) for r in rows)


@pytest.mark.parametrize("name", SHORT)
def test_tasks_with_few_samples_are_scored_on_those_they_have(spark, few, name):
    got = QUERIES[name](spark, few)
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{few.removeprefix("file:")}/events.parquet/*.parquet')")
    want = con.execute(ORACLES[name])
    order = [d[0] for d in want.description]
    rows = _bag(want.fetchall())
    assert rows and _bag(tuple(r) for r in got.select(*order).collect()) == rows


@pytest.mark.parametrize("n_passing", [0, 3])
def test_brief_has_its_columns_where_no_task_is_scored(spark, n_passing):
    folder = scratch_path(spark, "unscored")
    spark.range(90).select(
        F.col("id").alias("event_id"), (F.col("id") % 2).alias("user_id"), (1.0 + F.col("id") % 7).alias("value"),
        F.when(F.col("id") < n_passing, "view").otherwise("error").alias("event_type")).write.parquet(f"{folder}/events.parquet")
    got = QUERIES["write_perf_brief"](spark, folder).select("task", "dps", "dps_norm", "n_profiled", "n_listed").collect()
    assert sorted(map(tuple, got)) == [(0, None, None, None, (n_passing + 1) // 2), (1, None, None, None, n_passing // 2)]


def test_strict_still_fails_on_few_samples(spark):
    s = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 1, True)], "task string, round_id int, passed boolean")
    assert sorted(tuple(r) for r in P.first_n_samples(s, 2, strict=False).collect()) == [("a", 1, True), ("a", 2, True), ("b", 1, True)]
    for work in (lambda: P.first_n_samples(s, 2).collect(), lambda: P.first_n_and_cap(s, 2, 1).collect()):
        with pytest.raises(PySparkException):
            work()


def test_silences_of_just_the_gap_end_a_run(spark):
    base = dt.datetime(2024, 1, 1)
    micros = {1: [0, 599_999_999, 1_199_999_999], 2: [0, 600_000_000], 3: [600_000_001, 1, 1]}
    rows = [(k, base + dt.timedelta(microseconds=m)) for k, times in micros.items() for m in times]
    events = spark.createDataFrame(rows, "k long, ts timestamp_ntz")
    folder = scratch_path(spark, "t-gap")
    S.write_in_order(S.close_input(events, "ts", "3 hours"), folder, 2, "ts")
    runs = S.stalls(S.file_stream(spark, folder, events.schema), "k", "ts")
    got = sorted((r.k, r.session_start[11:], r.session_end[11:], r.n_events) for r in S.run_append(runs, "t-gap").collect())
    assert got == [(1, "00:00:00.000000", "00:19:59.999999", 2), (1, "00:19:59.999999", "00:29:59.999999", 1),
                   (2, "00:00:00.000000", "00:10:00.000000", 1), (2, "00:10:00.000000", "00:20:00.000000", 1),
                   (3, "00:00:00.000001", "00:10:00.000001", 2), (3, "00:10:00.000001", "00:20:00.000001", 1)]


def test_stalls_and_literals_use_no_python_per_group_and_all_cores(spark):
    events = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "k long, ts timestamp_ntz")
    folder = scratch_path(spark, "t-plan")
    events.write.parquet(folder)
    stream = S.stalls(S.file_stream(spark, folder, events.schema), "k", "ts")
    assert "Pandas" not in stream._jdf.queryExecution().analyzed().toString()
    one = spark.createDataFrame([("```\n1\nx\n```",)], "text string").coalesce(1)
    plan = C.fenced_literals(one)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Repartition")  # lines are cut after the texts are dealt out


def test_every_micro_batch_reads_on_all_cores(spark):
    s = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_idx"), F.lit("a b").alias("chunk"))
    folder = scratch_path(spark, "t-files")
    S.write_in_order(s, folder, N_BATCHES * batch_files(spark), F.xxhash64("doc_id"))
    n = spark.read.parquet(folder).select(F.input_file_name().alias("f")).distinct().count()
    assert batch_files(spark) >= spark.sparkContext.defaultParallelism and n > (N_BATCHES - 1) * batch_files(spark)


def test_slots_draw_only_ingredients_they_can_use(spark):
    found = [("t", "int", "7"), ("t", "float", "1.5"), ("t", "str", "w"), ("t", "complex", "(1+2j)"), ("u", "str", "z")]
    ing = index_ingredients(spark.createDataFrame(found, "task_id string, kind string, value_text string"))
    kinds = ["int", "float", "complex", "str", "bool", "none", "list", "tuple", "set", "dict"]
    slots = spark.createDataFrame([(t, k, i) for t in "tu" for k in kinds for i in range(12)], "task_id string, kind string, gen_id long")
    renamed = slots.withColumnRenamed("kind", "_kind")
    drawn = {(r.task_id, r._kind, r.gen_id): r._drawn for r in Val.with_draws(renamed, ing, ["task_id", "_kind", "gen_id"], 42).collect()}
    got = Val.generate_typed(slots, ing, 42).collect()
    assert len(got) == len(slots.collect())
    for r in got:  # as with the ingredients of every kind
        every = drawn[r.task_id, r.kind, r.gen_id]
        assert r.typed == V.to_text(V.Draws(f"42:{r.task_id}:{r.kind}:{r.gen_id}", every).fresh(r.kind))
