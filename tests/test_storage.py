"""Commits of reports and provenance, fingerprints of tables, exact percentiles of hot groups."""

import random

import duckdb
import pytest
from graderoom.operators.quantiles import exact_percentile
from graderoom.session import scratch_path
from graderoom.sources import io
from pyspark.sql import functions as F


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_reports_are_refused_reused_or_backed_up(spark):
    root = scratch_path(spark, "reports")
    make = lambda n: spark.range(n).repartition(3)
    assert _ids(io.write_eval_report(make(3), root, "a")) == [0, 1, 2]
    with pytest.raises(FileExistsError):
        io.write_eval_report(make(5), root, "a")
    assert _ids(io.write_eval_report(make(5), root, "a", existing="reuse")) == [0, 1, 2]
    assert len(_ids(io.write_eval_report(make(5), root, "a", existing="backup"))) == 5
    assert len(_ids(io.write_eval_report(make(7), root, "a", existing="backup"))) == 7
    backups = io.read_report_backups(spark, root, "a").groupBy("version").count().collect()
    assert {r.version: r["count"] for r in backups} == {1: 3, 2: 5}
    assert len(_ids(io.write_eval_report(make(2), root, "b", existing="backup"))) == 2
    assert spark.read.parquet(root).groupBy("run_id").count().count() == 2
    with pytest.raises(ValueError):
        io.write_eval_report(make(2), root, "c", existing="overwrite")


def test_a_write_that_fails_leaves_no_run(spark):
    root = scratch_path(spark, "reports")
    broken = spark.range(10).repartition(5).withColumn("x", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        io.write_eval_report(broken, root, "a")
    assert _ids(io.write_eval_report(spark.range(2), root, "a")) == [0, 1]
    with pytest.raises(FileExistsError):  # the second of two writers that both saw no run
        io._rename(spark, f"{root}/_staged", f"{root}/run_id=a")
    assert _ids(spark.read.parquet(root)) == [0, 1]


def test_steps_of_a_run_are_added_one_by_one(spark):
    root = scratch_path(spark, "steps")
    io.write_provenance(spark.range(2), root, "r", step=0)
    back = io.write_provenance(spark.range(2, 5), root, "r", step=1)
    assert sorted((r.step, r.id) for r in back.collect()) == [(0, 0), (0, 1), (1, 2), (1, 3), (1, 4)]
    with pytest.raises(FileExistsError):
        io.write_provenance(spark.range(1), root, "r", step=1)
    with pytest.raises(FileExistsError):
        io.write_provenance(spark.range(1).withColumn("step", F.lit(2)), root, "r")


def test_files_by_task_have_no_partial_names(spark):
    root, manifest = scratch_path(spark, "files"), scratch_path(spark, "manifest")
    df = spark.createDataFrame([("T/1", 1, "a"), ("T/1", 2, "b"), ("T/2", 3, None)], "task_id string, _order long, solution string")
    for _ in range(2):  # a repeated write gives the same files
        assert io.write_samples_by_task(df, root, manifest).count() == 3
        got = {(r.task_id, r.n): r.solution for r in io.read_samples_dir(spark, root).collect()}
        assert got == {("T/1", 0): "a", ("T/1", 1): "b"}  # an empty file has no row


def test_fingerprint_is_of_the_rows_alone(spark):
    of = lambda rows: io.dataset_fingerprint(spark.createDataFrame(rows, "a string, b long"), ["a", "b"]).first()
    rows = [("x", 1), ("y", None), (None, 2), ("x", 1)]
    base = of(rows)
    assert base.n_rows == 4 and of(rows[::-1]) == base
    others = [rows[:3], rows + rows[:1], [("x", 2), ("y", None), (None, 2), ("x", 1)], []]
    assert len({base.fingerprint, *(of(r).fingerprint for r in others)}) == 5


@pytest.mark.parametrize("p", [0.0, 0.5, 0.99, 1.0])
def test_exact_percentile_equals_the_engine_of_reference(spark, p):
    rng = random.Random(5)
    rows = [("hot", rng.choice([rng.random(), 1.0, 5.0])) for _ in range(4000)] + [("two", 1.0), ("two", 4.0), ("one", -3.0), ("none", None)]
    rows += [(None, float(k)) for k in range(10)] + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: r.q for r in exact_percentile(df, ["k"], "v", p, "q").collect()}
    con = duckdb.connect()
    con.execute("create table t (k varchar, v double)")
    con.executemany("insert into t values (?, ?)", rows)
    want = dict(con.execute(f"select k, quantile_cont(v, {p}) from t group by k").fetchall())
    assert set(got) == set(want)
    assert all(got[k] == want[k] if want[k] is None else got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_percentile_of_an_empty_table(spark):
    assert exact_percentile(spark.createDataFrame([], "k string, v double"), ["k"], "v", 0.5, "q").collect() == []


def test_bad_lines_are_quarantined_with_their_text(spark):
    path = scratch_path(spark, "lines")
    lines = ['{"task_id": "T/1", "solution": "x"}', "", '{"task_id": "T/2", "solution": "cut', '{"task_id": "T/3"}', "[1, 2", '{"completion": ""}']
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    valid, bad = io.read_samples_jsonl(spark, path)
    assert sorted((r.task_id or "", r.solution or "") for r in valid.collect()) == [("", ""), ("T/1", "x")]
    assert sorted(r._bad_line or "" for r in bad.collect()) == sorted([lines[2], lines[4], ""])
    assert valid.count() == 2 and bad.count() == 3
