"""Edge cases of comparisons, guards, contracts, closures, reports and evaluation runs."""

import datetime as dt
import math

import pytest
from graderoom.operators import code as C
from graderoom.operators import inputs as I
from graderoom.operators import perf as P
from graderoom.operators import relational as Rel
from graderoom.operators import text as T
from graderoom.operators import verdict as V
from graderoom.plans.evaluation import evaluate_run
from graderoom.session import scratch_path
from graderoom.sources import io
from graderoom.streaming.jobs import write_in_order
from pyspark.sql import functions as F

INF, NAN = math.inf, math.nan


def test_nan_and_infinity(spark):
    rows = [(NAN, NAN, False), (1.0, INF, False), (INF, 1.0, False), (INF, INF, True), (-INF, INF, False),
            (NAN, 1.0, False), (1.0, 1.0 + 1e-9, True), (1.0, 1.1, False)]
    df = spark.createDataFrame(rows, "a double, e double, want boolean")
    got = df.withColumn("got", V.tolerant_equal(F.col("a"), F.col("e"), F.lit(1e-6))).collect()
    assert all(r.got == r.want for r in got)


def test_digit_distance_of_a_negative_number_is_null(spark):
    df = spark.createDataFrame([(-5, 12), (15, 2)], "a long, b long")
    assert [r.d for r in df.select(V.digit_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [None, 4]


def test_guard_checks_integers_only(spark):
    big = "9" * 25
    values = ["1", "-7", big, "abc", "[1, 2]", f"[1, {big}]", f"['{big}']", "1.5", f"[{big}.5]", "", None]
    df = spark.createDataFrame([(v,) for v in values], "value_text string")
    got = {r.value_text: r.int_value for r in Rel.guard_int64_and_size(df).collect()}
    assert got == {"1": 1, "-7": -7, "abc": None, "[1, 2]": None, f"['{big}']": None, "1.5": None,
                   f"[{big}.5]": None, "": None}


def test_each_bound_of_a_contract_counts(spark):
    rules = spark.createDataFrame([("hi", None, 5.0, None, None), ("len", None, None, 2, None), ("none", None, None, None, None)],
                                  "task_id string, min_value double, max_value double, max_len int, pattern string")
    rows = [("hi", "int", "99"), ("hi", "int", "5"), ("hi", "int", "x"), ("hi", "list", "[1, 9]"), ("hi", "list", "[1]"),
            ("len", "str", "abc"), ("len", "str", "ab"), ("none", "str", "any"), ("free", "int", "99")]
    df = spark.createDataFrame(rows, "task_id string, kind string, value_text string")
    got = {tuple(r) for r in Rel.contract_filter(df, rules).select("task_id", "value_text").collect()}
    assert got == {("hi", "5"), ("hi", "[1]"), ("len", "ab"), ("none", "any"), ("free", "99")}


def test_an_unfinished_closure_raises(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(6)], "src long, dst long")
    roots = spark.createDataFrame([(0,)], "root long")
    assert C.dependency_closure(edges, roots).count() == 7
    assert C.dependency_closure(edges, roots, max_rounds=7).count() == 7
    with pytest.raises(RuntimeError):
        C.dependency_closure(edges, roots, max_rounds=3)


def test_null_texts_do_not_stop_the_cleaners(spark):
    df = spark.createDataFrame([(None, "f"), ("def f():\n    return 1", "f")], "text string, entry_point string")
    assert {r.text is None: r.syntax_ok for r in C.syntax_ok(df).collect()} == {True: False, False: True}
    assert {r.text is None: r.clean for r in C.clean_code(df).collect()} == {True: None, False: "def f():\n    return 1"}


def test_a_run_is_written_once(spark):
    root = scratch_path(spark, "report-test")
    rows = spark.range(3)
    assert io.write_eval_report(rows, root, "a").count() == 3
    with pytest.raises(FileExistsError):
        io.write_eval_report(rows, root, "a")
    assert io.write_eval_report(rows, root, "b").count() == 3


def test_samples_that_never_ran_fail(spark):
    ex = spark.createDataFrame(
        [(s, suite, "t", "m", 0, 1.0, 1.0, False, 0.0, 0.1, 0.1) for s, suite in (("a", "base"), ("a", "plus"), ("b", "base"), ("d", "base"), ("d", "plus"))]
        + [("e", "base", "u", "m", 0, 1.0, 1.0, False, 0.0, 0.1, 0.1)],
        "sample_id string, suite string, task_id string, model string, input_idx int, actual double, expected double, "
        "expected_is_float boolean, atol double, ref_time double, run_time double")
    samples = spark.createDataFrame(
        [("a", "t", "m", False), ("b", "t", "m", None), ("c", "t", "m", False), ("d", "t", "m", True), ("e", "u", "m", False), ("x", "?", "m", False)],
        "sample_id string, task_id string, model string, load_error boolean")
    tasks = spark.createDataFrame([("t",), ("u",)], "task_id string")
    report, _ = evaluate_run(ex, tasks, tasks, V.Limits(), ks=(1,), samples=samples)
    got = {r.sample_id: (r.base_status, r.plus_status) for r in report.collect()}
    assert got == {"a": ("pass", "pass"), "b": ("pass", "fail"), "c": ("fail", "fail"), "d": ("fail", "fail"), "e": ("pass", "pass")}


def test_blanks_are_those_of_python(spark):
    blanks = [chr(n) for n in range(0x3001) if chr(n).isspace()]
    texts = [f"{b}{b}a{b}b a{b}" for b in blanks] + ["", "\u200ba b", "a b-a", "\u3000", "\x1fx\x1f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", T.py_strip("t").alias("stripped"), T.lspace(F.col("t")).alias("lead"),
                     T.unique_word_ratio("t").alias("ratio")).collect()
    for r in rows:
        assert r.stripped == r.t.strip() and r.lead == len(r.t) - len(r.t.lstrip()), ascii(r.t)
        words = r.t.translate(str.maketrans(dict.fromkeys(T.STYLE_CHARS, " "))).split()
        assert r.ratio == (len(set(words)) / len(words) if words else 1.0), ascii(r.t)


def test_ladders_out_of_order(spark):
    refs = spark.createDataFrame([("t", 0, 5.0), ("t", 1, 5.0), ("t", 2, 7.0), ("t", 3, 1.0), ("u", 0, 9.0)],
                                 "task string, ref_idx int, ref_cost double")
    assert [r.ref_idx for r in P.ladder_order_check(refs).collect()] == [1]
    assert sorted(r.ref_idx for r in P.ladder_order_check(refs, strict=True).collect()) == [0, 1]


def test_rows_without_a_time_are_kept(spark):
    start = dt.datetime(2024, 1, 1)
    timed = [(k, start + dt.timedelta(hours=k)) for k in range(20)]
    for rows in (timed + [(99, None)], [(1, None), (2, None)]):
        folder = scratch_path(spark, "times")
        write_in_order(spark.createDataFrame(rows, "k long, ts timestamp_ntz"), folder, 4, "ts")
        assert sorted(r.k for r in spark.read.parquet(folder).collect()) == sorted(k for k, _ in rows)


def test_growth_ends_with_full_or_dry_tasks(spark):
    pool = spark.createDataFrame(
        [("free", 1, "int", "5"), ("free", 2, "str", "some words here"), ("tight", 3, "int", "3"), ("tight", 4, "int", "4"),
         ("closed", 5, "int", "7"), ("huge", 6, "int", "9" * 30)], "task_id string, seed_id long, kind string, value_text string")
    rules = spark.createDataFrame([("tight", 0.0, 8.0, None, None), ("closed", 7.0, 7.0, None, None)],
                                  "task_id string, min_value double, max_value double, max_len int, pattern string")
    new = I.grow_inputs(pool, rules, num=6).collect()
    by = {t: [r.value_text for r in new if r.task_id == t] for t in ("free", "tight", "closed", "huge")}
    assert len(by["free"]) == 6 and len(by["huge"]) == 6 and by["closed"] == []
    assert 0 < len(by["tight"]) <= 6 and all(0 <= int(v) <= 8 for v in by["tight"])
    old = {(r.task_id, r.value_text) for r in pool.collect()}
    seen = [(r.task_id, r.value_text) for r in new]
    assert len(set(seen)) == len(seen) and not set(seen) & old
    assert max(r.round for r in new) > 1


def test_special_values_are_floats_and_large_integers_are_found_anywhere(spark):
    texts = ["[1e5]", "[inf, -1.0]", "[nan]", "[1, 2.0]", "[1.5]"]
    df = spark.createDataFrame([("list", t) for t in texts], "kind string, text string")
    assert [r[0] for r in df.select(Rel.is_float_value("kind", "text")).collect()] == [True, True, True, False, True]
    big = "9" * 20
    rows = spark.createDataFrame([(f"({big}, 1)",), (f"{{1: {big}}}",), (f"{{'{big}': 1}}",), ("(1, 2)",)], "value_text string")
    assert [r.value_text for r in Rel.guard_int64_and_size(rows).collect()] == [f"{{'{big}': 1}}", "(1, 2)"]


def test_padding_keeps_rows_beyond_n(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 5, "y")], "task_id string, step long, solution string")
    assert sorted(tuple(r) for r in Rel.pad_samples(df, 2).collect()) == [("a", 0, "x"), ("a", 1, ""), ("a", 5, "y")]
