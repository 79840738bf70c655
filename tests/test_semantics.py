"""Hand-computed expectations for the semantics that are easy to get wrong."""

import glob
import gzip
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from graderoom.functions.code import ANSI_ESCAPE, longest_block, syntax_check
from graderoom.operators import code as C
from graderoom.operators import metrics as M
from graderoom.operators import perf as P
from graderoom.operators import ranking as R
from graderoom.operators import relational as Rel
from graderoom.operators import text as T
from graderoom.operators import vectors as Vec
from graderoom.operators import verdict as V
from graderoom.session import scratch_path
from graderoom.sources import io


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---------------------------------------------------------------- pass@k


def test_pass_at_k_values(spark):
    counts = spark.createDataFrame([("m", "t", 5, 2, 1)], "model string, task_id string, n long, c_base long, c_plus long")
    got = {(r.suite, r.k): r.pass_at_k for r in M.pass_at_k_task(counts, [1, 2, 5]).collect()}
    assert got[("base", 1)] == pytest.approx(0.4)
    assert got[("base", 2)] == pytest.approx(1 - 3 / 10)  # 1 - C(3,2)/C(5,2)
    assert got[("base", 5)] == 1.0  # n - c < k
    assert got[("plus", 1)] == pytest.approx(0.2)


def test_pass_at_k_requires_min_n_over_all_tasks(spark):
    counts = spark.createDataFrame([("m", "a", 5, 1, 0), ("m", "b", 3, 3, 3)],
                                   "model string, task_id string, n long, c_base long, c_plus long")
    ks = {r.k for r in M.pass_at_k(counts, [1, 3, 5]).collect()}
    assert ks == {1, 3}


def test_plus_needs_base_pass(spark):
    s = spark.createDataFrame([("fail", "pass"), ("pass", "pass"), ("pass", "fail")], "base_status string, plus_status string")
    assert [r.plus_correct for r in M.plus_pass(s).collect()] == [False, True, False]


# ---------------------------------------------------------------- verdicts

EX_SCHEMA = ("sample_id string, suite string, task_id string, input_idx long, expected double, actual double, "
             "expected_is_float boolean, atol double, ref_time double, run_time double")


def _ex(spark, rows):
    return spark.createDataFrame(rows, EX_SCHEMA)


LIM = V.Limits(min_limit=1.0, factor=1.0, budget_cap=2.0, extra_seconds=0.0)


def test_fast_mode_stops_at_first_failure_and_reports_last_executed(spark):
    ex = _ex(spark, [("A", "base", "t", 0, 1.0, 1.0, False, 0.0, 0.1, 0.1),
                     ("A", "base", "t", 1, 2.0, 3.0, False, 0.0, 0.1, 0.1),
                     ("A", "base", "t", 2, 3.0, 3.0, False, 0.0, 0.1, 0.1)])
    d = V.verdict_details(ex, LIM, fast=True)
    v = V.derive_verdict(d).first()
    assert (v.status, v.n_details) == ("fail", 2)
    assert V.failed_tests(d, fast=True).first().failed_inputs == "1"
    full = V.verdict_details(ex, LIM, fast=False)
    assert V.failed_tests(full, fast=False).first().failed_inputs == "1"


def test_per_input_overrun_is_a_failed_detail_not_a_timeout(spark):
    ex = _ex(spark, [("B", "base", "t", 0, 1.0, 1.0, False, 0.0, 0.1, 1.5)])  # limit max(1, 0.1) = 1
    v = V.derive_verdict(V.verdict_details(ex, LIM)).first()
    assert (v.status, v.n_details) == ("fail", 1)


def test_budget_overrun_is_timeout_and_fast_report_names_last_executed_even_if_it_passed(spark):
    ex = _ex(spark, [("C", "base", "t", i, 1.0, 1.0, False, 0.0, 0.1, 0.9) for i in range(3)])  # 0.9, 1.8, 2.7 > 2
    d = V.verdict_details(ex, LIM)
    v = V.derive_verdict(d).first()
    assert (v.status, v.n_details) == ("timeout", 2)
    assert V.failed_tests(d, fast=True).first().failed_inputs == "1"


def test_sticky_float_tolerance(spark):
    ex = _ex(spark, [("S", "base", "t", 0, 1.5, 1.5, True, 0.0, 0.1, 0.1),
                     ("S", "base", "t", 1, 2.0, 2.0000005, False, 0.0, 0.1, 0.1)])
    assert V.derive_verdict(V.verdict_details(ex, LIM)).first().status == "pass"
    alone = _ex(spark, [("S", "base", "t", 0, 2.0, 2.0000005, False, 0.0, 0.1, 0.1)])
    assert V.derive_verdict(V.verdict_details(alone, LIM)).first().status == "fail"


def test_error_output_fails(spark):
    ex = _ex(spark, [("E", "base", "t", 0, 1.0, None, False, 0.0, 0.1, 0.1)])
    assert V.derive_verdict(V.verdict_details(ex, LIM)).first().status == "fail"


def test_special_oracle_columns(spark):
    df = spark.createDataFrame([(5.0, 3.0, 123, 256)], "b double, h double, x long, y long")
    r = df.select(V.surface_area(F.col("b"), F.col("h")).alias("s"),
                  V.digit_distance(F.col("x"), F.col("y")).alias("d"),
                  V.polynomial(F.array(F.lit(-2.0), F.lit(0.0), F.lit(1.0)), F.lit(2.0 ** 0.5)).alias("p")).first()
    assert r.s == 64.0  # 25 + 2 * 5 * sqrt(2.5^2 + 3^2) = 64.05
    assert r.d == 1 + 3 + 3  # 123 vs 256
    assert abs(r.p) < 1e-9


# ---------------------------------------------------------------- perf


def test_segment_threshold_uses_larger_neighbour(spark):
    stats = spark.createDataFrame([(1, 0, 100000.0), (1, 1, 95000.0), (1, 2, 50000.0)],
                                  "task long, solution_idx long, mean_cost double")
    seg = P.segment_costs(stats, base=0.1)
    assert _rows(seg, "solution_idx", "segment") == [(0, 0), (1, 0), (2, 1)]
    lad = P.reference_ladder(seg)
    assert _rows(lad, "ref_idx", "solution_idx", "score") == [(0, 0, pytest.approx(200 / 3)), (1, 2, 100.0)]


def test_ladder_match_largest_index(spark):
    ladder = spark.createDataFrame([(1, 0, 100.0, 50.0), (1, 1, 50.0, 100.0)], "task long, ref_idx long, ref_cost double, score double")
    samples = spark.createDataFrame([(1, 1, 40.0), (1, 2, 70.0), (1, 3, 120.0), (1, 4, None)], "task long, round_id long, cost double")
    got = _rows(P.match_reference_ladder(samples, ladder), "round_id", "matching_idx", "dps", "dps_norm")
    assert got == [(1, 1, 100.0, 100.0), (2, 0, 50.0, 50.0), (3, -1, 0.0, 0.0), (4, -1, 0.0, 0.0)]


def test_dps_only_for_tasks_with_enough_passes(spark):
    scored = spark.createDataFrame([(1, True, True, 50.0, 50.0), (1, True, True, 100.0, 100.0), (2, True, True, 10.0, 10.0),
                                    (2, False, False, 0.0, 0.0)],
                                   "task long, passed boolean, profiled boolean, dps double, dps_norm double")
    t = {r.task: r for r in P.dps_task(scored, min_correct=2).collect()}
    assert t[1].dps == 75.0 and t[1].n_profiled == 2
    assert t[2].dps is None and t[2].pass_at_1 == 50.0


def test_cap_profiled_counts_only_passes(spark):
    s = spark.createDataFrame([(1, i, i % 2 == 0) for i in range(6)], "task long, round_id long, passed boolean")
    got = _rows(P.cap_profiled(s, 2), "round_id", "profiled")
    assert got == [(0, True), (1, False), (2, True), (3, False), (4, False), (5, False)]


# ---------------------------------------------------------------- code text


F6_LIKE = ("\x1b[31mHere is code\x1b[0m\n```python\nimport math\ndef helper(x):\n    return x * 2\n"
           "def unused(x):\n    return 0\ndef f_7(x):\n    return helper(x) + 3\n```\nHope this helps\nprint(1)")


def test_clean_code_keeps_imports_and_reachable_definitions(spark):
    df = spark.createDataFrame([(1, "f_7", F6_LIKE)], "text_id long, entry_point string, text string")
    got = C.clean_code(df, "text", "entry_point").first().clean
    assert got == "import math\ndef helper(x):\n    return x * 2\ndef f_7(x):\n    return helper(x) + 3"


def test_dependency_closure_is_cycle_safe(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("d",)], "root string")
    got = _rows(C.dependency_closure(edges, roots), "root", "node")
    assert got == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "a"), ("d", "b"), ("d", "c"), ("d", "d")]


def test_longest_block_on_written_texts():
    cases = {
        "Sure, here it is:\nx = 1\ny = 2\nHope that helps!": "x = 1\ny = 2",
        "import os\ndef f(x):\n    return x\nThis is the code": "import os\ndef f(x):\n    return x",
        "def g(\nx = 1\nprint(x)": "x = 1\nprint(x)",
        "\x1b[31mx = 1\x1b[0m\ny = 2": "x = 1\ny = 2",
    }
    for text, block in cases.items():
        assert longest_block(text) == block, text


def test_text_helpers(spark):
    df = spark.createDataFrame([("",), ("a a a b",), ("x" * 12000,), ("ab\tc\ndef zz",)], "t string")
    r = df.select(T.unique_word_ratio("t").alias("u"), T.truncate_at_stop("t", ["\ndef "]).alias("c")).collect()
    assert [x.u for x in r[:2]] == [1.0, 0.5]
    assert len(r[2].c) == 10000
    assert r[3].c == "ab    c"


def test_decode_identifier_is_lossy_on_double_dash(spark):
    df = spark.createDataFrame([("org--a--b_hf_temp_0.2",), ("no-suffix",)], "model_identifier string")
    got = Rel.decode_identifier(df).collect()
    assert [(r.model, r.backend, r.temperature) for r in got] == [("org/a/b", "hf", "0.2")]


# ---------------------------------------------------------------- splits, ordering, files


def test_seeded_split_sizes_and_disjointness(spark):
    ids = spark.createDataFrame([(f"T/{i}",) for i in range(10)], "task_id string")
    s = Vec.seeded_split(ids, seed=42, ratio=0.8)
    got = {r.task_id: r.split for r in s.collect()}
    assert len(got) == 10 and sum(v == "val" for v in got.values()) == 8
    assert sum(r.split == "val" for r in Vec.seeded_split(ids, val_size=3).collect()) == 3
    with pytest.raises(Exception):
        Vec.seeded_split(ids, val_size=10).collect()


def test_ordered_operators_do_not_depend_on_partition_count(spark):
    df = spark.createDataFrame([(f"t{i % 3}", f"s{i:03d}") for i in range(200)], "task_id string, sample_id string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = _rows(R.completion_index(df, "task_id", "sample_id"), "sample_id", "completion_id")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        eight = _rows(R.completion_index(df, "task_id", "sample_id"), "sample_id", "completion_id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == eight
    assert dict(one)["s003"] == 1  # t0: s000, s003, ...


def test_sample_identity_line_numbers_match_files(spark):
    path = scratch_path(spark, "test-identity")
    df = spark.createDataFrame([(f"T/{i % 5}", f"s{i}", "x") for i in range(300)], "task_id string, sample_id string, solution string")
    io.write_samples_jsonl(df.repartition(3), path, gzip=True)
    ided = io.sample_identity(spark.read.schema("task_id string, sample_id string, solution string").json(path))
    got = {r.sample_id: (r._path.rsplit("/", 1)[-1], r._line) for r in ided.collect()}
    for f in glob.glob(path + "/*.json.gz"):
        with gzip.open(f, "rt") as fh:
            for i, line in enumerate(x for x in fh if x.strip()):
                assert got[json.loads(line)["sample_id"]] == (f.rsplit("/", 1)[-1], i + 1)


def test_load_problems_last_record_wins(spark):
    base = scratch_path(spark, "test-problems")
    spark.createDataFrame([Row(task_id="T/1", prompt="old")]).write.json(base + "/a")
    spark.createDataFrame([Row(task_id="T/1", prompt="new")]).write.json(base + "/b")
    got = io.load_problems(spark, base + "/*", "task_id string, prompt string").collect()
    assert [(r.task_id, r.prompt) for r in got] == [("T/1", "new")]


def test_segments_of_a_task_split_across_partitions(spark):
    import math

    rnd = random.Random(5)
    means = [round(rnd.choice([1e5, 3e5, 1e6, 4e6]) * rnd.uniform(0.9, 1.1), 3) for _ in range(60)]
    stats = spark.createDataFrame([(7, i, m) for i, m in enumerate(means)], "task long, solution_idx long, mean_cost double")
    got = _rows(P.segment_costs(stats, base=0.2, n_parts=7), "solution_idx", "segment", "rank_in_task")
    order = sorted(range(len(means)), key=lambda i: (-means[i], i))
    expect, seg, prev = [], 0, None
    for rank, i in enumerate(order, start=1):
        if prev is not None and (prev - means[i]) / prev > 0.2 + math.sqrt(10000 / prev):
            seg += 1
        expect.append((i, seg, rank))
        prev = means[i]
    assert got == sorted(expect)


def test_split_export_numeric_order_and_scalar_wrap(spark):
    path = scratch_path(spark, "test-split")
    ids = spark.createDataFrame([("T/10",), ("T/2",), ("T/1",)], "task_id string")
    io.export_split_ids(ids, path)
    text = "".join(r.value for r in spark.read.text(path).collect())
    assert json.loads(text) == ["T/1", "T/2", "T/10"]
    single = scratch_path(spark, "test-split-scalar")
    spark.createDataFrame([('"T/5"',)], "value string").coalesce(1).write.text(single)
    assert [r.task_id for r in io.load_split_ids(spark, single).collect()] == ["T/5"]


def test_pass_at_k_json_export(spark):
    path = scratch_path(spark, "test-export")
    pk = spark.createDataFrame([("m", "base", 1, 0.5), ("m", "base", 5, 0.9)], "model string, suite string, k int, pass_at_k double")
    io.export_pass_at_k_json(pk, path)
    row = spark.read.json(path).first()
    assert json.loads(row.pass_at_k) == {"base": {"pass@1": 0.5, "pass@5": 0.9}}


def test_syntax_ok_and_definition_table(spark):
    src = ("import os\nX = 1\n@dec\ndef decorated():\n    return 1\ndef no_ret():\n    pass\n"
           "def f(a):\n    return g(a) + X\ndef g(b):\n    return b\ndef f(a):\n    return 2\n")
    df = spark.createDataFrame([(1, src), (2, "def broken(:\n")], "id long, code string")
    ok = {r.id: r.syntax_ok for r in C.syntax_ok(df, "code").collect()}
    assert ok == {1: True, 2: False}
    defs = C.definition_table(df, "code")
    got = sorted((r.seq, r.kind, r.name) for r in defs.collect())
    assert got == [(0, "import", None), (1, "variable", "X"), (3, "function_noreturn", "no_ret"),
                   (4, "function", "f"), (5, "function", "g"), (6, "function", "f")]
    firsts = sorted((r.seq, r.name) for r in C.first_definitions(defs).collect())
    assert firsts == [(1, "X"), (4, "f"), (5, "g")]  # first f wins, no_ret never counts


def test_typed_decode_classes(spark):
    from graderoom.operators import inputs as I

    rules = I.reference_rule_table(spark)
    assert rules.count() == sum(len(v) for v in I.REFERENCE_DECODE_RULES.values())
    vals = spark.createDataFrame([("Mbpp/115", 1, "list", "[3,1,3]"), ("Mbpp/2", 2, "list", "[3,1]"),
                                  ("Mbpp/252", 3, "str", "1+2j"), ("Mbpp/252", 4, "str", "(0.5-1j)"),
                                  ("Mbpp/252", 5, "str", "-3j"), ("Mbpp/9", 6, "list", "[2,2]")],
                                 "task_id string, seed_id long, kind string, value_text string")
    got = {r.seed_id: r for r in I.decode_inputs(vals, rules).collect()}
    assert got[1].list_value == [1, 3] and got[1].rule == "set_items"
    assert got[2].is_tuple and got[2].list_value == [3, 1]
    assert (got[3].complex_value.re, got[3].complex_value.im) == (1.0, 2.0)
    assert (got[4].complex_value.re, got[4].complex_value.im) == (0.5, -1.0)
    assert (got[5].complex_value.re, got[5].complex_value.im) == (0.0, -3.0)
    assert got[6].rule == "plain" and not got[6].is_tuple
