"""Closure by doubling, cleaning of whole sample sets, stored profiles, chains, line ends, literals."""

import pytest
from pyspark.sql import functions as F

from data_paths import SF_SMALL
from graderoom.catalog import vectors as catalog_vectors
from graderoom.fixtures import Inputs
from graderoom.operators import code as C
from graderoom.operators import perf as P
from graderoom.operators import relational as Rel
from graderoom.operators import text as T
from graderoom.operators import vectors as Vec
from graderoom.plans import evaluation as E


def test_chain_of_10000_closes_in_few_rounds(spark):
    edges = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = C.dependency_closure(edges, spark.createDataFrame([(0,), (9_990,)], "root long"), max_rounds=16)
    assert {r.root: r["count"] for r in got.groupBy("root").count().collect()} == {0: 10_001, 9_990: 11}


def test_closure_of_random_graphs_equals_search(spark):
    rows = [(g, (7 * i * (g + 1) + i // 3) % 23, (5 * i + g * i * i) % 23) for g in range(4) for i in range(14 + 6 * g)]
    edges = spark.createDataFrame([*rows, (0, None, 1), (0, 1, None)], "g int, src int, dst int")
    roots = spark.createDataFrame([(g, r) for g in range(3) for r in range(0, 23, 1 + g)], "g int, root int")
    want = set()
    for g, root in [(r.g, r.root) for r in roots.collect()]:
        seen, todo = {root}, [root]
        while todo:
            at = todo.pop()
            for h, s, d in rows:
                if h == g and s == at and d not in seen:
                    seen.add(d)
                    todo.append(d)
        want |= {(g, root, n) for n in seen}
    got = [tuple(r) for r in C.dependency_closure(edges, roots, key=["g"]).select("g", "root", "node").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_clean_samples(spark):
    code = "import os\ndef h():\n    return 1\ndef idle():\n    return 2\ndef f():\n    return h()"
    clean = "import os\ndef h():\n    return 1\ndef f():\n    return h()"
    samples = spark.createDataFrame(
        [(1, "A/1", f"Sure:\n{code}\nDone!", None), (2, "A/1", None, "    return 5"), (3, "A/1", clean, None), (4, "B/9", code, None),
         (5, "A/2", clean, None), (6, "A/1", None, None)], "n int, task_id string, solution string, completion string")
    problems = spark.createDataFrame([("A/1", "f", "def f():"), ("A/2", "f", "")], "task_id string, entry_point string, prompt string")
    got = C.clean_samples(samples, problems)
    assert got.columns == [*samples.columns, "changed"]
    rows = {r.n: (r.solution, r.changed) for r in got.collect()}
    assert rows == {1: (clean, True), 2: ("def f():\n    return 5", False), 3: (clean, False), 5: (clean, False), 6: (None, False)}
    assert [r.n for r in C.clean_samples(samples, problems, only_task="A/2").collect()] == [5]
    assert tuple(C.clean_stats(got).first()) == (1, 5)
    assert C.clean_samples(samples.limit(0), problems).count() == 0


def test_first_definition_counts_and_no_entry_gives_the_block(spark):
    code = "def f():\n    return g()\ndef f():\n    return 0\ndef g():\n    return f()"
    df = spark.createDataFrame([(1, code, "f"), (2, code, None), (3, code, "zz"), (4, "", "f")], "n int, text string, entry_point string")
    got = {r.n: r.clean for r in C.clean_code(df).collect()}
    assert got == {1: "def f():\n    return g()\ndef g():\n    return f()", 2: code, 3: code, 4: ""}


def test_profiles_are_stored_by_text_and_options(spark):
    s = spark.createDataFrame([("t", 1, "a", True, 9.0), ("t", 2, "a", True, 9.0), ("t", 3, "b", True, 9.0), ("u", 4, "a", True, 9.0),
                               ("t", 5, "c", False, 9.0), ("t", 6, None, True, 9.0)],
                              "task string, round_id int, solution string, profiled boolean, cost double")
    now, then = {"rounds": 3}, {"rounds": 1}
    keyed = P.profile_key(s, now)
    none = keyed.select("profile_key", F.lit(1).alias("run"), "cost").limit(0)
    wanted = P.profiles_wanted(keyed, none)
    assert {(r.task, r.solution, r.n_samples) for r in wanted.collect()} == {("t", "a", 2), ("t", "b", 1), ("u", "a", 1)}
    stored = wanted.select("profile_key", F.explode(F.array(F.lit(2), F.lit(1))).alias("run")).withColumn("cost", F.col("run") * 10.0)
    assert P.profiles_wanted(keyed, stored).isEmpty()
    assert P.profiles_wanted(P.profile_key(s, then), stored).count() == 3
    costs = {r.round_id: r.cost for r in P.with_stored_costs(keyed, stored).collect()}
    assert costs == {1: 10.0, 2: 10.0, 3: 10.0, 4: 10.0, 5: None, 6: None}


def test_finished_tasks_are_kept_under_an_equal_configuration_only(spark):
    ladder = spark.createDataFrame([(t, 0, 5.0, 100.0, 1) for t in "abc"], "task string, ref_idx int, ref_cost double, score double, n_ref int")
    s = spark.createDataFrame([(t, i, True, 1.0) for t in "abc" for i in range(3)], "task string, round_id int, passed boolean, cost double")
    old = spark.createDataFrame([("a", 1.0, 2.0, 3, 4.0), ("b", 1.0, 2.0, 3, 4.0), ("z", 1.0, 2.0, 3, 4.0)],
                                "task string, dps double, dps_norm double, n_profiled long, pass_at_1 double")
    finished = E.finished_tasks(old.where("task <> 'b'"), 3, 1, 2, {"x": 1}).unionByName(E.finished_tasks(old.where("task = 'b'"), 3, 1, 2, {"x": 2}))
    per_task, summary = E.efficiency_run(s, ladder, 3, 1, 2, options={"x": 1}, finished=finished)
    assert {r.task: r.dps for r in per_task.collect()} == {"a": 1.0, "b": 100.0, "c": 100.0}
    assert summary.first().n_evaluated == 3


def test_chains_are_kept_apart(spark):
    gen = spark.createDataFrame([("x", "t", 0, "A", None, "xa"), ("y", "t", 0, "B", None, "yb"), ("x", "t", 1, "B", "A", "xb"),
                                 ("y", "t", 1, "A", "A", "ya")],
                                "chain string, task_id string, step int, model string, previous_model string, solution string")
    got = {(r.chain, r.step): r.previous_solution for r in Rel.chain_previous_solution(gen, chain="chain", model="model").collect()}
    assert got == {("x", 0): None, ("y", 0): None, ("x", 1): "xa", ("y", 1): None}


def test_pass_at_1_of_steps(spark):
    rows = [("e", 0, "m", "t", "pass", "pass"), ("e", 0, "m", "t", "fail", "pass"), ("e", 0, "m", "u", "pass", None)]
    reports = spark.createDataFrame(rows, "ensemble string, step int, model_identifier string, task_id string, base_status string, plus_status string")
    r = E.step_pass_at_1(reports).first()
    assert (r.base_pass_at_1, r.plus_pass_at_1, r.n_tasks) == (75.0, 25.0, 2)


def test_line_ends_are_those_of_python(spark):
    texts = ["", "\n", "a", "a\n", "a\n\n", "a\r\nb\rc", "\r\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h ", "\n\r", "a\x1fb\tc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.py_lines("t").alias("lines"))
    assert [r.lines for r in df.collect()] == [t.splitlines() for t in texts]


@pytest.mark.parametrize("line, kept", [("(1, 'a')", True), ("{1: [None]}", True), ("{2}, -3", True), ("f(1)", False), ("[1", False), ("1j", True)])
def test_python_literals(spark, line, kept):
    df = spark.createDataFrame([(f"x\n```\n{line} # note\n```",)], "text string")
    assert [r.literal for r in C.fenced_literals(df).collect()] == ([f"[{line}]"] if kept else [])


def test_clusters_and_projection_of_separated_groups(spark):
    rows = [(f"m{i}", [10.0 * (i % 3 == 0) + 0.01 * i, 10.0 * (i % 3 == 1), 0.02 * (i % 2)]) for i in range(12)]
    fps = spark.createDataFrame(rows, "model_identifier string, embedding array<double>")
    cluster = {r.model_identifier: r.cluster for r in Vec.kmeans_models(fps, k=3).collect()}
    groups = {frozenset(m for m in cluster if cluster[m] == c) for c in set(cluster.values())}
    assert groups == {frozenset(f"m{i}" for i in range(12) if i % 3 == g) for g in range(3)}
    got = [(r.pc1, r.pc2) for r in Vec.pca_project(fps).collect()]
    import numpy as np

    x = np.array([v for _, v in rows])
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
    assert np.allclose(np.cov(np.array(got).T), np.diag(values), atol=1e-9)


def test_every_model_of_the_fingerprints_is_clustered_and_projected(spark):
    fps = catalog_vectors.fingerprints(Inputs(spark, SF_SMALL))
    names = {r.model_identifier for r in fps.collect()}
    assert {r.model_identifier for r in Vec.kmeans_models(fps).collect()} == names
    assert {r.model_identifier for r in Vec.pca_project(fps).collect()} == names
