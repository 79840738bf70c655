"""Typed inputs: decode classes, round trips, draws, mutation of every type and growth."""

import json

import pytest
from graderoom.functions import values as V
from graderoom.operators import inputs as I
from graderoom.operators import values as Val
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

scalar = st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False), st.text(max_size=8), st.complex_numbers(allow_nan=False))
hashable = st.one_of(st.integers(), st.text(max_size=4), st.tuples(st.integers(), st.text(max_size=2)))
value = st.recursive(scalar, lambda v: st.one_of(
    st.lists(v, max_size=4), st.lists(v, max_size=4).map(tuple), st.sets(hashable, max_size=4), st.dictionaries(hashable, v, max_size=4)), max_leaves=12)


@given(value)
@settings(max_examples=200, deadline=None)
def test_typed_text_is_a_round_trip(v):
    assert V.from_text(V.to_text(v)) == v
    assert V.kind_of(V.from_text(V.to_text(v))) == V.kind_of(v)


@given(value, st.integers(0, 1000))
@settings(max_examples=200, deadline=None)
def test_a_change_keeps_the_type_and_repeats(v, n):
    drawn = [{"kind": "int", "value_text": "7"}, {"kind": "str", "value_text": "seed"}]
    try:
        new = V.Draws(str(n), drawn).mutate(v, 5)
    except V.BAD:
        return
    assert V.kind_of(new) == V.kind_of(v)
    assert V.to_text(V.Draws(str(n), drawn).mutate(V.from_text(V.to_text(v)), 5)) == V.to_text(new)


def test_every_decode_class_by_hand():
    cases = [("tuple_items", [[1], [2, [3]]], [(1,), (2, [3])]), ("nested_tuple_items", [[[1], 5], [[2]]], [[(1,), 5], [(2,)]]),
             ("first_arg_tuple_items", [[[1], [2]], [3], 9], [[(1,), (2,)], [3]]), ("second_arg_tuple", [[1], [2]], [[1], (2,)]),
             ("set_items", [[[1, 1, 2], [], 3]], [[{1, 2}, {}, {}]]), ("float_complex", [1, "2j"], (1.0, 2j)),
             ("first_arg_tuple", [[1, [2]], [3]], [(1, [2]), [3]]), ("nested_tuple_tuple", [[[1]], [[2]]], [((1,),), ((2,),)]),
             ("mixed_tuple_tuple", [[1, [2]], 7], [(1, (2,))]), ("first_arg_tuple_three", [[1], [2], [3], 4], [(1,), [2], [3]]),
             ("dict_tuple_values", [{"a": [1, [2]]}, [3]], [{"a": (1, [2])}, [3]]), ("complex", ["(1-2j)"], [1 - 2j]),
             ("all_tuples", [[1, [2]], {"a": [3]}], ((1, (2,)), {"a": [3]})), ("plain", [[1]], [[1]])]
    assert {c[0] for c in cases} == set(V.DECODE) and set(I.REFERENCE_DECODE_RULES) <= set(V.DECODE)
    for rule, given_args, want in cases:
        got = V.decode(given_args, rule)
        assert got == want and V.to_text(got) == V.to_text(want), rule
        assert V.decode(json.loads(V.encode(got, rule)), rule) == got, rule


def test_what_does_not_fit_is_reported(spark):
    rows = [("Mbpp/75", 1, "[[[1]]]"), ("Mbpp/115", 2, "[[[[1]]]]"), ("Mbpp/124", 3, '["x", "1j"]'), ("Mbpp/9", 4, "{}"), ("Mbpp/9", 5, "[1,"),
            ("Mbpp/9", 6, None), ("Mbpp/9", 7, ""), ("Mbpp/9", 8, "[]"), ("Mbpp/9", 9, "[" * 100000), (None, 10, "[1]"), ("Mbpp/722", 11, "[[1]]")]
    df = spark.createDataFrame(rows, "task_id string, seed_id long, value_text string").withColumn("extra", F.lit(1))
    got = {r.seed_id: r for r in Val.decode_values(df, I.reference_rule_table(spark)).collect()}
    assert len(got) == len(rows) and got[8].extra == 1
    assert {k for k, r in got.items() if r.typed is not None} == {8, 10}
    assert {k for k, r in got.items() if r.problem is None} == {6, 8, 10}
    empty = Val.encode_values(Val.decode_values(df.limit(0), I.reference_rule_table(spark)))
    assert empty.count() == 0 and Val.harvest_values(empty).count() == 0


def _decoded(spark, n=60):
    rows = [(f"t{k % 3}", k, V.to_text([[k, (k, "a b")], {"x": {k, k + 1}}, k / 2, complex(0, k), None, k % 2 == 0])) for k in range(n)]
    return spark.createDataFrame(rows, "task_id string, seed_id long, typed string")


def test_mutation_does_not_depend_on_partitions(spark):
    base = _decoded(spark)
    ing = I.index_ingredients(Val.harvest_values(base))
    cands = base.select("task_id", F.col("seed_id").alias("cand_id"), F.lit(1).alias("round"), "typed")
    one = {r.cand_id: r.typed for r in Val.mutate_typed(cands.repartition(1), ing).collect()}
    many = {r.cand_id: r.typed for r in Val.mutate_typed(cands.repartition(7, "typed"), ing).collect()}
    assert one == many and len(one) > 50
    old = {r.seed_id: r.typed for r in base.collect()}
    assert sum(one[k] != old[k] for k in one) > 0.9 * len(one)
    assert all(isinstance(V.from_text(t), list) for t in one.values())


@pytest.mark.parametrize("kind", ["int", "float", "complex", "str", "bool", "none", "list", "tuple", "set", "dict"])
def test_generated_values_have_their_kind(kind):
    made = [V.Draws(f"{kind}{n}", None).fresh(kind) for n in range(200)]
    assert {V.kind_of(v) for v in made} == {kind}
    if kind in ("list", "tuple"):
        assert {len(v) for v in made} == set(range(11))
    if kind == "int":
        assert min(made) >= -100 and max(made) <= 100 and len(set(made)) > 80


def test_harvest_takes_the_scalars_at_any_depth(spark):
    got = {(r.kind, r.value_text) for r in Val.harvest_values(_decoded(spark, 1)).collect()}
    assert got == {("int", "0"), ("int", "1"), ("str", "a b"), ("str", "a"), ("str", "b"), ("str", "x"), ("float", "0.0"), ("complex", "0j")}


def test_typed_growth_keeps_the_contract(spark):
    rows = [("free", 1, V.to_text([[1, "x"], (2, 3)])), ("none", 2, V.to_text([None])), ("shut", 3, V.to_text([5])), ("bad", 4, None)]
    pool = spark.createDataFrame(rows, "task_id string, seed_id long, typed string")
    first = F.try_variant_get(F.try_parse_json("typed"), "$[0]", "int")
    grown = Val.grow_typed(pool, lambda d: d.where((F.col("task_id") != "shut") | (first == 5)), num=8).collect()
    texts = [r.typed for r in grown if r.task_id == "free"]
    assert len(texts) == len(set(texts)) == 8 and rows[0][2] not in texts
    assert all(V.from_text(r.typed)[0] == 5 for r in grown if r.task_id == "shut")
    assert "bad" not in {r.task_id for r in grown}
