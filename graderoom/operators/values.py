"""Typed test inputs of any depth: decode, encode, ingredients, generation and mutation.

An input is the list of a call's arguments as JSON text. Decoded, it is typed text (see
``graderoom.functions.values``): JSON with tags for tuples, sets, dicts and complex numbers, which
``try_parse_json`` turns into VARIANT for contracts and reports in SQL. A row's own text is handled by a
small Arrow-batched helper; rules, ingredients and draws come by joins, and the draws of a row depend on
the seed and its key alone, so partitions and retries do not change them.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graderoom.functions import values as V
from graderoom.operators.inputs import MAX_MULTI_STEP, grow, index_ingredients, uniform

DECODED = T.StructType().add("typed", "string").add("problem", "string")
SCALAR_LIST = T.ArrayType(T.StructType().add("kind", "string").add("value_text", "string"))
DRAWN = 5  # ingredients of each kind that are drawn for a row


def _guarded(work, *parts):
    """(result, None), or (None, what was wrong)."""
    if any(p is None for p in parts):
        return None, None
    try:
        return work(*parts), None
    except V.BAD as e:
        return None, f"{type(e).__name__}: {e}"[:200]


@F.pandas_udf(DECODED)
def _decode(text: pd.Series, rule: pd.Series) -> pd.DataFrame:
    found = [_guarded(lambda t, r: V.to_text(V.decode(V.json.loads(t), r)), t, r) for t, r in zip(text, rule)]
    return pd.DataFrame(found, columns=["typed", "problem"], dtype="object")


@F.pandas_udf(T.StringType())
def _encode(typed: pd.Series, rule: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else V.encode(V.from_text(t), r) for t, r in zip(typed, rule)], dtype="object")


@F.pandas_udf(SCALAR_LIST)
def _ingredients(typed: pd.Series) -> pd.Series:
    def of(t):
        return [] if t is None else [{"kind": k, "value_text": x} for k, x in sorted(set(V.ingredients(V.from_text(t))))]

    return typed.map(of)


@F.pandas_udf(T.StringType())
def _mutate(typed: pd.Series, key: pd.Series, drawn: pd.Series) -> pd.Series:
    def one(t, k, d):
        return V.to_text(V.Draws(k, d).mutate(V.from_text(t), MAX_MULTI_STEP))

    # a change that a value does not allow (an infinite part, an unhashable item of a set) leaves the row out
    return pd.Series([_guarded(lambda a, b: one(a, b, d), t, k)[0] for t, k, d in zip(typed, key, drawn)], dtype="object")


@F.pandas_udf(T.StringType())
def _generate(kind: pd.Series, key: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series([V.to_text(V.Draws(k, d).fresh(t)) for t, k, d in zip(kind, key, drawn)], dtype="object")


def decode_values(values: DataFrame, rules: DataFrame, text: str = "value_text") -> DataFrame:
    """Adds ``rule`` (that of the task, else plain), ``typed`` and ``problem``.

    ``rules`` has one row per task. Arguments beyond those a rule names go, as its call takes no more. Values that
    a rule does not speak of stay as they are. Text that is not JSON, and arguments that the rule does not fit, give a
    null ``typed`` and a ``problem``; null text gives nulls."""
    ruled = values.join(rules.select("task_id", "rule"), "task_id", "left").withColumn("rule", F.coalesce("rule", F.lit("plain")))
    return ruled.withColumn("_d", _decode(F.col(text), F.col("rule"))).select(*ruled.columns, "_d.typed", "_d.problem")


def encode_values(decoded: DataFrame) -> DataFrame:
    """Adds ``encoded``: JSON text that ``decode_values`` turns into the same typed value. Null stays null."""
    return decoded.withColumn("encoded", _encode(F.col("typed"), F.col("rule")))


def harvest_values(decoded: DataFrame) -> DataFrame:
    """Distinct (task_id, kind, value_text) of the scalars at any depth: numbers, complex numbers, strings and their
    words, keys of dicts; truth values as the integers they equal. Sets are passed over."""
    return decoded.select("task_id", F.explode(_ingredients(F.col("typed"))).alias("_i")).select("task_id", "_i.*").distinct()


def with_draws(rows: DataFrame, ing: tuple[DataFrame, DataFrame], key: list[str], seed: int,
               wanted: Column | None = None) -> DataFrame:
    """Adds ``_drawn``: up to ``DRAWN`` ingredients of each kind of the row's task, drawn by the row's key.
    ``wanted``, a condition on the key and the ingredients' ``kind``, leaves out kinds that a row cannot use.

    The look-up joins on (task, kind, index), so that the rows of a hot task are spread over its ingredients."""
    idx, counts = ing
    pick = lambda n: F.floor(uniform(seed, *key, F.col("kind"), n) * F.col("n_ing")).cast("long")
    kinds = rows.select(*key).join(counts, "task_id")
    asked = (kinds if wanted is None else kinds.where(wanted)).select(
        *key, "kind", F.posexplode(F.array(*[pick(n) for n in range(DRAWN)])).alias("_at", "ing_idx"))
    found = asked.join(idx, ["task_id", "kind", "ing_idx"]).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("kind", "_at", F.col("ingredient").alias("value_text")))).alias("_d"))
    slim = F.transform("_d", lambda d: F.struct(d["kind"].alias("kind"), d["value_text"].alias("value_text")))
    return rows.join(found.select(*key, slim.alias("_drawn")), key, "left")


def _key_text(key: list[str], seed: int) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])


def generate_typed(slots: DataFrame, ing: tuple[DataFrame, DataFrame], seed: int = 42) -> DataFrame:
    """A random value for each (task_id, kind, gen_id): int, float, complex, str, bool, none, list, tuple, set or dict.

    Numbers lie within 100 of 0, strings have up to 10 letters and containers up to 10 items, a fifth of the lists of
    mixed kinds; half of the scalars are ingredients of the task."""
    key = ["task_id", "kind", "gen_id"]
    # a scalar takes ingredients of its own kind, a container those of any; fresh complex numbers take none
    wanted = (F.col("kind") != "complex") & (F.col("_kind").isin("list", "tuple", "set", "dict") | (F.col("_kind") == F.col("kind")))
    d = with_draws(slots.withColumnRenamed("kind", "_kind"), ing, ["task_id", "_kind", "gen_id"], seed, wanted).withColumnRenamed("_kind", "kind")
    return d.withColumn("typed", _generate(F.col("kind"), _key_text(key, seed), F.col("_drawn"))).drop("_drawn")


def mutate_typed(cands: DataFrame, ing: tuple[DataFrame, DataFrame], seed: int = 42) -> DataFrame:
    """Replaces ``typed`` of (task_id, cand_id, round, typed) by 1 to 5 changes of it, each within the type of the
    part it changes: items and entries are removed, added, repeated or changed at any depth, scalars
    are moved or become an ingredient. (task_id, cand_id, round) tells rows apart. Rows without a
    value, or whose change is not possible, go."""
    key = ["task_id", "cand_id", "round"]
    d = with_draws(cands, ing, key, seed)
    new = _mutate(F.col("typed"), _key_text(key, seed), F.col("_drawn"))
    return d.withColumn("typed", new).drop("_drawn").where(F.col("typed").isNotNull())


def grow_typed(pool: DataFrame, accept: Callable[[DataFrame], DataFrame] | None = None, per_seed: int = 4, num: int = 10,
               seed: int = 42, patience: int = 2) -> DataFrame:
    """New typed inputs (task_id, typed, seed_id, round) until every task of ``pool`` (task_id, seed_id, typed) has
    ``num`` of them or is dry, see ``inputs.grow``. ``accept`` is the contract: it gets rows with ``typed`` and
    returns those that keep it. Rows without a value are no seeds."""
    def offspring(cands: DataFrame, own: DataFrame) -> DataFrame:
        ing = index_ingredients(harvest_values(own.withColumnRenamed("value_text", "typed")))
        new = mutate_typed(cands.withColumnRenamed("value_text", "typed"), ing, seed)
        return (accept(new) if accept else new).withColumnRenamed("typed", "value_text")

    seeds = pool.where("typed is not null").select("task_id", F.lit("typed").alias("kind"), F.col("typed").alias("value_text"), "seed_id")
    grown = grow(seeds, offspring, per_seed, num, seed, patience)
    return grown.select("task_id", F.col("value_text").alias("typed"), "seed_id", "round")
