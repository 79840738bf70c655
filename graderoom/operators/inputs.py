"""Test-input growth as DataFrame jobs: typed decode/encode, ingredient harvest, reproducible
type-directed generation and mutation, novelty filtering, seed sampling and multi-round growth.

Values are rows (task_id, kind, value_text) with typed side columns; randomness is a pure function
of (seed, row key, round, step, salt) through xxhash64, so results do not depend on partitioning and
re-executed tasks produce the same values. Ingredient draws are equi-joins on a per-(task, kind)
index, never a collected list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graderoom.operators.ranking import index_within

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_MULTI_STEP = 5


def uniform(*parts: Column | str | int) -> Column:
    """Deterministic U[0, 1) from the hash of the given parts."""
    cols = [F.lit(p) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p) for p in parts]
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 31)).cast("double") / float(1 << 31)


def randint(lo: int | Column, hi: int | Column, *parts) -> Column:
    lo_c = F.lit(lo) if isinstance(lo, int) else lo
    hi_c = F.lit(hi) if isinstance(hi, int) else hi
    return (lo_c + F.floor(uniform(*parts) * (hi_c - lo_c + 1))).cast("bigint")


# ---------------------------------------------------------------- typed decode / encode

# MBPP task numbers whose inputs need a typed decode, by decode class.
REFERENCE_DECODE_RULES = {
    "tuple_items": [2, 116, 132, 143, 222, 261, 273, 394, 399, 421, 424, 429, 470, 560, 579, 596, 616, 630,
                    726, 740, 744, 809],
    "nested_tuple_items": [63, 64, 70, 94, 120, 237, 272, 299, 400, 409, 417, 438, 473, 614, 780],
    "first_arg_tuple_items": [75, 413, 444, 753],
    "second_arg_tuple": [106, 750],
    "set_items": [115],
    "float_complex": [124],
    "first_arg_tuple": [250, 405, 446, 617, 720, 763, 808],
    "nested_tuple_tuple": [259, 401, 445],
    "mixed_tuple_tuple": [278],
    "first_arg_tuple_three": [307],
    "dict_tuple_values": [722],
    "complex": [252],
    "all_tuples": [580, 615, 791],
}


def reference_rule_table(spark, prefix: str = "Mbpp/") -> DataFrame:
    """(task_id, rule) for the fixed decode table above, a bounded literal."""
    rows = [(f"{prefix}{n}", rule) for rule, ids in REFERENCE_DECODE_RULES.items() for n in ids]
    return F.broadcast(spark.createDataFrame(rows, "task_id string, rule string"))


COMPLEX_TEXT = r"^\(?\s*([-+]?[0-9.eE]+)?\s*([-+]\s*[0-9.eE]*)j\s*\)?$"


def parse_complex(text: Column) -> Column:
    """Python complex literal text ('1+2j', '-3j', '(0.5-1j)', '4') -> struct<re double, im double>."""
    re_part = F.regexp_extract(text, COMPLEX_TEXT, 1)
    im_part = F.regexp_replace(F.regexp_extract(text, COMPLEX_TEXT, 2), r"\s", "")
    im = F.when(im_part.isin("+", "-", ""), F.concat(im_part, F.lit("1"))).otherwise(im_part)
    has_j = text.rlike(COMPLEX_TEXT)
    return F.when(has_j, F.struct(F.coalesce(F.nullif(re_part, F.lit("")), F.lit("0")).cast("double").alias("re"),
                                  im.cast("double").alias("im"))) \
        .otherwise(F.struct(text.try_cast("double").alias("re"), F.lit(0.0).alias("im")))


def decode_inputs(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Typed decode by the task's rule class. Lists stay arrays (a tuple is an array tagged
    ``is_tuple``); set classes become sorted distinct arrays (set equality); complex classes parse the
    text into struct<re, im>; anything else decodes plainly. ``rules`` has one row per task."""
    j = values.join(rules, "task_id", "left").withColumn("rule", F.coalesce("rule", F.lit("plain")))
    rule = F.col("rule")
    is_set = rule.isin("set", "set_items")
    arr = F.from_json("value_text", "array<bigint>")
    arr = F.when(is_set, F.array_sort(F.array_distinct(arr))).otherwise(arr)
    is_complex = rule.isin("complex", "float_complex")
    return j.select(
        "task_id", "seed_id", "rule", "kind",
        F.when(F.col("kind").isin("int", "float"), F.col("value_text").cast("double")).alias("num_value"),
        F.when(F.col("kind") == "list", arr).alias("list_value"),
        F.when(F.col("kind") == "str", F.col("value_text")).alias("text_value"),
        ((F.col("kind") == "list") & (rule.contains("tuple"))).alias("is_tuple"),
        F.when(is_complex, parse_complex(F.col("value_text"))).alias("complex_value"),
    )


def encode_inputs(decoded: DataFrame) -> DataFrame:
    """Back to JSON text: lists (sets already sorted distinct) via to_json, numbers and strings as text."""
    txt = (F.when(F.col("kind") == "list", F.to_json("list_value"))
           .when(F.col("kind") == "int", F.col("num_value").cast("bigint").cast("string"))
           .when(F.col("kind") == "float", F.col("num_value").cast("string"))
           .otherwise(F.to_json(F.array("text_value"))))
    return decoded.select("task_id", "seed_id", "rule", "kind", txt.alias("encoded"))


# ---------------------------------------------------------------- ingredients


def harvest_ingredients(values: DataFrame) -> DataFrame:
    """Distinct (task_id, kind, value_text) ingredients: ints, floats, strings and their whitespace
    tokens, recursing into list elements."""
    scalars = values.where(F.col("kind").isin("int", "float", "str")).select("task_id", "kind", "value_text")
    tokens = values.where(F.col("kind") == "str").select(
        "task_id", F.lit("str").alias("kind"), F.explode(F.split(F.trim("value_text"), r"\s+")).alias("value_text"))
    elems = values.where(F.col("kind") == "list").select(
        "task_id", F.lit("int").alias("kind"),
        F.explode(F.transform(F.from_json("value_text", "array<bigint>"), lambda e: e.cast("string"))).alias("value_text"))
    return scalars.unionByName(tokens).unionByName(elems).where(F.col("value_text") != "").distinct()


def index_ingredients(ingredients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(indexed ingredients, counts per (task, kind)) for join-based random choice."""
    keyed = ingredients.withColumn("_tk", F.concat_ws("\x1f", "task_id", "kind"))
    idx = index_within(keyed, "_tk", "value_text", "ing_idx").select("task_id", "kind", "ing_idx",
                                                                      F.col("value_text").alias("ingredient"))
    counts = idx.groupBy("task_id", "kind").agg(F.count(F.lit(1)).alias("n_ing"))  # of the numbered rows: found once
    return idx, counts


def _with_ingredient(df: DataFrame, ing: tuple[DataFrame, DataFrame], kind_col: str, pick: Column) -> DataFrame:
    """Attach one ingredient of the row's (task, kind) chosen by ``pick`` in [0, 1)."""
    idx, counts = ing
    d = df.join(counts.withColumnRenamed("kind", kind_col), ["task_id", kind_col], "left")
    d = d.withColumn("ing_idx", F.when(F.col("n_ing") > 0, F.floor(pick * F.col("n_ing")).cast("long")))
    return d.join(idx.withColumnRenamed("kind", kind_col), ["task_id", kind_col, "ing_idx"], "left").drop("n_ing", "ing_idx")


# ---------------------------------------------------------------- generation


def random_letters(length: Column, *parts) -> Column:
    chars = F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))),
                        lambda i: F.substring(F.lit(LETTERS), (F.floor(uniform(*parts, i) * 52) + 1).cast("int"), 1))
    return F.when(length <= 0, F.lit("")).otherwise(F.array_join(chars, ""))


def generate_values(slots: DataFrame, ing: tuple[DataFrame, DataFrame], seed: int = 42) -> DataFrame:
    """Type-directed random values for slots (task_id, kind, gen_id): ints in [-100, 100], floats in
    [-100, 100), strings of 0..10 letters, int lists of 0..10 elements; with probability 0.5 a scalar
    comes from the task's ingredients instead."""
    k = ["task_id", "kind", "gen_id"]
    d = _with_ingredient(slots, ing, "kind", uniform(seed, *k, 1))
    use_ing = (uniform(seed, *k, 2) < 0.5) & F.col("ingredient").isNotNull()
    n_list = randint(0, 10, seed, *k, 3)
    lst = F.transform(F.sequence(F.lit(1), F.greatest(n_list, F.lit(1))), lambda i: randint(-100, 100, seed, *k, 4, i))
    lst = F.when(n_list == 0, F.array().cast("array<bigint>")).otherwise(lst)
    fresh = (F.when(F.col("kind") == "int", randint(-100, 100, seed, *k, 5).cast("string"))
             .when(F.col("kind") == "float", (uniform(seed, *k, 6) * 200 - 100).cast("string"))
             .when(F.col("kind") == "str", random_letters(randint(0, 10, seed, *k, 7), seed, *k, 8))
             .otherwise(F.to_json(lst)))
    val = F.when(use_ing & (F.col("kind") != "list"), F.col("ingredient")).otherwise(fresh)
    return d.select("task_id", "kind", "gen_id", val.alias("value_text"))


# ---------------------------------------------------------------- mutation


def head(v: Column, k: Column) -> Column:
    """v[:k] (Python slice)."""
    return F.call_function("substr", v, F.lit(1), k.cast("int"))


def rest(v: Column, k: Column) -> Column:
    """v[k:] (Python slice)."""
    return F.call_function("substr", v, k.cast("int") + 1)


def _with_draws(d: DataFrame, ing: tuple[DataFrame, DataFrame], seed: int, steps: int) -> DataFrame:
    """Adds ``_drawn``: the ingredient of the row's (task, kind) for each step, in one look-up for all steps."""
    idx, counts = ing
    row = ["task_id", "cand_id", "round"]
    pick = lambda step: F.floor(uniform(seed, "task_id", "cand_id", F.col("round"), step, 1) * F.col("n_ing")).cast("long")
    asked = d.select(*row, "kind").join(counts, ["task_id", "kind"]).where("n_ing > 0").select(
        *row, "kind", F.posexplode(F.array(*[pick(s) for s in range(1, steps + 1)])).alias("_at", "ing_idx"))
    found = asked.join(idx, ["task_id", "kind", "ing_idx"]).groupBy(*row).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("_at") + 1, "ingredient"))).alias("_drawn"))  # one entry a step
    return d.join(found, row, "left")


def _mutated(v: Column, step: Column, seed: int) -> Column:
    """The value text after one step."""
    key = ["task_id", "cand_id"]
    u = lambda salt: uniform(seed, *key, F.col("round"), step, salt)
    ri = lambda lo, hi, salt: randint(lo, hi, seed, *key, F.col("round"), step, salt)
    ingredient = F.try_element_at("_drawn", step)
    has_ing = ingredient.isNotNull()
    # int: ingredient (p=0.5) or +/-1
    m_int = F.when((u(2) < 0.5) & has_ing, ingredient).otherwise(
        F.coalesce((v.try_cast("decimal(37,0)") + ri(-1, 1, 3)).cast("string"), v))
    # float: ingredient (p=0.5), or add U(-1, 1), or scale by 1 + U(-0.5, 0.5)
    fv = v.cast("double")
    m_float = (F.when((u(2) < 0.5) & has_ing, ingredient)
               .when(u(4) < 0.5, (fv + (u(5) * 2 - 1)).cast("string"))
               .otherwise((fv * (1 + (u(6) - 0.5))).cast("string")))
    # str: ingredient (p=0.4); else insert an ingredient, cut a substring, repeat a char, or fresh letters
    n = F.length(v)
    choice = F.when(n > 0, ri(0, 2, 7)).otherwise(F.lit(0))
    at = ri(0, n, 8)
    start = ri(0, F.greatest(n - 1, F.lit(0)), 9)
    end = start + 1 + F.floor(u(10) * (n - start)).cast("bigint")
    rep = ri(0, F.greatest(n - 1, F.lit(0)), 11)
    m_str = (F.when((u(2) < 0.4) & has_ing, ingredient)
             .when((choice == 0) & has_ing, F.concat(head(v, at), ingredient, rest(v, at)))
             .when(choice == 1, F.concat(head(v, start), rest(v, end)))
             .when(choice == 2, F.concat(head(v, rep), F.call_function("substr", v, ri(0, F.greatest(n - 1, F.lit(0)), 12).cast("int") + 1, F.lit(1)),
                                         rest(v, rep)))
             .otherwise(random_letters(ri(0, 10, 13), seed, *key, F.col("round"), step, 14)))
    # int list: remove / insert a mutated element / append a copy / change in place
    arr = F.from_json(v, "array<bigint>")
    size = F.size(arr)
    pos = ri(1, F.greatest(size, F.lit(1)), 15)
    elem = F.element_at(arr, pos.cast("int"))
    lchoice = ri(0, 3, 16)
    insert_at = ri(1, F.greatest(size, F.lit(1)), 17)
    m_list = F.to_json(
        F.when(size == 0, F.transform(F.sequence(F.lit(1), F.greatest(ri(0, 10, 18), F.lit(1))), lambda i: ri(-100, 100, 19) + i))
        .when(lchoice == 0, F.concat(F.slice(arr, 1, (pos - 1).cast("int")), F.slice(arr, (pos + 1).cast("int"), size)))
        .when(lchoice == 1, F.array_insert(arr, insert_at.cast("int"), elem + ri(-1, 1, 20)))
        .when(lchoice == 2, F.array_append(arr, elem))
        .otherwise(F.transform(arr, lambda x, i: F.when(i + 1 == pos, x + ri(-1, 1, 21)).otherwise(x))))
    return (F.when(F.col("kind") == "int", m_int).when(F.col("kind") == "float", m_float)
            .when(F.col("kind") == "str", m_str).otherwise(m_list))


def mutate_values(cands: DataFrame, ing: tuple[DataFrame, DataFrame], seed: int = 42) -> DataFrame:
    """Multi-step type-directed mutation of (task_id, cand_id, round, kind, value_text): each row takes
    1..5 steps (hash-chosen). A draw depends on the row's key and step alone, so all are looked up in one join.
    (task_id, cand_id, round) tells rows apart."""
    d = _with_draws(cands, ing, seed, MAX_MULTI_STEP)
    d = d.withColumn("n_steps", randint(1, MAX_MULTI_STEP, seed, "task_id", "cand_id", F.col("round"), 0))
    steps = F.sequence(F.lit(1), F.col("n_steps").cast("int"))
    text = F.aggregate(steps, F.col("value_text"), lambda v, step: _mutated(v, step, seed))
    return d.withColumn("value_text", text).drop("n_steps", "_drawn")


# ---------------------------------------------------------------- selection


def seed_sample(pool: DataFrame, k: int = 5, seed: int = 42, key: str = "task_id", item: str = "seed_id") -> DataFrame:
    """Up to k seeds per task without replacement, ordered by md5('task:item:seed'). A rank filter, so
    Catalyst plans a per-partition group limit before the shuffle."""
    h = F.md5(F.concat_ws(":", F.col(key), F.col(item).cast("string"), F.lit(str(seed))))
    w = Window.partitionBy(key).orderBy(h, F.col(item))
    return pool.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def novel_inputs(cands: DataFrame, pool: DataFrame, num: int, order: str = "cand_id",
                 limits: DataFrame | None = None) -> DataFrame:
    """Candidates whose text is new to the task's pool and not repeated by an earlier candidate; at most
    ``num`` per task in candidate order, or as many as ``limits`` (task_id, missing) gives the task."""
    fresh = cands.join(pool.select("task_id", "value_text"), ["task_id", "value_text"], "left_anti")
    w1 = Window.partitionBy("task_id", "value_text").orderBy(order)
    first = fresh.withColumn("_d", F.row_number().over(w1)).where("_d = 1").drop("_d")
    w2 = Window.partitionBy("task_id").orderBy(order)
    ranked = first.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= num)
    if limits is not None:
        ranked = ranked.join(limits.select("task_id", "missing"), "task_id").where(F.col("_r") <= F.col("missing")).drop("missing")
    return ranked.drop("_r")


def grow(pool: DataFrame, offspring: Callable[[DataFrame, DataFrame], DataFrame], per_seed: int = 4, num: int = 10,
         seed: int = 42, patience: int = 2) -> DataFrame:
    """New inputs with their round: every task grows until it has ``num`` of them or is dry.

    A round samples seeds of (task_id, kind, value_text, seed_id), asks ``offspring(candidates, pool)`` for the valid
    changed ones, keeps what is new to the task, and accepts, in candidate order, as many as the task
    still lacks. A table of what each task lacks decides who takes part: full tasks leave, and so do
    those that had ``patience`` rounds in a row without a new input. Each round either fills or dries a task a little
    more, so the loop ends. Pool and table are checkpointed per round (reliable checkpoint in the shared folder)."""
    from graderoom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(pool.sparkSession)
    cur = pool.select("task_id", "kind", "value_text", F.col("seed_id").cast("bigint").alias("seed_id"),
                      F.lit(0).alias("round")).checkpoint()
    lacks = cur.select("task_id").distinct().select("task_id", F.lit(num).cast("bigint").alias("missing"), F.lit(0).alias("dry")).checkpoint()
    r = 0
    while True:
        r += 1
        open_tasks = lacks.where((F.col("missing") > 0) & (F.col("dry") < patience))
        if open_tasks.isEmpty():
            return cur.where(F.col("round") > 0)
        own = cur.join(open_tasks.select("task_id"), "task_id", "left_semi")
        cands = seed_sample(own, k=5, seed=seed + r).select(
            "task_id", "kind", "value_text", "seed_id", F.explode(F.sequence(F.lit(0), F.lit(per_seed - 1))).alias("j"))
        cands = cands.select("task_id", "kind", "value_text", F.xxhash64("task_id", "seed_id", "j", F.lit(r)).alias("cand_id"),
                             F.lit(r).alias("round"))
        new = novel_inputs(offspring(cands, own), own, num, limits=open_tasks).select(
            "task_id", "kind", "value_text", F.col("cand_id").alias("seed_id"), "round").checkpoint()
        gained = new.groupBy("task_id").agg(F.count(F.lit(1)).alias("_n"))
        lacks = lacks.join(gained, "task_id", "left").select(
            "task_id", (F.col("missing") - F.coalesce("_n", F.lit(0))).alias("missing"),
            F.when(F.col("_n").isNull(), F.col("dry") + 1).otherwise(F.lit(0)).alias("dry")).checkpoint()
        cur = cur.unionByName(new).checkpoint()


def grow_inputs(pool: DataFrame, rules: DataFrame, per_seed: int = 4, num: int = 10, seed: int = 42,
                patience: int = 2) -> DataFrame:
    """``grow`` by mutation of scalars and integer lists under the contract ``rules``; ingredients come from the
    grown pool."""
    from graderoom.operators.relational import contract_filter

    def offspring(cands: DataFrame, own: DataFrame) -> DataFrame:
        return contract_filter(mutate_values(cands, index_ingredients(harvest_ingredients(own)), seed), rules)

    return grow(pool, offspring, per_seed, num, seed, patience)
