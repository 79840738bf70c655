"""Registered queries: typed values and test-input growth."""

from __future__ import annotations

from pyspark.sql import functions as F

from graderoom.catalog.relational import contract_rules
from graderoom.fixtures import Inputs, cte
from graderoom.operators import inputs as I
from graderoom.operators import values as Val
from graderoom.registry import register


def decode_rules(x: Inputs):
    """One decode rule per task of the catalog: every third task decodes lists as sets, the next as tuples."""
    p = x.v("problems_catalog")
    n = F.split("task_id", "/").getItem(1).cast("int") % 3
    return p.select("task_id", F.when(n == 0, "set").when(n == 1, "tuple").otherwise("plain").alias("rule"))


_DECODE_SQL = cte("problems_catalog", "f7_values") + """,
rules as (select task_id, case cast(split_part(task_id, '/', 2) as integer) % 3 when 0 then 'set' when 1 then 'tuple' else 'plain' end as rule
          from problems_catalog),
j as (select v.*, coalesce(r.rule, 'plain') as rule from f7_values v left join rules r using (task_id)),
d as (select task_id, seed_id, rule, kind,
             case when kind in ('int', 'float') then cast(value_text as double) end as num_value,
             case when kind = 'list' then (case when rule = 'set' then list_sort(list_distinct(cast(value_text as bigint[])))
                                                else cast(value_text as bigint[]) end) end as list_value,
             case when kind = 'str' then value_text end as text_value
      from j)
"""


@register("decode_inputs", _DECODE_SQL + """
select task_id, seed_id, rule, kind, num_value, cast(len(list_value) as integer) as n_elems,
       cast(list_sum(list_value) as bigint) as elem_sum, text_value from d""")
def q_decode_inputs(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    d = I.decode_inputs(x.v("f7_values"), decode_rules(x))
    return d.select("task_id", "seed_id", "rule", "kind", "num_value", F.size("list_value").alias("n_elems"),
                    F.aggregate("list_value", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("elem_sum"), "text_value")


@register("encode_inputs", _DECODE_SQL + """
select task_id, seed_id, rule, kind,
       case when kind = 'list' then cast(to_json(list_value) as varchar)
            when kind = 'int' then cast(cast(num_value as bigint) as varchar)
            when kind = 'float' then cast(num_value as varchar)
            else cast(to_json([text_value]) as varchar) end as encoded
from d""")
def q_encode_inputs(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return I.encode_inputs(I.decode_inputs(x.v("f7_values"), decode_rules(x)))


@register("harvest_ingredients", cte("f7_values") + """
select distinct task_id, kind, value_text from (
  select task_id, kind, value_text from f7_values where kind in ('int', 'float', 'str')
  union all select task_id, 'str', unnest(regexp_split_to_array(trim(value_text), '\\s+')) from f7_values where kind = 'str'
  union all select task_id, 'int', cast(unnest(cast(value_text as bigint[])) as varchar) from f7_values where kind = 'list')
where value_text <> ''""")
def q_harvest_ingredients(spark, sf_dir):
    return I.harvest_ingredients(Inputs(spark, sf_dir).v("f7_values"))


@register("seed_sample", cte("f7_values") + """
select task_id, seed_id from (select task_id, seed_id, row_number() over (partition by task_id
  order by md5(task_id || ':' || cast(seed_id as varchar) || ':42'), seed_id) as r from f7_values) where r <= 5""")
def q_seed_sample(spark, sf_dir):
    v = Inputs(spark, sf_dir).v("f7_values")
    return I.seed_sample(v, k=5, seed=42).select("task_id", "seed_id")


@register("novel_inputs", cte("f7_values") + """,
c as (select task_id, kind, seed_id as cand_id,
             case kind when 'int' then cast(try_cast(value_text as bigint) + seed_id % 3 - 1 as varchar)
                       when 'str' then value_text || (case when seed_id % 3 = 1 then '' else ' more' end)
                       when 'list' then (case when seed_id % 3 = 1 then value_text else '[1,' || substr(value_text, 2) end)
                       else (case when seed_id % 3 = 1 then value_text else '-' || value_text end) end as value_text
      from f7_values),
f as (select * from c where not exists (select 1 from f7_values p where p.task_id = c.task_id and p.value_text = c.value_text)),
d as (select *, row_number() over (partition by task_id, value_text order by cand_id) as rd from f),
r as (select *, row_number() over (partition by task_id order by cand_id) as rn from d where rd = 1)
select task_id, value_text, cand_id from r where rn <= 5""")
def q_novel_inputs(spark, sf_dir):
    v = Inputs(spark, sf_dir).v("f7_values")
    text, same = F.col("value_text"), F.col("seed_id") % 3 == 1
    changed = (F.when(F.col("kind") == "int", (text.try_cast("bigint") + F.col("seed_id") % 3 - 1).cast("string"))
               .when(F.col("kind") == "str", F.when(same, text).otherwise(F.concat(text, F.lit(" more"))))
               .when(F.col("kind") == "list", F.when(same, text).otherwise(F.concat(F.lit("[1,"), F.substring(text, 2, 1 << 30))))
               .otherwise(F.when(same, text).otherwise(F.concat(F.lit("-"), text))))
    c = v.select("task_id", "kind", changed.alias("value_text"), F.col("seed_id").alias("cand_id"))
    return I.novel_inputs(c, v, 5).select("task_id", "value_text", "cand_id")


@register("generate_values")
def q_generate_values(spark, sf_dir):
    v = Inputs(spark, sf_dir).v("f7_values")
    ing = I.index_ingredients(I.harvest_ingredients(v))
    slots = v.select("task_id", "kind").distinct().select(
        "task_id", "kind", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("gen_id"))
    return I.generate_values(slots, ing, seed=42)


@register("mutate_values")
def q_mutate_values(spark, sf_dir):
    v = Inputs(spark, sf_dir).v("f7_values")
    ing = I.index_ingredients(I.harvest_ingredients(v))
    cands = v.select("task_id", "kind", "value_text", F.col("seed_id").alias("cand_id"), F.lit(1).alias("round"))
    return I.mutate_values(cands, ing, seed=42)


@register("grow_inputs")
def q_grow_inputs(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return I.grow_inputs(x.v("f7_values"), contract_rules(x), per_seed=4, num=10, seed=42)


def _decoded(spark, sf_dir):
    given = Inputs(spark, sf_dir).v("f10_inputs").select("task_id", "seed_id", "value_text")
    return Val.decode_values(given, I.reference_rule_table(spark))


def _valid_first_argument(rows):
    """A contract in SQL over typed text: a first argument that is a number is no less than -1000."""
    first = F.try_variant_get(F.try_parse_json("typed"), "$[0]", "double")
    return rows.where(F.coalesce(first >= -1000, F.lit(True)))


@register("decode_typed", cte("f10_inputs") + "select task_id, seed_id, typed, typed is null as failed from f10_inputs")
def q_decode_typed(spark, sf_dir):
    return _decoded(spark, sf_dir).select("task_id", "seed_id", "typed", F.col("problem").isNotNull().alias("failed"))


@register("encode_typed", cte("f10_inputs") + "select task_id, seed_id, encoded, typed as again from f10_inputs")
def q_encode_typed(spark, sf_dir):
    """JSON of the typed inputs, and what it decodes to."""
    encoded = Val.encode_values(_decoded(spark, sf_dir)).select("task_id", "seed_id", "encoded")
    again = Val.decode_values(encoded, I.reference_rule_table(spark), text="encoded")
    return again.select("task_id", "seed_id", "encoded", F.col("typed").alias("again"))


@register("harvest_typed", cte("f10_scalars") + "select task_id, kind, value_text from f10_scalars")
def q_harvest_typed(spark, sf_dir):
    return Val.harvest_values(_decoded(spark, sf_dir))


@register("generate_typed")
def q_generate_typed(spark, sf_dir):
    decoded = _decoded(spark, sf_dir)
    kinds = F.array(*[F.lit(k) for k in ("int", "float", "complex", "str", "bool", "none", "list", "tuple", "set", "dict")])
    slots = decoded.select("task_id", F.explode(kinds).alias("kind"), F.col("seed_id").alias("gen_id"))
    return Val.generate_typed(slots, I.index_ingredients(Val.harvest_values(decoded)))


@register("mutate_typed")
def q_mutate_typed(spark, sf_dir):
    decoded = _decoded(spark, sf_dir)
    cands = decoded.where("typed is not null").select("task_id", F.col("seed_id").alias("cand_id"), F.lit(1).alias("round"), "typed")
    return Val.mutate_typed(cands, I.index_ingredients(Val.harvest_values(decoded)))


@register("grow_typed")
def q_grow_typed(spark, sf_dir):
    return Val.grow_typed(_decoded(spark, sf_dir), _valid_first_argument)
