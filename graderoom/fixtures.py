"""Derived test views F0-F10 over the driver tables.

Each view is one SELECT whose text runs unchanged in Spark SQL and DuckDB, so the Spark side and
the DuckDB oracle start from identical inputs. On the Spark side a view is built straight from the
parquet tables of one scale-factor folder; on the oracle side the same text is prepended as a CTE.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# F0, the problem catalog: one problem per part. Samples are of the task numbered a quarter of their part (F1)
# or a sixty-fourth of their order (F2), so tasks grow with the tables; every 17th of these tasks is moved
# beyond all parts. So F1 and F2 have tasks unknown to the dataset, and the dataset has tasks without samples.
_PROBLEM_COLUMNS = """
select concat('Task/', cast(p_partkey as string)) as task_id,
       concat('def f_', cast(p_partkey as string), '(x):') as prompt,
       case when p_partkey % 17 = 0 then null else 'assert x >= 0' end as contract,
       concat('    return x + ', cast(p_size as string)) as canonical_solution,
       concat('f_', cast(p_partkey as string)) as entry_point,
       case when p_partkey % 2 = 0 then cast(0 as double) else cast(0.000001 as double) end as atol,
       case when p_partkey % 3 = 0 then 'mini' when p_partkey % 3 = 1 then 'noextreme' else 'full' end as variant
from part"""

_ROWNUM_LINEITEM = """(select *, row_number() over (partition by l_orderkey, l_linenumber
        order by l_partkey, l_suppkey, l_extendedprice, l_shipdate) as rn from lineitem)"""


def _task(key: str, share: int) -> str:
    number = f"cast(floor({key} / {share}) as bigint)"
    return f"concat('Task/', cast({number} + case when {number} % 17 = 0 then 1000000000 else 0 end as string))"


# Typed outputs by kind of case, n = order number modulo 32: kinds and texts of the expected and the actual value,
# the call's inputs and whether the output is right. K is the row's part number. Every third row of a case that is
# right by itself raises instead.
_CASES = [
    ("list", "[K.5, 2.25]", "list", "[K.5, 2.2500000001]", True), ("list", "[K, 1]", "tuple", "[K, 1]", False),
    ("list", "[[K, 2], [3]]", "list", "[[K,2],[3]]", True), ("dict", '{"a": K, "b": [2]}', "dict", '{"b": [2], "a": K}', True),
    ("str", '"a, [K]"', "str", '"a, [K]"', True), ("str", '"a K"', "str", '"a  K"', False), ("int", "K", "float", "K.0", True),
    ("bool", "true", "int", "1", True), ("none", "null", "none", "null", True), ("int", "K", None, None, False),
    ("set", "[3, K]", "set", "[K, 3, 3]", True), ("list", "[NaN]", "list", "[NaN]", False), ("list", "[K, 2]", "list", "[K, 2, 2]", False),
    ("list", "[K.5]", "list", "[K.501]", False), ("tuple", "[K, [1]]", "tuple", "[K, [2]]", False),
    ("list", "[[0.1], [0.3]]", "list", "[[0.1], [0.30000000004]]", True), ("bool", "false", "int", "7", True), ("int", "5", "int", "0", True),
    ("int", "5", "int", "1", False), ("float", "33.0", "int", "96", True), ("float", "33.0", "int", "97", False), ("int", "0", "int", "7", True),
    ("int", "0", "int", "8", False), ("list", "[4, K]", "list", "[K, 4, 4.0]", True), ("list", "[4, 5.5]", "tuple", "[4]", False),
    ("bool", "true", "str", '"K"', True), ("bool", "false", "none", "null", True), ("bool", "true", "bool", "false", False),
    ("float", "0.0", "float", "6.0", True), ("float", "0.0", "float", "5.0", False), ("set", "[1, K]", "set", "[2]", False),
    ("int", "9007199254740993", "int", "9007199254740992", False)]
_CALLS = {19: "[6, 4]", 20: "[6, 4]", 21: "[123, 256]", 22: "[123, 256]", 28: "[[-6, 1]]", 29: "[[-6, 1]]"}


def _typed(what: str) -> str:
    def text(value: str | None) -> str:
        return "cast(null as string)" if value is None else "replace('" + value + "', 'K', cast(l_partkey as string))"

    columns = {"expected_kind": 0, "expected": 1, "actual_kind": 2, "actual": 3}
    cases = []
    for n, case in enumerate(_CASES):
        if what == "inputs":
            value = text(_CALLS.get(n, "[K]"))
        elif what == "ok":
            value = "not changed" if case[4] else "false"
        elif what.startswith("actual") and case[4]:
            value = f"case when changed then cast(null as string) else {text(case[columns[what]])} end"
        else:
            value = text(case[columns[what]])
        cases.append(f"when {n} then {value}")
    return f"case l_orderkey % 32 {' '.join(cases)} end"


# Typed inputs by kind of case, n = part number modulo 16: task number (its decode class is that of
# ``inputs.REFERENCE_DECODE_RULES``), the call's arguments, their typed form, and JSON that decodes to it again.
# K is the row's part number.
_DECODES = [
    (2, '[[K, 4], [4, "a"]]', '[{"tuple": [K, 4]}, {"tuple": [4, "a"]}]', '[[K, 4], [4, "a"]]'),
    (63, '[[[K, 2], [3]]]', '[[{"tuple": [K, 2]}, {"tuple": [3]}]]', '[[[K, 2], [3]]]'),
    (75, '[[[K, 1]], 6, 9]', '[[{"tuple": [K, 1]}], 6]', '[[[K, 1]], 6]'),
    (106, '[[K], [1, 2.5]]', '[[K], {"tuple": [1, 2.5]}]', '[[K], [1, 2.5]]'),
    (115, '[[[K, K], [], [2]], 1]', '[[{"set": [K]}, {"dict": []}, {"set": [2]}]]', '[[[K], [], [2]]]'),
    (124, '["0.5", "K+2j"]', '{"tuple": [0.5, {"complex": [K.0, 2.0]}]}', '["0.5", "(K+2j)"]'),
    (250, '[[K, [1]], 3]', '[{"tuple": [K, [1]]}, 3]', '[[K, [1]], 3]'),
    (259, '[[[1, K], [4, 5]], [[6, 7]]]', '[{"tuple": [{"tuple": [1, K]}, {"tuple": [4, 5]}]}, {"tuple": [{"tuple": [6, 7]}]}]',
     '[[[1, K], [4, 5]], [[6, 7]]]'),
    (278, '[[4, [K, "x"], null]]', '[{"tuple": [4, {"tuple": [K, "x"]}, null]}]', '[[4, [K, "x"], null]]'),
    (307, '[[K, "a"], 1, 2.0]', '[{"tuple": [K, "a"]}, 1, 2.0]', '[[K, "a"], 1, 2.0]'),
    (722, '[{"k": [K, 1.5]}, true]', '[{"dict": [["k", {"tuple": [K, 1.5]}]]}, true]', '[{"k": [K, 1.5]}, true]'),
    (252, '["K-1j"]', '[{"complex": [K.0, -1.0]}]', '["(K-1j)"]'),
    (580, '[[K, [1, []]], "s"]', '{"tuple": [{"tuple": [K, {"tuple": [1, {"tuple": []}]}]}, "s"]}', '[[K, [1, []]], "s"]'),
    (1, '[[K, "a b", false, null, {"n": [1.5]}]]', '[[K, "a b", false, null, {"dict": [["n", [1.5]]]}]]',
     '[[K, "a b", false, null, {"n": [1.5]}]]'),
    (3, '[K9999999999999999999, NaN, -Infinity]', '[K9999999999999999999, NaN, -Infinity]', '[K9999999999999999999, NaN, -Infinity]'),
    (75, '[[[K, 1]]', None, None)]
# The scalars inside the typed forms, without those of sets.
_SCALARS = [
    (2, "int", "K 4"), (2, "str", "a"), (63, "int", "K 2 3"), (75, "int", "K 1 6"), (106, "int", "K 1"), (106, "float", "2.5"),
    (124, "float", "0.5"), (124, "complex", "(K+2j)"), (250, "int", "K 1 3"), (259, "int", "K 1 4 5 6 7"), (278, "int", "K 4"),
    (278, "str", "x"), (307, "int", "K 1"), (307, "float", "2.0"), (307, "str", "a"), (722, "int", "K 1"), (722, "float", "1.5"),
    (722, "str", "k"), (252, "complex", "(K-1j)"), (580, "int", "K 1"), (580, "str", "s"), (1, "int", "K 0"), (1, "float", "1.5"),
    (1, "str", "a_b a b n"), (3, "int", "K9999999999999999999"), (3, "float", "NaN -Infinity")]


# The code of F6: an import, a helper, a function nobody calls and the entry point, in a reply between other lines.
_ENTRY = """'def f_', cast(p_partkey % 200 as string), '(x):', chr(10),
              case when p_size % 4 = 0 then '   ' else '    ' end, 'return helper(x) + ', cast(p_size as string)"""


def _code(unused: bool) -> str:
    idle = "'def unused(x):', chr(10), '    return 0', chr(10)," if unused else ""
    return f"""concat('import math', chr(10), 'def helper(x):', chr(10), '    return x * 2', chr(10), {idle} {_ENTRY})"""


_REPLY = f"""concat(chr(27), '[31mHere is code', chr(27), '[0m', chr(10), '```python', chr(10), {_code(True)}, chr(10),
              case when p_size % 5 = 0 then concat('def broken(', chr(10)) else '' end,
              '```', chr(10), 'Hope this helps', chr(10), 'print(1)')"""


def _rows(rows: list[tuple], columns: str) -> str:
    """A literal table in SQL."""
    def cell(v):
        return "cast(null as string)" if v is None else str(v) if isinstance(v, int) else f"'{v}'"

    return "(values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") as c({columns})"


VIEWS: dict[str, str] = {
    "problems_catalog": _PROBLEM_COLUMNS,
    "f0_problems": _PROBLEM_COLUMNS,
    "f1_samples": f"""
select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(rn as string)) as sample_id,
       concat('m', cast(l_suppkey % 4 as string)) as model,
       {_task("l_partkey", 4)} as task_id,
       case when l_returnflag = 'N' then 'pass' when l_returnflag = 'R' then 'timeout' else 'fail' end as base_status,
       case when l_linestatus = 'F' then 'pass' else 'fail' end as plus_status
from {_ROWNUM_LINEITEM} t""",
    "f2_executions": f"""
select sample_id, suite, task_id,
       cast(row_number() over (partition by sample_id, suite order by l_linenumber, rn) - 1 as bigint) as input_idx,
       expected, actual, expected_is_float, atol, ref_time, run_time
from (select cast(l_orderkey as string) as sample_id, l_linenumber, rn,
       case when l_linestatus = 'F' then 'base' else 'plus' end as suite,
       {_task("l_orderkey", 64)} as task_id,
       l_extendedprice as expected,
       case l_partkey % 16 when 0 then l_extendedprice + 1 when 1 then null
            when 2 then l_extendedprice * (1 + 0.00000005) when 3 then l_extendedprice + 0.0000005
            else l_extendedprice end as actual,
       l_partkey % 3 = 0 as expected_is_float,
       case when l_orderkey % 2 = 0 then cast(0 as double) else cast(0.000001 as double) end as atol,
       l_tax as ref_time, l_quantity / 400 as run_time
      from {_ROWNUM_LINEITEM} t) u""",
    "f3_generations": """
select concat('Task/', cast(a.conv_id as string)) as task_id, u.text as prompt, a.text as solution,
       cast(row_number() over (partition by a.conv_id order by a.turn) - 1 as bigint) as step
from conversations a join conversations u
  on u.conv_id = a.conv_id and u.turn = a.turn - 1 and u.role = 'user'
where a.role = 'assistant'""",
    "f4_accuracy": """
select concat('org--model', cast(doc_id % 9 as string), '_hf_temp_0.0') as model_identifier,
       avg(cast(quality as double)) as accuracy
from labels group by 1""",
    "f4_responses": """
select vec_id, concat('org--model', cast(label as string), '_hf_temp_0.0') as model_identifier, embedding
from embeddings""",
    "f5_profiles": """
select user_id as task, event_id % 12 as solution_idx, event_id as round_id,
       event_type <> 'error' as passed,
       (case when user_id % 10 = 0 then 5000 else 20000000.0 * (1 + user_id % 20) end)
         * (1 + floor((event_id % 12) / (1 + user_id % 4)) / 2.0)
         * (1 + value * (user_id % 5) / 4000.0) as cost
from events""",
    "f5b_candidates": """
select l_orderkey % 200 as task, l_linenumber as input_idx, l_suppkey % 5 as solution_idx,
       max(l_extendedprice) as canonical_cost, min(l_quantity) > 1 as ok, count(*) as n
from lineitem group by 1, 2, 3""",
    "f6_code": f"""
select p_partkey as text_id, concat('f_', cast(p_partkey % 200 as string)) as entry_point, {_REPLY} as text
from part""",
    "f6_truth": f"""
select p_partkey as text_id, concat('f_', cast(p_partkey % 200 as string)) as entry_point, p_size % 5 = 0 as broken, p_size % 4 = 0 as narrow,
       {_code(True)} as block, {_code(False)} as clean
from part""",
    "f6_samples": f"""
select concat('s', cast(p_partkey as string)) as sample_id,
       concat(case when p_partkey % 13 = 5 then 'Other/' else 'Task/' end, cast(p_partkey % 200 as string)) as task_id,
       case p_partkey % 4 when 0 then cast(null as string) when 1 then {_code(False)} else {_REPLY} end as solution,
       case when p_partkey % 4 = 0 then {_REPLY} end as completion, {_code(False)} as truth
from part""",
    "f7_values": """
select concat('Task/', cast(cast(floor(p_partkey / 8) as bigint) as string)) as task_id, p_partkey as seed_id,
       case p_partkey % 4 when 0 then 'int' when 1 then 'float' when 2 then 'str' else 'list' end as kind,
       case p_partkey % 4 when 0 then cast(p_size as string)
            when 1 then cast(cast(p_size as double) / 4 as string)
            when 2 then p_name
            else concat('[', cast(p_size as string), ',', cast(p_size % 7 as string), ',', cast(p_partkey % 5 as string), ']') end as value_text
from part""",
    "f9_problems": """
select concat('Typed/', cast(n as string)) as task_id,
       case n when 16 then 'are_equivalent' when 17 then 'sum_div' when 18 then 'sum_div' when 19 then 'surface_Area'
              when 20 then 'surface_Area' when 21 then 'digit_distance_nums' when 22 then 'digit_distance_nums'
              when 23 then 'similar_elements' when 24 then 'similar_elements' when 25 then 'check_str' when 26 then 'check_str'
              when 27 then 'check_str' when 28 then 'find_zero' when 29 then 'find_zero' else concat('plain_', cast(n as string)) end as entry_point
from (select distinct p_partkey % 32 as n from part) t""",
    "f9_typed": f"""
select cast(l_orderkey as string) as sample_id, concat('Typed/', cast(l_orderkey % 32 as string)) as task_id,
       case when l_linestatus = 'F' then 'base' else 'plus' end as suite,
       cast(row_number() over (partition by l_orderkey, l_linestatus order by l_linenumber, rn) - 1 as bigint) as input_idx,
       concat('m', cast(l_orderkey % 3 as string)) as model,
       {_typed("expected_kind")} as expected_kind, {_typed("expected")} as expected_json,
       {_typed("actual_kind")} as actual_kind, {_typed("actual")} as actual_json, {_typed("inputs")} as inputs,
       {_typed("ok")} as truth,
       case when l_orderkey % 32 in (0, 13) then true else false end as expected_is_float,
       case when l_orderkey % 32 in (15, 28, 29) then 0.000001 else cast(0 as double) end as atol,
       cast(0.01 as double) as ref_time, cast(0.001 as double) as run_time
from (select *, l_quantity % 3 < 1 as changed from {_ROWNUM_LINEITEM} t) u""",
    "f10_inputs": f"""
select concat('Mbpp/', cast(task as string)) as task_id, p_partkey as seed_id,
       replace(given, 'K', cast(p_partkey as string)) as value_text, replace(typed, 'K', cast(p_partkey as string)) as typed,
       replace(encoded, 'K', cast(p_partkey as string)) as encoded
from part join {_rows([(n, *case) for n, case in enumerate(_DECODES)], "n, task, given, typed, encoded")} on p_partkey % 16 = n""",
    "f10_scalars": f"""
select distinct concat('Mbpp/', cast(task as string)) as task_id, kind,
       replace(replace(word, '_', ' '), 'K', cast(p_partkey as string)) as value_text
from part join {_rows([(n, case[0], kind, word) for n, case in enumerate(_DECODES) if case[2] for task, kind, words in _SCALARS if task == case[0]
                       for word in words.split()], "n, task, kind, word")} on p_partkey % 16 = n""",
    "f8_edges": """
select p_partkey as src, cast(floor(p_partkey / 2) as bigint) as dst from part where p_partkey > 1
union all
select p_partkey, cast(floor(p_partkey / 3) as bigint) from part where p_partkey > 2 and p_partkey % 5 = 0""",
}

# F2 verdict parameters (fixed values of the fixture).
F2_PARAMS = dict(min_limit=0.1, factor=4.0, budget_cap=0.3, extra_seconds=0.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build one fixture view over the parquet tables of ``sf_dir``.

    Base tables are registered as temp views right before the SELECT is analysed; the returned
    DataFrame holds the analysed plan, so later registrations for other folders do not affect it.
    """
    sql = VIEWS[name]
    for t in BASE_TABLES:
        if re.search(rf"\b{t}\b", sql):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def cte(*names: str) -> str:
    """WITH-prefix defining the given views for an oracle query (DuckDB)."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in names) + "\n"


class Inputs:
    """Lazy accessor bundle for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def t(self, name: str) -> DataFrame:
        key = "t:" + name
        if key not in self._cache:
            self._cache[key] = table(self.spark, self.sf_dir, name)
        return self._cache[key]

    def v(self, name: str) -> DataFrame:
        key = "v:" + name
        if key not in self._cache:
            self._cache[key] = view(self.spark, self.sf_dir, name)
        return self._cache[key]
