"""Comparison of typed outputs: scalars, strings, lists, tuples, sets and dicts of any depth.

A value is a kind (int, float, bool, none, str, list, tuple, set, dict; null if the call raised) and its JSON
text, in which NaN, Infinity and -Infinity may stand for numbers. Both texts are cut into tokens: brackets,
separators and leaves. A token's place is its path, so values of any depth are compared token by token, without
recursion; keys of objects are put in order first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graderoom.operators import verdict as V

TOKEN = (r'"(?:[^"\\]|\\.)*"|-?(?:Infinity|NaN|[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?)|true|false|null|[\[\]{}:,]')
WHOLE = r"^-?[0-9]+$"
NUMBERS = ("int", "float", "bool")


def canonical(kind: Column, text: Column) -> Column:
    """The text with the keys of objects in order; as it is where it has none, or what JSON has not."""
    return F.when(kind == "dict", F.coalesce(F.to_json(F.try_parse_json(text)), text)).otherwise(text)


def tokens(kind: Column, text: Column) -> Column:
    found = F.regexp_extract_all(canonical(kind, text), F.lit(TOKEN), F.lit(0))
    return F.when(kind == "set", F.array_sort(F.array_distinct(F.filter(found, lambda t: ~t.isin("[", "]", ","))))).otherwise(found)


def number(token: Column) -> Column:
    """A leaf's number, true as 1 and false as 0; null for other tokens."""
    return F.when(token == "true", 1.0).when(token == "false", 0.0).otherwise(token.try_cast("double"))


def same_leaf(a: Column, b: Column) -> Column:
    """Python's ==: equal texts, or equal numbers of whatever type; whole numbers digit by digit; NaN never."""
    x, y = number(a), number(b)
    numbers = F.when(a.rlike(WHOLE) & b.rlike(WHOLE), a == b).otherwise((x == y) & ~F.isnan(x))
    return F.when(x.isNotNull() & y.isNotNull(), numbers).otherwise(a == b)


def close_leaf(a: Column, b: Column, tol: Column) -> Column:
    """Numbers within the tolerance; brackets and separators must be equal, other leaves never are close."""
    x, y = number(a), number(b)
    return F.when(x.isNotNull() & y.isNotNull(), V.tolerant_equal(x, y, tol)).otherwise((a == b) & a.rlike(r"^[\[\],]$"))


def _pairwise(a: Column, b: Column, test) -> Column:
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    return (F.size(a) == F.size(b)) & F.forall(both, lambda p: F.coalesce(test(p["a"], p["b"]), F.lit(False)))


def _elements(text: Column) -> Column:
    """The distinct elements of a flat or nested list, numbers by value."""
    plain = F.from_json(text, "array<string>")
    return F.array_sort(F.array_distinct(F.transform(
        plain, lambda t: F.coalesce(number(t).cast("string"), t))))


def matches(tol: Column, rule: str | None = None) -> Column:
    """Whether ``actual`` (actual_kind, actual_json) answers ``expected`` (expected_kind, expected_json).

    Equal values match; lists and tuples never equal each other. Else, if ``tol`` is not 0, numbers and
    lists or tuples of numbers of the same kind and shape match within it. ``rule`` names a column with the
    special rule of the task's entry point, null for none; rules that compute take the call's ``inputs``
    (a JSON list) and the task's ``atol``.
    """
    ek, ak = F.col("expected_kind"), F.col("actual_kind")
    e, a = tokens(ek, F.col("expected_json")), tokens(ak, F.col("actual_json"))
    comparable = (ek == ak) | (ek.isin(*NUMBERS) & ak.isin(*NUMBERS))
    exact = comparable & _pairwise(a, e, same_leaf)
    if rule is not None:
        r, out = F.col(rule), number(F.col("actual_json"))
        args = F.from_json("inputs", "array<string>")
        arg = lambda i: F.get(args, F.lit(i))
        side, height = arg(0).try_cast("double"), arg(1).try_cast("double")
        distance = V.digit_distance(arg(0).try_cast("bigint"), arg(1).try_cast("bigint"))
        truth = F.col("expected_json") == "true"
        special = (
            F.when(r == "always", F.lit(True))
            .when(r == "zero", exact | (out == 0))
            .when(r == "surface_area", exact | (F.abs(out - V.surface_area(side, height)) <= F.col("atol")))
            .when(r == "digit_distance", exact | (out == distance))
            .when(r == "set_equal", _elements(F.col("actual_json")) == _elements(F.col("expected_json")))
            .when(r == "not_none", F.when(ak == "bool", F.col("actual_json") == F.col("expected_json"))
                  .otherwise(truth == (ak != "none"))))
        exact = F.coalesce(special, exact)
    shaped = ek.isin("int", "float", "bool", "list", "tuple") & (ek == ak)
    close = (tol != 0) & shaped & _pairwise(a, e, lambda x, y: close_leaf(x, y, tol))
    ok = F.coalesce(exact, F.lit(False)) | F.coalesce(close, F.lit(False))
    if rule is not None:
        root = F.abs(V.polynomial(F.from_json(F.get(F.from_json("inputs", "array<string>"), F.lit(0)), "array<double>"),
                                  number(F.col("actual_json"))))
        ok = F.when(F.col(rule) == "polynomial_root", F.coalesce(root <= F.col("atol"), F.lit(False))).otherwise(ok)
    return ok & ak.isNotNull()


def with_rules(executions: DataFrame, problems: DataFrame, key: str = "task_id") -> DataFrame:
    """Adds ``rule``, that of the task's entry point; executions of unknown tasks go."""
    known = problems.select(key, "entry_point")
    rules = V.oracle_rule_table(executions.sparkSession)
    return executions.join(known, key).join(rules, "entry_point", "left").drop("entry_point")
