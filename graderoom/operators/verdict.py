"""Per-input comparison and per-sample verdicts over an executions table.

Executions have one row per (sample, suite, input): expected, actual (null = raised), whether the
expected value is a float, the problem's atol, the reference time and the measured run time.
Everything is a window over one (sample, suite) ordered by input index, then one aggregate; no
sample is ever collected whole, and hot tasks do not matter because partitions are per sample.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RTOL = 1e-7
FLOAT_ATOL = 1e-6


@dataclass(frozen=True)
class Limits:
    """Time-limit parameters: per-input limit max(min_limit, factor * ref_time); a suite is killed once
    its elapsed time passes min(budget_cap, sum of limits) + extra_seconds."""

    min_limit: float = 4.0
    factor: float = 4.0
    budget_cap: float = 60.0
    extra_seconds: float = 1.0


def tolerant_equal(actual: Column, expected: Column, tol: Column) -> Column:
    """Exact equality, else when tol != 0: |out - exp| <= tol + rtol * |exp| (allclose semantics).

    NaN equals nothing, itself included; an infinity equals only itself."""
    infinity = F.lit(float("inf"))
    number = ~F.isnan(actual) & ~F.isnan(expected)
    finite = (F.abs(actual) < infinity) & (F.abs(expected) < infinity)
    close = F.abs(actual - expected) <= tol + F.lit(RTOL) * F.abs(expected)
    return number & ((actual == expected) | ((tol != 0) & finite & close))


def compare_outputs(ex: DataFrame) -> DataFrame:
    """Row-local comparison: atol, or 1e-6 when atol is 0 and the expected value is a float."""
    tol = F.when(F.col("atol") != 0, F.col("atol")).when(F.col("expected_is_float"), F.lit(FLOAT_ATOL)).otherwise(0.0)
    ok = F.col("actual").isNotNull() & tolerant_equal(F.col("actual"), F.col("expected"), tol)
    return ex.withColumn("tol", tol).withColumn("ok", F.coalesce(ok, F.lit(False)))


def _input_limit(limits: Limits) -> Column:
    return F.greatest(F.lit(limits.min_limit), F.lit(limits.factor) * F.col("ref_time"))


def sticky_tolerance(ex: DataFrame, limits: Limits, key: Sequence[str] = ("sample_id", "suite"),
                     order: str = "input_idx", actual: str = "actual") -> DataFrame:
    """Effective tolerance per input: once an input whose expected value is a float has been compared
    (it produced a value inside its limit), every later input of that sample uses 1e-6 too."""
    run = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lim = _input_limit(limits)
    produced = F.col(actual).isNotNull() & (F.col("run_time") <= lim)
    seen_float = F.max((produced & F.col("expected_is_float")).cast("int")).over(run) == 1
    tol = F.when(F.col("atol") != 0, F.col("atol")).when(seen_float, F.lit(FLOAT_ATOL)).otherwise(0.0)
    return ex.withColumn("limit", lim).withColumn("produced", produced).withColumn("tol", tol)


def verdict_details(ex: DataFrame, limits: Limits, fast: bool = True,
                    key: Sequence[str] = ("sample_id", "suite"), order: str = "input_idx",
                    matches: Callable[[Column], Column] | None = None, actual: str = "actual") -> DataFrame:
    """Per-input flags: ok, kept (fast mode stops after the first failure) and in_budget.

    Elapsed time per input is min(run_time, limit) because the per-input timer interrupts it. The
    suite budget is min(cap, sum(limits)) + extra; since every elapsed time is at most its limit, the
    running elapsed can only cross that budget through the cap, so ``in_budget`` is
    ``running elapsed <= cap + extra``. Only running sums in input order are compared.

    Outputs are doubles unless ``matches`` says, given the tolerance, whether an output answers the expected
    value (``typed.matches``); ``actual`` is then the column that is null where the call raised.
    """
    run = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    t = sticky_tolerance(ex, limits, key, order, actual)
    same = matches(F.col("tol")) if matches else tolerant_equal(F.col("actual"), F.col("expected"), F.col("tol"))
    ok = F.coalesce(F.col("produced") & same, F.lit(False))
    t = t.withColumn("ok", ok)
    elapsed = F.least(F.col("run_time"), F.col("limit"))
    t = t.withColumn("elapsed_total", F.sum(elapsed).over(run))
    if fast:
        kept = F.coalesce(F.sum((~F.col("ok")).cast("int")).over(before), F.lit(0)) == 0
    else:
        kept = F.lit(True)
    t = t.withColumn("kept", kept)
    t = t.withColumn("in_budget", F.col("elapsed_total") <= F.lit(limits.budget_cap + limits.extra_seconds))
    return t.withColumn("detail", F.col("kept") & F.col("in_budget"))


def derive_verdict(details: DataFrame, key: Sequence[str] = ("sample_id", "suite"),
                   load_error: str | None = None, failed: str | None = None,
                   order: str = "input_idx", show: str | None = None) -> DataFrame:
    """status: load error -> fail (no details); a kept input beyond the budget -> timeout;
    a failing detail -> fail; else pass. With ``failed`` = 'fast' or 'full' the failing inputs are
    produced by the same aggregation (see ``failed_tests``)."""
    shown = F.col(show or order).cast("string")
    aggs = [
        F.max(F.col("kept") & ~F.col("in_budget")).alias("timed_out"),
        F.max(F.col("detail") & ~F.col("ok")).alias("any_fail"),
        F.count_if(F.col("detail")).alias("n_details"),
        F.count(F.lit(1)).alias("n_inputs"),
    ]
    if failed == "fast":
        aggs.append(F.max_by(shown, F.when(F.col("detail"), F.col(order))).alias("_failed"))
    elif failed == "full":
        # failing inputs of one suite: bounded by the suite's input count
        aggs.append(F.array_join(F.transform(F.sort_array(F.collect_list(
            F.when(F.col("detail") & ~F.col("ok"), F.struct(F.col(order).alias("i"), shown.alias("s"))))),
            lambda f: f["s"]), ",").alias("_failed"))
    agg = details.groupBy(*key).agg(*aggs)
    status = F.when(F.col("timed_out"), "timeout").when(F.col("any_fail"), "fail").otherwise("pass")
    if load_error is not None:
        status = F.when(F.col(load_error), "fail").otherwise(status)
    agg = agg.withColumn("status", status)
    if failed is not None:
        agg = agg.withColumn("failed_inputs", F.when(F.col("status") == "pass", F.lit(""))
                             .otherwise(F.coalesce(F.col("_failed"), F.lit("")))).drop("_failed")
    return agg


def input_time_limit(ex: DataFrame, limits: Limits, key: Sequence[str] = ("sample_id", "suite")) -> DataFrame:
    """Per suite: number of inputs and budget = min(cap, sum(limits)) + extra."""
    return ex.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_inputs"),
        (F.least(F.lit(limits.budget_cap), F.sum(_input_limit(limits))) + F.lit(limits.extra_seconds)).alias("budget"),
    )


def failed_tests(details: DataFrame, fast: bool, key: Sequence[str] = ("sample_id", "suite"),
                 order: str = "input_idx", show: str | None = None) -> DataFrame:
    """Failing inputs per suite, by index or by the column ``show``, as a comma-joined, index-ordered list: every failing detail in full
    mode; in fast mode the last executed input (even when it passed and the suite timed out).
    Empty on pass or when there are no details. One aggregation together with the status."""
    v = derive_verdict(details, key, failed="fast" if fast else "full", order=order, show=show)
    return v.select(*key, "status", "failed_inputs")


# ---------------------------------------------------------------- special oracles

# The entry points with special output oracles and the rule each one uses.
ORACLE_RULES = [
    ("are_equivalent", "always"),
    ("sum_div", "zero"),
    ("surface_Area", "surface_area"),
    ("digit_distance_nums", "digit_distance"),
    ("check_str", "not_none"),
    ("text_match_three", "not_none"),
    ("text_starta_endb", "not_none"),
    ("similar_elements", "set_equal"),
    ("find_char_long", "set_equal"),
    ("common_in_nested_lists", "set_equal"),
    ("extract_singly", "set_equal"),
    ("larg_nnum", "set_equal"),
    ("intersection_array", "set_equal"),
    ("find_dissimilar", "set_equal"),
    ("Diff", "set_equal"),
    ("find_zero", "polynomial_root"),
]


def oracle_rule_table(spark) -> DataFrame:
    """Literal rule table (16 rows, bounded), safe to broadcast."""
    return F.broadcast(spark.createDataFrame(ORACLE_RULES, "entry_point string, rule string"))


def set_equal(out: Column, exp: Column) -> Column:
    return F.array_sort(F.array_distinct(out)) == F.array_sort(F.array_distinct(exp))


def not_none_oracle(out_is_bool: Column, out_bool: Column, out_present: Column, exp: Column) -> Column:
    """bool outputs compare directly; anything else compares ``expected`` with 'output is not None'."""
    return F.when(out_is_bool, out_bool == exp).otherwise(exp == out_present)


def alternatives_oracle(rule: Column, exact: Column, actual: Column, alternative: Column, atol: Column) -> Column:
    """Accept alternative answers: always true / zero output / an alternative formula within atol."""
    return (
        exact
        | (rule == "always")
        | ((rule == "zero") & (actual == 0))
        | ((rule == "surface_area") & (F.abs(actual - alternative) <= atol))
        | ((rule == "digit_distance") & (actual == alternative))
    )


def surface_area(base: Column, height: Column) -> Column:
    """round(b^2 + 2*b*sqrt((b/2)^2 + h^2)) with half-even rounding."""
    slant = F.sqrt(F.pow(base / 2, 2) + F.pow(height, 2))
    return F.bround(F.pow(base, 2) + F.lit(4) * (base * slant) / 2, 0)


def digit_distance(a: Column, b: Column) -> Column:
    """Zero-pad both numbers to a common width and sum absolute digit differences; null where a
    character is no digit, as for a negative number (a failed input)."""
    sa, sb = a.cast("string"), b.cast("string")
    width = F.greatest(F.length(sa), F.length(sb))
    pa, pb = F.lpad(sa, width, "0"), F.lpad(sb, width, "0")
    diffs = F.transform(F.sequence(F.lit(1), width),
                        lambda i: F.abs(F.substring(pa, i, 1).try_cast("int") - F.substring(pb, i, 1).try_cast("int")))
    return F.aggregate(diffs, F.lit(0), lambda acc, d: acc + d)


def polynomial(coeffs: Column, x: Column) -> Column:
    """sum_i coeffs[i] * x^i."""
    terms = F.transform(coeffs, lambda c, i: c * F.pow(x, i))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
