"""Projections, predicates and joins over samples, problems, executions and model tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- projections / predicates


def filter_subset(df: DataFrame, ids: DataFrame, key: str = "task_id") -> DataFrame:
    """Keep rows whose key is in the split. A semi join: never multiplies rows; AQE turns it into a
    broadcast join once the id side has been measured small."""
    return df.join(ids.select(key), key, "left_semi")


def task_number(task_id: str | Column = "task_id") -> Column:
    c = F.col(task_id) if isinstance(task_id, str) else task_id
    return F.split(c, "/").getItem(1).cast("int")


def filter_id_range(df: DataFrame, low: int, high: int, key: str = "task_id") -> DataFrame:
    """Keep low <= int(id after '/') < high."""
    if not low < high:
        raise ValueError(f"id range needs low < high, got [{low}, {high})")
    n = task_number(key)
    return df.where((n >= low) & (n < high))


def quarantine_unknown_tasks(samples: DataFrame, problems: DataFrame, key: str = "task_id") -> DataFrame:
    """Samples whose task is not in the dataset (returned as a side table instead of a warning)."""
    return samples.join(problems.select(key), key, "left_anti")


def resolve_solution(df: DataFrame, sep: str = "", out: str = "solution") -> DataFrame:
    """``solution`` when present, else ``prompt + sep + completion``."""
    return df.withColumn(
        out, F.coalesce(F.col("solution"), F.concat(F.col("prompt"), F.lit(sep), F.col("completion")))
    )


def encode_identifier(df: DataFrame, model: str = "model", backend: str = "backend",
                      temperature: str = "temperature", perf_type: str | None = None) -> DataFrame:
    """model.strip('./').replace('/', '--') + '_{backend}_temp_{temperature}' [+ '-{perf_type}']."""
    base = F.concat(
        F.regexp_replace(F.expr(f"trim(BOTH './' FROM {model})"), "/", "--"),
        F.lit("_"), F.col(backend), F.lit("_temp_"), F.col(temperature).cast("string"),
    )
    if perf_type is not None:
        base = F.concat(base, F.lit("-"), F.col(perf_type))
    return df.withColumn("model_identifier", base)


IDENTIFIER_PATTERN = r"^(.*)_([^_]*)_temp_(.*)$"


def decode_identifier(df: DataFrame, col: str = "model_identifier") -> DataFrame:
    """Reverse of encode: last '_temp_', then last '_' before it; '--' back to '/' (lossy).
    Rows that do not match are not returned; see ``malformed_identifiers``."""
    c = F.col(col)
    return df.where(c.rlike(IDENTIFIER_PATTERN)).select(
        "*",
        F.regexp_replace(F.regexp_extract(c, IDENTIFIER_PATTERN, 1), "--", "/").alias("model"),
        F.regexp_extract(c, IDENTIFIER_PATTERN, 2).alias("backend"),
        F.regexp_extract(c, IDENTIFIER_PATTERN, 3).alias("temperature"),
    )


def malformed_identifiers(df: DataFrame, col: str = "model_identifier") -> DataFrame:
    return df.where(~F.col(col).rlike(IDENTIFIER_PATTERN))


REQUIRED_PROBLEM_COLUMNS = ("task_id", "prompt", "contract", "canonical_solution", "entry_point", "atol")


def audit_columns(df: DataFrame, cols: Sequence[str] = REQUIRED_PROBLEM_COLUMNS) -> DataFrame:
    """Missing-value count per required column in a single pass, unpivoted to (column_name, n_missing)."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column_name", "n_missing")


MAX_VALUE_BYTES = 64 * 1024 * 1024
CONTAINER_TEXT = r"^\s*[\[({]"
INTEGER_TEXT = r"^\s*[-+]?[0-9]+\s*$"
QUOTED_TEXT = r"\"[^\"]*\"|'[^']*'"
INTEGER_ELEMENT = r"(?<![\w.+-])([-+]?[0-9]+)(?![\w.])"


def guard_int64_and_size(df: DataFrame, text: str = "value_text", max_bytes: int = MAX_VALUE_BYTES) -> DataFrame:
    """Drop integers, and lists, tuples, sets and dicts with an integer in them, that do not fit a signed
    64-bit integer, and values whose text exceeds ``max_bytes`` or is null. Other values pass.
    ``int_value`` is the value of an integer, else null."""
    col = F.col(text)
    v = F.when(col.rlike(INTEGER_TEXT), F.trim(col).try_cast("bigint"))
    unquoted = F.regexp_replace(col, QUOTED_TEXT, "")
    elements = F.regexp_extract_all(unquoted, F.lit(INTEGER_ELEMENT), F.lit(1))
    fits = (
        F.when(col.rlike(INTEGER_TEXT), v.isNotNull())
        .when(col.rlike(CONTAINER_TEXT), F.forall(elements, lambda x: x.try_cast("bigint").isNotNull()))
        .otherwise(F.lit(True)))
    return df.where(fits & (F.octet_length(col) <= max_bytes)).withColumn("int_value", v)


def contract_filter(candidates: DataFrame, rules: DataFrame, key: str = "task_id") -> DataFrame:
    """Keep candidates that satisfy their task's declarative contract (tasks without a rule keep
    everything). Rules: min_value, max_value (numbers and list elements), max_len and pattern
    (strings). Each bound of a rule counts on its own; one that is null does not limit. A rule refuses
    values of other kinds and numbers that cannot be read. The rule table has one row per task and
    joins as a plain equi join."""
    j = candidates.join(rules, key, "left")
    num = F.col("value_text").try_cast("double")
    lst = F.from_json(F.col("value_text"), "array<double>")

    def within(least: Column, most: Column) -> Column:
        return ((F.col("min_value").isNull() | (least >= F.col("min_value")))
                & (F.col("max_value").isNull() | (most <= F.col("max_value"))))

    no_rule = F.lit(True)
    for bound in ("min_value", "max_value", "max_len", "pattern"):
        no_rule = no_rule & F.col(bound).isNull()
    ok = (
        F.when(no_rule, F.lit(True))
        .when(F.col("kind").isin("int", "float"), num.isNotNull() & within(num, num))
        .when(F.col("kind") == "str",
              (F.col("max_len").isNull() | (F.length("value_text") <= F.col("max_len")))
              & (F.col("pattern").isNull() | F.regexp_like(F.col("value_text"), F.col("pattern"))))
        .when(F.col("kind") == "list", lst.isNotNull() & within(F.array_min(lst), F.array_max(lst)))
        .otherwise(F.lit(False))
    )
    return j.where(ok).select(*candidates.columns)


FLOAT_TEXT = r"-?([0-9]+\.[0-9]*([eE][-+]?[0-9]+)?|[0-9]+[eE][-+]?[0-9]+|[iI]nf(inity)?|NaN|nan)"
FLOAT_LIST_TEXT = rf"^\[\s*{FLOAT_TEXT}(\s*,\s*{FLOAT_TEXT})*\s*\]$"


def is_float_value(kind: str | Column, text: str | Column) -> Column:
    """A float, or a non-empty list whose elements are all floats (drives the float tolerance)."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    text = F.col(text) if isinstance(text, str) else text
    return (kind == "float") | ((kind == "list") & text.rlike(FLOAT_LIST_TEXT))


# ---------------------------------------------------------------- joins


def join_samples_problems(samples: DataFrame, problems: DataFrame, cols: Sequence[str], key: str = "task_id") -> DataFrame:
    """Attach problem attributes (many-to-one). Problems are one row per task; AQE broadcasts them
    when measured small, otherwise this stays a shuffle join with skew splitting."""
    return samples.join(problems.select(key, *cols), key, "inner")


def ground_truth_from(executions: DataFrame) -> DataFrame:
    """One expected output / reference time per (task, suite, input)."""
    return executions.groupBy("task_id", "suite", "input_idx").agg(
        F.min("expected").alias("gt_expected"), F.max("ref_time").alias("gt_ref_time")
    )


def join_ground_truth(executions: DataFrame, truth: DataFrame) -> DataFrame:
    return executions.join(truth, ["task_id", "suite", "input_idx"], "inner")


def merge_datasets(left: DataFrame, right: DataFrame, key: str = "task_id") -> DataFrame:
    """Union of two suites; on a key clash the right side wins."""
    return left.join(right.select(key), key, "left_anti").unionByName(right)


def missing_tasks(problems: DataFrame, samples: DataFrame, key: str = "task_id") -> DataFrame:
    return problems.select(key).join(samples.select(key), key, "left_anti")


def attach_accuracy(models: DataFrame, accuracy: DataFrame, key: str = "model_identifier") -> DataFrame:
    """Left-map accuracy onto models; NaN is turned into null, missing stays null."""
    acc = accuracy.select(key, F.nanvl(F.col("accuracy"), F.lit(None).cast("double")).alias("accuracy"))
    return models.join(acc, key, "left")


def generation_worklist(problems: DataFrame, samples: DataFrame, n_samples: int, key: str = "task_id") -> DataFrame:
    """Sample indices still to generate per task: existing..n-1; complete tasks produce no rows."""
    counts = samples.groupBy(key).agg(F.count(F.lit(1)).alias("existing"))
    j = problems.select(key).join(counts, key, "left").fillna(0, ["existing"])
    return j.where(F.col("existing") < n_samples).select(
        key, F.explode(F.sequence(F.col("existing"), F.lit(n_samples - 1).cast("bigint"))).alias("sample_idx")
    )


def worklist_complete(worklist: DataFrame) -> bool:
    """True when every task already has its samples (the worklist is empty)."""
    return worklist.isEmpty()


def pad_samples(samples: DataFrame, n: int, key: str = "task_id", idx: str = "step", text: str = "solution") -> DataFrame:
    """Every task gets rows 0..n-1; missing ones carry empty text. Rows it has beyond them stay."""
    slots = samples.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(idx))
    have = samples.select(key, F.col(idx).cast("int").alias(idx), text)
    return slots.join(have, [key, idx], "full").select(key, idx, F.coalesce(F.col(text), F.lit("")).alias(text))


def resume_finished(todo: DataFrame, finished: DataFrame, key_and_config: Sequence[str]) -> DataFrame:
    """Work items that are not already finished under an equal configuration."""
    return todo.join(finished.select(*key_and_config), list(key_and_config), "left_anti")


def chain_previous_solution(gen: DataFrame, key: str = "task_id", step: str = "step", text: str = "solution",
                            chain: str | None = None, model: str | None = None,
                            previous_model: str = "previous_model") -> DataFrame:
    """For step i > 0 attach the solution of step i-1 of the same task, and of the same chain if ``chain`` names its
    column. With ``model`` it is the solution that the row's ``previous_model`` gave at that step; null if it gave
    none."""
    keys = [*([chain] if chain else []), key, step]
    prev = gen.select(*keys[:-1], (F.col(step) + 1).alias(step), F.col(text).alias("previous_solution"),
                      *([F.col(model).alias(previous_model)] if model else []))
    return gen.join(prev, keys + ([previous_model] if model else []), "left")
