"""Corpus-scale code cleaning as Spark jobs.

Pattern everywhere: distinct text -> Arrow-batched Python helper once per distinct text -> join
back by its hash. Grouping, reachability over a table of edges (by doubling, with reliable checkpoints) and
reassembly are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from graderoom.functions import code as pycode
from graderoom.operators import text as T
from graderoom.session import ensure_checkpoint_dir


@F.pandas_udf(ST.BooleanType())
def _syntax_ok(s: pd.Series) -> pd.Series:
    return s.map(pycode.syntax_check)


@F.pandas_udf(ST.ArrayType(ST.BooleanType()))
def _syntax_ok_each(s: pd.Series) -> pd.Series:
    return s.map(lambda arr: [pycode.syntax_check(x) for x in arr] if arr is not None else None)


def _distinct_texts(df: DataFrame, text: str) -> DataFrame:
    """Distinct texts (no nulls) keyed by hash, spread over an explicit number of partitions: texts are small in
    bytes but expensive in Python CPU, so AQE must not coalesce them into a few tasks (an explicit
    repartition count is kept as is)."""
    spark = df.sparkSession
    n = spark.sparkContext.defaultParallelism * 2
    some = df.where(F.col(text).isNotNull())
    return some.select(F.xxhash64(text).alias("_k"), F.col(text)).dropDuplicates(["_k", text]).repartition(n, "_k")


def syntax_ok(df: DataFrame, text: str = "text", out: str = "syntax_ok") -> DataFrame:
    """Does the text parse as Python; a null text does not. Each distinct text is parsed once."""
    d = _distinct_texts(df, text).withColumn(out, _syntax_ok(F.col(text)))
    joined = df.withColumn("_k", F.xxhash64(text)).join(d, ["_k", text], "left").drop("_k")
    return joined.withColumn(out, F.coalesce(out, F.lit(False)))


def longest_code_block(df: DataFrame, text: str = "text", out: str = "block") -> DataFrame:
    """Longest parseable line range of each text (whole text, all ranges; pruned only by
    ranges that cannot beat the best found); null for a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_k": b["_k"], text: b[text], out: b[text].map(pycode.longest_block)})

    d = _distinct_texts(df, text).mapInPandas(run, f"_k long, {text} string, {out} string")
    return df.withColumn("_k", F.xxhash64(text)).join(d, ["_k", text], "left").drop("_k")


DEF_SCHEMA = "_k long, seq int, kind string, name string, deps array<string>, src string"


def definition_table(df: DataFrame, code: str = "code") -> DataFrame:
    """Top-level imports / classes / functions / assignments of each distinct code text, keyed by
    the text hash ``_k``. Functions without a return statement have kind 'function_noreturn'."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, src in zip(b["_k"], b[code]):
                for seq, kind, name, deps, seg in pycode.definitions(src or ""):
                    rows.append((k, seq, kind, name, deps, seg))
            yield pd.DataFrame(rows, columns=["_k", "seq", "kind", "name", "deps", "src"])

    return _distinct_texts(df, code).mapInPandas(run, DEF_SCHEMA)


def first_definitions(defs: DataFrame) -> DataFrame:
    """First definition of a name wins across kinds; functions without return never count."""
    named = defs.where(F.col("kind").isin("class", "function", "variable"))
    w = Window.partitionBy("_k", "name").orderBy("seq")
    return named.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dependency_closure(edges: DataFrame, roots: DataFrame, key: Sequence[str] = (),
                       max_rounds: int | None = None) -> DataFrame:
    """All (key..., root, node) with node reachable from root (root itself included).

    By doubling: after k rounds everything less than 2^k edges away is found, and ``hops`` holds the pairs joined by
    a walk of 2^k edges. A round extends what is found by these walks and joins the walks to themselves, so a chain
    of n nodes takes log2(n) rounds, one join and one checkpoint of each table a round. A walk from a root to a node
    already found from it is longer than its shortest path and is left out; where every node is a root, all walks
    together are no more rows than the result. Null ends are no edges. Cycle-safe. Rounds go on until nothing new is
    found; with ``max_rounds`` a closure not seen complete raises instead of being returned."""
    key = list(key)
    ensure_checkpoint_dir(edges.sparkSession)
    hops = edges.select(*key, F.col("src").alias("node"), "dst").where(F.col("node") != F.col("dst")).distinct()
    if key:
        hops = hops.join(roots.select(*key).distinct(), key, "left_semi")
    hops = hops.checkpoint()
    found = roots.select(*key, "root", F.col("root").alias("node")).distinct().checkpoint()
    for rnd in count(1):
        step = found.join(hops, [*key, "node"]).select(*key, "root", F.col("dst").alias("node")).distinct()
        new = step.join(found, [*key, "root", "node"], "left_anti").checkpoint()
        if new.isEmpty():
            return found
        if max_rounds is not None and rnd >= max_rounds:
            raise RuntimeError(f"closure not complete after {max_rounds} rounds")
        found = found.unionByName(new)
        known = found.select(*key, F.col("root").alias("node"), F.col("node").alias("dst"))
        firsts = hops.select(*key, F.col("node").alias("src"), F.col("dst").alias("node"))
        walks = firsts.join(hops, [*key, "node"]).select(*key, F.col("src").alias("node"), "dst")
        hops = walks.where(F.col("node") != F.col("dst")).distinct().join(
            known, [*key, "node", "dst"], "left_anti").checkpoint()


CLEAN_SCHEMA = "_k string, _block string, _defs array<struct<seq:int,kind:string,name:string,deps:array<string>,src:string>>"


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ("seq", "kind", "name", "deps", "src")
    for b in batches:
        blocks = b["_text"].map(pycode.longest_block)
        defs = blocks.map(lambda block: [dict(zip(names, d)) for d in pycode.definitions(block)])
        yield pd.DataFrame({"_k": b["_k"], "_block": blocks, "_defs": defs})


@F.pandas_udf(ST.ArrayType(ST.IntegerType()))
def _needed(names: pd.Series, deps: pd.Series, entry: pd.Series) -> pd.Series:
    return pd.Series([pycode.needed(n, d, e) for n, d, e in zip(names, deps, entry)])


def clean_code(df: DataFrame, text: str = "text", entry: str = "entry_point", out: str = "clean") -> DataFrame:
    """Imports plus definitions reachable from the entry point, in source order (imports first);
    falls back to the longest parseable block when that is empty or no entry point is given. A null text stays null.

    Each distinct text is parsed once and known by its md5 from then on. The definitions of one text are one row, so
    what its entry point reaches is found within the row."""
    keyed = df.withColumn("_k", F.md5(F.col(text).cast("string")))
    n = df.sparkSession.sparkContext.defaultParallelism * 2
    texts = keyed.where("_k is not null").select("_k", F.col(text).alias("_text")).dropDuplicates(["_k"]).repartition(n, "_k")
    asked = keyed.where("_k is not null").select("_k", F.col(entry).alias("_entry")).distinct()
    parsed = texts.mapInPandas(_parsed, CLEAN_SCHEMA).join(asked, "_k")
    named = F.filter("_defs", lambda d: d["kind"].isin("class", "function", "variable"))
    first = parsed.withColumn("_named", named).withColumn(
        "_kept", _needed(F.col("_named.name"), F.col("_named.deps"), F.col("_entry")))
    imports = F.transform(F.filter("_defs", lambda d: d["kind"] == "import"), lambda d: d["src"])
    reached = F.transform("_kept", lambda i: F.get("_named", i)["src"])
    whole = T.py_strip(F.array_join(F.concat(imports, reached), "\n"))
    done = first.select("_k", "_entry", F.when(F.col("_entry").isNull() | (whole == ""), F.col("_block")).otherwise(whole).alias("_clean"))
    res = keyed.alias("a").join(done.alias("b"), (F.col("a._k") == F.col("b._k")) & F.col(f"a.{entry}").eqNullSafe(F.col("b._entry")), "left")
    return res.select("a.*", F.col("b._clean").alias(out)).drop("_k")


def clean_samples(samples: DataFrame, problems: DataFrame, only_task: str | None = None, text: str = "solution") -> DataFrame:
    """The corpus job: samples of known tasks (``only_task``: of that one) with their code cleaned for the task's
    entry point. The code is ``solution``, else the prompt, a line end and ``completion``. All columns of the samples
    stay, with ``solution`` the cleaned code and ``changed`` telling whether that differs from the code. Samples of
    unknown tasks are those of ``relational.quarantine_unknown_tasks``."""
    known = samples if only_task is None else samples.where(F.col("task_id") == only_task)
    asked = problems.select("task_id", F.col("entry_point").alias("_entry_point"), F.col("prompt").alias("_prompt"))
    code = F.coalesce(F.col(text), F.concat(F.col("_prompt"), F.lit("\n"), F.col("completion")))
    joined = known.join(asked, "task_id").withColumn("_code", code)
    cleaned = clean_code(joined, "_code", "_entry_point", "_cleaned")
    columns = [F.col("_cleaned").alias(text) if c == text else F.col(c) for c in samples.columns]
    return cleaned.select(*columns, (~F.col("_cleaned").eqNullSafe(F.col("_code"))).alias("changed"))


def clean_stats(cleaned: DataFrame) -> DataFrame:
    """How many samples ``clean_samples`` changed, of how many."""
    return cleaned.agg(F.count_if("changed").alias("n_changed"), F.count(F.lit(1)).alias("n_total"))


@F.pandas_udf(ST.BooleanType())
def _is_literal(s: pd.Series) -> pd.Series:
    return s.map(pycode.literal_check)


def fenced_literals(df: DataFrame, text: str = "text", out: str = "literal") -> DataFrame:
    """One row per line of the first fence that is a list of Python literals once its comment is cut and brackets
    are put around it: numbers, strings, tuples, lists, sets, dicts, True, False, None."""
    n = df.sparkSession.sparkContext.defaultParallelism * 2
    spread = df.repartition(n)  # whole texts: their lines are cut on all cores, and fewer rows are shuffled
    lines = spread.withColumn("_line", F.explode(T.fenced_literal_lines(text)))
    found = lines.withColumn(out, F.concat(F.lit("["), "_line", F.lit("]"))).drop("_line")
    return found.where(_is_literal(F.col(out)))


# ---------------------------------------------------------------- legacy cleaner

LEGACY_EXCEPTIONS = ["def ", "import ", "from "]
LEGACY_TRIM_TAILS = ['"""', "if", "print"]


def legacy_clean_code(df: DataFrame, text: str = "text", entry: str = "entry_point",
                      rm_prefix: str | None = None, eofs: Sequence[str] = (), out: str = "clean") -> DataFrame:
    """The older line-based cleaner: chunk selection, def bodies with a return, indentation fix,
    end markers, unindented-line removal, then helper functions that do not parse are dropped."""
    code = F.col(text)
    if rm_prefix is not None:
        code = T.strip_prefix_lines(code, rm_prefix)
    d = df.withColumn("_chunk", T.select_chunk(code, F.col(entry)))
    split_re = F.concat(F.lit("def "), F.col(entry), F.lit(r"\s*\("))
    d = d.withColumn("_chunks", F.call_function("split", F.col("_chunk"), split_re, F.lit(-1)))
    def_left = F.concat(F.lit("def "), F.col(entry), F.lit("("))
    bodies = F.filter(F.slice("_chunks", 2, F.size("_chunks")),
                      lambda ch: F.split(ch, "\ndef", -1).getItem(0).contains("    return "))
    d = d.withColumn("_bodies", bodies)
    joined = F.when(F.size("_bodies") > 0, F.concat(def_left, F.call_function("array_join", F.col("_bodies"), def_left))) \
        .otherwise(F.lit(""))
    d = d.withColumn("_step", T.cut_eofs(T.fix_indent(joined), list(eofs)))
    d = T.drop_unindented(d, "_step", "_step2", def_left, LEGACY_EXCEPTIONS, LEGACY_TRIM_TAILS)
    d = d.withColumn("_parts", F.split(F.concat(F.element_at("_chunks", 1), F.col("_step2")), "\ndef ", -1))
    fns = F.slice(F.col("_parts"), 2, F.size("_parts"))
    d = d.withColumn("_fn_ok", _syntax_ok_each(F.transform(fns, lambda f: F.concat(F.lit("\ndef "), f))))
    keep = F.filter(F.arrays_zip(fns.alias("f"), F.col("_fn_ok").alias("ok")),
                    lambda z: T.py_strip(z["f"]).startswith(F.concat(F.col(entry), F.lit(" ")))
                    | T.py_strip(z["f"]).startswith(F.concat(F.col(entry), F.lit("(")))
                    | z["ok"])
    rebuilt = F.array_join(F.concat(F.slice(F.col("_parts"), 1, 1), F.transform(keep, lambda z: z["f"])), "\ndef ")
    d = d.drop("_chunk", "_chunks", "_bodies", "_step", "_step2")
    return d.withColumn(out, T.py_strip(rebuilt)).drop("_parts", "_fn_ok")
