"""Registered queries: string and code-text jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from graderoom.fixtures import Inputs, cte
from graderoom.functions.exprs import r6
from graderoom.operators import code as C
from graderoom.operators import text as T
from graderoom.registry import register


def q(s: str) -> str:
    """A DuckDB string expression for a Python string (newlines and tabs via chr)."""
    parts = []
    for chunk in s.split("\n"):
        sub = [("'" + p.replace("'", "''") + "'") for p in chunk.split("\t")]
        parts.append(" || chr(9) || ".join(sub))
    return "(" + " || chr(10) || ".join(parts) + ")"


_ENDS = " || ".join(f"chr({ord(e)})" for e in T.LINE_ENDS)
_ONE_END = f"translate(replace({{x}}, chr(13) || chr(10), chr(10)), {_ENDS}, repeat(chr(10), {len(T.LINE_ENDS)}))"
PY_LINES = f"(case when {{x}} = '' then [] else string_split(regexp_replace({_ONE_END}, '\\n$', ''), chr(10)) end)"
PY_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def lines_sql(x: str) -> str:
    return PY_LINES.format(x=x)


def strip_sql(x: str) -> str:
    return PY_STRIP.format(x=x)


def code_texts(x: Inputs):
    return x.v("f6_code")


def blocks(x: Inputs):
    return code_texts(x).select("text_id", "entry_point", T.extract_fenced_block("text").alias("block"))


_BLOCK_SQL = cte("f6_code") + f""",
b as (select text_id, entry_point, case when instr(text, chr(10) || '```') = 0 then null
             when len(string_split_regex(text, '\\n```python3?\\n')) < 2 then null
             else {strip_sql("split_part(string_split_regex(text, '\\n```python3?\\n')[2], chr(10) || '```', 1)")} end as block
      from f6_code)
"""

STOPS = T.BASE_STOPS + T.DIRECT_COMPLETION_STOPS["humaneval"]


@register("strip_ansi", cte("f6_code") + """
select text_id, regexp_replace(text, '\\x1B(?:[@-Z\\\\-_]|\\[[0-?]*[ -/]*[@-~])', '', 'g') as text from f6_code""")
def q_strip_ansi(spark, sf_dir):
    return code_texts(Inputs(spark, sf_dir)).select("text_id", T.strip_ansi("text").alias("text"))


@register("truncate_at_stop", "with t as (select doc_id, replace(substring(text, 1, least(10000, "
          + ", ".join(f"case when instr(text, {q(s)}) > 0 then instr(text, {q(s)}) - 1 end" for s in STOPS)
          + ")), chr(9), '    ') as out from documents)\n"
          "select doc_id, length(out) as n_chars_out, md5(out) as out_md5 from t")
def q_truncate_at_stop(spark, sf_dir):
    d = Inputs(spark, sf_dir).t("documents")
    out = T.truncate_at_stop("text", STOPS)
    return d.select("doc_id", F.length(out).cast("bigint").alias("n_chars_out"), F.md5(out).alias("out_md5"))


def _stop_values() -> str:
    rows = []
    for ds, extra in T.DIRECT_COMPLETION_STOPS.items():
        rows += [(ds, "direct", s) for s in T.BASE_STOPS + extra]
        rows += [(ds, "chat", s) for s in T.BASE_STOPS + T.CHAT_STOPS]
    return ", ".join(f"('{a}', '{b}', {q(s)})" for a, b, s in rows)


@register("stop_vocabulary", cte("problems_catalog") + f""",
st as (select * from (values {_stop_values()}) t(dataset, mode, stop)),
p as (select task_id, case when cast(split_part(task_id, '/', 2) as integer) % 2 = 0 then 'humaneval' else 'mbpp' end as dataset
      from problems_catalog)
select p.task_id, st.mode, count(*) as n_stops, string_agg(st.stop, '|' order by st.stop) as stops
from p join st using (dataset) group by p.task_id, st.mode""")
def q_stop_vocabulary(spark, sf_dir):
    p = Inputs(spark, sf_dir).v("problems_catalog").select(
        "task_id", F.when(F.split("task_id", "/").getItem(1).cast("int") % 2 == 0, "humaneval")
        .otherwise("mbpp").alias("dataset"))
    j = p.join(T.stop_table(spark), "dataset")
    return j.groupBy("task_id", "mode").agg(
        F.count(F.lit(1)).alias("n_stops"), F.array_join(F.array_sort(F.collect_list("stop")), "|").alias("stops"))


def _prompt_sql(mode: str, x: str) -> str:
    if mode == "direct":
        return f"({strip_sql(x)} || chr(10))"
    return (f"({q(T.INSTRUCTION_PREFIX[mode] + chr(10) + '```' + chr(10))} || {strip_sql(x)} || "
            f"{q(chr(10) + '```' + chr(10) + T.RESPONSE_PREFIX[mode] + chr(10) + '```python' + chr(10))})")


@register("build_prompt", cte("problems_catalog") + f"""
select task_id, md5({_prompt_sql('direct', 'prompt')}) as direct_md5, md5({_prompt_sql('instruct', 'prompt')}) as instruct_md5,
       md5({_prompt_sql('perf-instruct', 'prompt')}) as perf_instruct_md5, md5({_prompt_sql('perf-CoT', 'prompt')}) as perf_cot_md5
from problems_catalog""")
def q_build_prompt(spark, sf_dir):
    p = Inputs(spark, sf_dir).v("problems_catalog")
    return p.select("task_id", *[F.md5(T.build_prompt("prompt", m)).alias(a) for m, a in [
        ("direct", "direct_md5"), ("instruct", "instruct_md5"), ("perf-instruct", "perf_instruct_md5"),
        ("perf-CoT", "perf_cot_md5")]])


REFINE_INSTRUCTION = "Refine the previous solution."


@register("build_refinement_prompt", cte("f3_generations") + f""",
ch as (select a.task_id, a.step, a.prompt, b.solution as previous_solution
       from f3_generations a join f3_generations b on a.task_id = b.task_id and b.step = a.step - 1)
select task_id, step, md5({q(REFINE_INSTRUCTION + chr(10) + 'Problem Description:' + chr(10) + '```' + chr(10))} || {strip_sql('prompt')}
   || {q(chr(10) + '```' + chr(10) + chr(10) + 'Previous Solution:' + chr(10) + '```python' + chr(10))} || {strip_sql('previous_solution')}
   || {q(chr(10) + '```' + chr(10) + chr(10) + T.RESPONSE_PREFIX['refine'] + chr(10) + '```python' + chr(10))}) as prompt_md5
from ch""")
def q_build_refinement_prompt(spark, sf_dir):
    from graderoom.operators.relational import chain_previous_solution
    g = Inputs(spark, sf_dir).v("f3_generations")
    ch = chain_previous_solution(g.select("task_id", "step", "prompt", "solution")).where(
        F.col("previous_solution").isNotNull())
    return ch.select("task_id", "step",
                     F.md5(T.build_refinement_prompt("prompt", "previous_solution", REFINE_INSTRUCTION)).alias("prompt_md5"))


@register("assemble_solution", cte("f3_generations") + """
select task_id, step, md5(case when step % 2 = 0 then prompt || solution else solution end) as solution_md5
from f3_generations""")
def q_assemble_solution(spark, sf_dir):
    g = Inputs(spark, sf_dir).v("f3_generations")
    return g.select("task_id", "step", F.md5(T.assemble_solution("prompt", "solution", F.col("step") % 2 == 0))
                    .alias("solution_md5"))


@register("extract_fenced_block", _BLOCK_SQL + "select text_id, block from b")
def q_extract_fenced_block(spark, sf_dir):
    return blocks(Inputs(spark, sf_dir)).select("text_id", "block")


# Lines that are lists of Python literals once in brackets, and some that are not; K is the row's number.
LITERALS = ["(K, 'a', None)", "{K: [1.5, True]}, -K", "{K, 2}", "[(1, [K]), ()]", "'it is K'", "1e5, K+2j"]
NOT_LITERALS = ["f(K)", "K +", "x", "[K, (2]", "K if K else 2"]


def literal_texts(x: Inputs):
    v = x.v("f7_values")
    seed = F.col("seed_id").cast("string")
    more = F.replace(F.lit("\n".join([a for pair in zip(LITERALS, [*NOT_LITERALS, ""]) for a in pair])), F.lit("K"), seed)
    return v.select("seed_id", F.concat(F.lit("```\n"), "value_text", F.lit(" # seed "), seed,
                                        F.lit("\nnot a literal (\n\n"), more, F.lit("\n```\n[7]")).alias("text"))


@register("parse_fenced_literals", cte("f7_values") + f"""
select seed_id, '[' || value_text || ']' as literal from f7_values where json_valid('[' || value_text || ']')
union all select seed_id, '[' || replace(unnest([{", ".join(q(t) for t in LITERALS)}]), 'K', cast(seed_id as varchar)) || ']' from f7_values""")
def q_parse_fenced_literals(spark, sf_dir):
    return C.fenced_literals(literal_texts(Inputs(spark, sf_dir))).select("seed_id", "literal")


@register("syntax_ok", cte("f6_truth") + "select text_id, not broken as syntax_ok from f6_truth")
def q_syntax_ok(spark, sf_dir):
    return C.syntax_ok(blocks(Inputs(spark, sf_dir)).where(F.col("block").isNotNull()), "block").select("text_id", "syntax_ok")


@register("longest_code_block", cte("f6_truth") + "select text_id, block from f6_truth")
def q_longest_code_block(spark, sf_dir):
    return C.longest_code_block(code_texts(Inputs(spark, sf_dir)), "text").select("text_id", "block")


@register("definition_table", cte("f6_truth") + """
select text_id, cast(unnest([0, 1, 2, 3]) as integer) as seq, unnest(['import', 'function', 'function', 'function']) as kind,
       unnest([null, 'helper', 'unused', entry_point]) as name
from f6_truth where not broken""")
def q_definition_table(spark, sf_dir):
    b = blocks(Inputs(spark, sf_dir)).where(F.col("block").isNotNull())
    defs = C.definition_table(b, "block")
    return b.select("text_id", F.xxhash64("block").alias("_k")).join(defs, "_k").select("text_id", "seq", "kind", "name")


@register("dependency_closure", cte("f8_edges").replace("with ", "with recursive ", 1) + """,
nodes as (select src as n from f8_edges union select dst from f8_edges),
reach(root, node) as (select n, n from nodes union select r.root, e.dst from reach r join f8_edges e on e.src = r.node)
select root, node from reach""")
def q_dependency_closure(spark, sf_dir):
    e = Inputs(spark, sf_dir).v("f8_edges")
    roots = e.select(F.col("src").alias("root")).union(e.select("dst")).distinct()
    return C.dependency_closure(e, roots).select("root", "node")


@register("clean_code", cte("f6_truth") + "select text_id, clean from f6_truth")
def q_clean_code(spark, sf_dir):
    t = code_texts(Inputs(spark, sf_dir))
    return C.clean_code(t, "text", "entry_point").select("text_id", "clean")


_CLEANED = cte("f6_samples", "f0_problems") + """,
known as (select s.*, p.prompt from f6_samples s join f0_problems p using (task_id)),
cleaned as (select sample_id, task_id, truth as solution, completion,
                   truth <> coalesce(solution, prompt || chr(10) || completion) as changed from known)
"""


def cleaned_samples(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return C.clean_samples(x.v("f6_samples").drop("truth"), x.v("f0_problems"))


@register("clean_samples", _CLEANED + "select sample_id, task_id, solution, completion, changed from cleaned")
def q_clean_samples(spark, sf_dir):
    """Replies as solutions or as completions, some clean already, some of an unknown task."""
    return cleaned_samples(spark, sf_dir)


@register("legacy_strip_prefix_lines", cte("f6_code") + f"""
select text_id, array_to_string(list_filter({lines_sql('text')}, lambda l: not starts_with(l, 'Hope')), chr(10)) as text
from f6_code""")
def q_legacy_strip_prefix(spark, sf_dir):
    t = code_texts(Inputs(spark, sf_dir))
    return t.select("text_id", T.strip_prefix_lines("text", "Hope").alias("text"))


@register("legacy_select_chunk", cte("f6_code") + """,
t as (select text_id, entry_point, replace(chr(10) || text, chr(10) || '```python' || chr(10), chr(10) || '```' || chr(10)) as t from f6_code),
c as (select text_id, t, list_filter(string_split(t, chr(10) || '```' || chr(10)), lambda ch: contains(ch, 'def ' || entry_point)) as hits from t)
select text_id, coalesce(hits[1], t) as chunk from c""")
def q_legacy_select_chunk(spark, sf_dir):
    t = code_texts(Inputs(spark, sf_dir))
    return t.select("text_id", T.select_chunk("text", F.col("entry_point")).alias("chunk"))


@register("legacy_cut_eofs", cte("f6_code") + """
select text_id, split_part(split_part(text, '```', 1), 'Hope', 1) as text from f6_code""")
def q_legacy_cut_eofs(spark, sf_dir):
    t = code_texts(Inputs(spark, sf_dir))
    return t.select("text_id", T.cut_eofs("text", ["```", "Hope"]).alias("text"))


_FIX_SQL = f"""(case when len({lines_sql('{x}')}) = 0 then '' else array_to_string(list_transform({lines_sql('{x}')},
  lambda l: case when length(l) - length(regexp_replace(l, '^\\s+', '')) = 3 then ' ' || l else l end), chr(10)) || chr(10) end)"""


def fix_sql(x: str) -> str:
    return _FIX_SQL.replace("{x}", x)


@register("legacy_fix_indent", _BLOCK_SQL + f"select text_id, {fix_sql('block')} as text from b where block is not null")
def q_legacy_fix_indent(spark, sf_dir):
    b = blocks(Inputs(spark, sf_dir)).where(F.col("block").isNotNull())
    return b.select("text_id", T.fix_indent("block").alias("text"))


@register("legacy_drop_unindented", cte("f6_code") + f""",
t as (select text_id, entry_point, {lines_sql('text')} as lines from f6_code),
f as (select *, coalesce(list_position(list_transform(lines, lambda l: starts_with(l, 'def ' || entry_point || '(')), true), 0) as fp from t),
g as (select *, list_transform(range(1, len(lines) + 1), lambda i:
        i <> fp and {strip_sql('lines[i]')} <> '' and not (starts_with(lines[i], 'def ') or starts_with(lines[i], 'import ') or starts_with(lines[i], 'from '))) as chk from f),
h as (select *, coalesce(list_position(list_transform(range(1, len(lines) + 1), lambda i: chk[i] and
        (starts_with(regexp_replace(lines[i], '\\s+$', ''), '\"\"\"') or starts_with(regexp_replace(lines[i], '\\s+$', ''), 'if')
         or starts_with(regexp_replace(lines[i], '\\s+$', ''), 'print'))), true), 0) as ft from g)
select text_id, case when len(lines) = 0 then '' else array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i:
        not (chk[i] and length(lines[i]) - length(regexp_replace(lines[i], '^\\s+', '')) = 0) and (ft = 0 or i < ft)), lambda i: lines[i]), chr(10)) end as text
from h""")
def q_legacy_drop_unindented(spark, sf_dir):
    t = code_texts(Inputs(spark, sf_dir))
    prot = F.concat(F.lit("def "), F.col("entry_point"), F.lit("("))
    d = T.drop_unindented(t, "text", "_out", prot, C.LEGACY_EXCEPTIONS, C.LEGACY_TRIM_TAILS)
    return d.select("text_id", F.col("_out").alias("text"))


@register("legacy_clean_code", cte("f6_truth") + """
select text_id, case when narrow then split_part(block, chr(10) || 'def f_', 1) else block end as clean from f6_truth""")
def q_legacy_clean_code(spark, sf_dir):
    t = code_texts(Inputs(spark, sf_dir))
    return C.legacy_clean_code(t, "text", "entry_point", rm_prefix=None, eofs=[]).select("text_id", "clean")


CONTRACT = "    assert x >= 0, \"invalid input\""


@register("insert_contract", _BLOCK_SQL + f""",
c as (select text_id, entry_point, replace(block, chr(9), '    ') as code, replace({q(CONTRACT)}, chr(9), '    ') as contract from b where block is not null),
l as (select *, list_filter(string_split(code, chr(10)), lambda x: {strip_sql('x')} <> '') as lines from c),
d as (select *, list_position(list_transform(lines, lambda x: starts_with(x, 'def ' || entry_point)), true) as dp from l),
e as (select *, lines[dp] as def_line from d),
f as (select *, substring(code, instr(code, def_line) + length(def_line)) as after from e),
g as (select *, length(regexp_extract(regexp_extract(after, '^(\\s*)', 1), '( *)$', 1)) as si,
             length(regexp_extract(regexp_extract(contract, '^(\\s*)', 1), '( *)$', 1)) as ci from f)
select text_id, case when dp is null then null else array_to_string(list_concat(lines[1:dp],
   list_transform(list_filter(string_split(contract, chr(10)), lambda x: x <> ''), lambda x: repeat(' ', greatest(0, si - ci)) || x),
   list_transform(lines[dp + 1:], lambda x: repeat(' ', greatest(0, ci - si)) || x)), chr(10)) end as text
from g""")
def q_insert_contract(spark, sf_dir):
    b = blocks(Inputs(spark, sf_dir)).where(F.col("block").isNotNull())
    return b.select("text_id", T.insert_contract("block", F.col("entry_point"), F.lit(CONTRACT)).alias("text"))


_NORM = f"array_to_string(list_filter({lines_sql('text')}, lambda l: {strip_sql('l')} <> '' and not starts_with(l, '#')), chr(10))"


@register("normalize_for_dedup", f"""
select md5({_NORM}) as norm_md5, count(*) as n_docs from documents group by 1""")
def q_normalize_for_dedup(spark, sf_dir):
    d = Inputs(spark, sf_dir).t("documents")
    return d.groupBy(F.md5(T.normalize_for_dedup("text")).alias("norm_md5")).agg(F.count(F.lit(1)).alias("n_docs"))


_ESC = """(replace(array_to_string(list_transform(string_split(text, ''), lambda ch:
  case when ch = chr(9) then '\\t' when ch = chr(10) then '\\n' when ch = chr(13) then '\\r' when ch = '\\' then '\\\\'
       when ascii(ch) < 32 or ascii(ch) = 127 or (ascii(ch) >= 128 and ascii(ch) < 256) then printf('\\x%02x', ascii(ch))
       when ascii(ch) >= 256 and ascii(ch) < 65536 then printf('\\u%04x', ascii(ch))
       when ascii(ch) >= 65536 then printf('\\U%08x', ascii(ch)) else ch end), ''), '\\\\', '\\'))"""


@register("escape_unicode", f"""
select doc_id, length({_ESC}) as n_chars_out, md5({_ESC}) as out_md5 from documents""")
def q_escape_unicode(spark, sf_dir):
    d = Inputs(spark, sf_dir).t("documents")
    e = T.escape_unicode("text")
    return d.select("doc_id", F.length(e).cast("bigint").alias("n_chars_out"), F.md5(e).alias("out_md5"))


def _ratio_sql(x: str) -> str:
    t = f"{strip_sql(chr(40) + 'regexp_replace(regexp_replace(' + x + ', ' + chr(39) + '[-_#~|─┼' + chr(92) + 'r' + chr(92) + 'n]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')' + chr(41))}"
    return f"(len(list_distinct(string_split({t}, ' '))) / len(string_split({t}, ' ')))"


@register("unique_word_ratio", f"select doc_id, round({_ratio_sql('text')}, 6) as ratio from documents")
def q_unique_word_ratio(spark, sf_dir):
    d = Inputs(spark, sf_dir).t("documents")
    return d.select("doc_id", r6(T.unique_word_ratio("text")).alias("ratio"))


@register("repetition_cutoff", f"""
with w as (select doc_id, text, cast(floor(length(text) / 6000) as integer) as nw from documents),
r as (select doc_id, nw, list_transform(range(nw), lambda i: {_ratio_sql('substring(text, i * 6000 + 1, 6000)')} < 0.15) as low from w)
select doc_id, case when nw > 1 then cast(list_position(list_transform(range(nw), lambda i: i > 0 and low[i + 1] and low[greatest(i, 1)]), true) * 6000 as bigint) end as cut_at
from r""")
def q_repetition_cutoff(spark, sf_dir):
    d = Inputs(spark, sf_dir).t("documents")
    return d.select("doc_id", T.repetition_cut("text").alias("cut_at"))


@register("clean_stats", _CLEANED + "select count(*) filter (where changed) as n_changed, count(*) as n_total from cleaned")
def q_clean_stats(spark, sf_dir):
    return C.clean_stats(cleaned_samples(spark, sf_dir))


_NORM_BLOCK = _NORM.replace("text", "block")


@register("parse_dedup_rates", _BLOCK_SQL + f""",
s as (select count(*) as n_total, count(block) as n_parsed from b),
d as (select count(*) as n_dedup from (select distinct entry_point, {_NORM_BLOCK} as nb from b where block is not null))
select n_total, n_parsed, n_dedup, round(100.0 * (n_total - n_parsed) / n_total, 6) as parse_loss_pct,
       round(100.0 * (n_parsed - n_dedup) / n_parsed, 6) as dedup_loss_pct from s, d""")
def q_parse_dedup_rates(spark, sf_dir):
    b = blocks(Inputs(spark, sf_dir))
    nb = F.when(F.col("block").isNotNull(), T.normalize_for_dedup("block"))
    s = b.agg(F.count(F.lit(1)).alias("n_total"), F.count("block").alias("n_parsed"),
              F.count_distinct(F.col("entry_point"), nb).alias("n_dedup"))
    return s.select("n_total", "n_parsed", "n_dedup",
                    r6(F.lit(100.0) * (F.col("n_total") - F.col("n_parsed")) / F.col("n_total")).alias("parse_loss_pct"),
                    r6(F.lit(100.0) * (F.col("n_parsed") - F.col("n_dedup")) / F.col("n_parsed")).alias("dedup_loss_pct"))


@register("syntax_audit", cte("f6_truth") + """
select entry_point, count(*) as n_code, count(*) filter (where block = '') as n_empty, count(*) filter (where broken) as n_not_compilable
from f6_truth group by rollup (entry_point)""")
def q_syntax_audit(spark, sf_dir):
    b = blocks(Inputs(spark, sf_dir))
    checked = C.syntax_ok(b.fillna("", ["block"]), "block")
    # per task and overall (entry_point null) in one grouping-sets aggregate
    return checked.rollup("entry_point").agg(
        F.count(F.lit(1)).alias("n_code"),
        F.count_if(T.py_strip("block") == "").alias("n_empty"),
        F.count_if(~F.col("syntax_ok")).alias("n_not_compilable"),
    )
