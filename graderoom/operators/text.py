"""String and code-text jobs expressed with built-in column functions (JVM-side, codegen).

Every function works on whole texts; line-level logic uses array higher-order functions on the
row's own line array, so no text is exploded across a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Generation stop strings.
BASE_STOPS = ["<|endoftext|>", "<|endofmask|>", "</s>", "\nif __name__", "\ndef main(", "\nprint("]
DIRECT_COMPLETION_STOPS = {
    "humaneval": ["\ndef ", "\nclass ", "\nimport ", "\nfrom ", "\nassert "],
    "mbpp": ['\n"""', "\nassert"],
}
CHAT_STOPS = ["\n```\n"]
MAX_OUTPUT_CHARS = 10_000

# Prompt prefixes.
INSTRUCTION_PREFIX = {
    "instruct": "Please provide a self-contained Python script that solves the following problem in a markdown code block:",
    "perf-instruct": "Please provide an efficient and self-contained Python script that solves the following problem in a markdown code block:",
    "perf-CoT": "Think step by step: please provide an efficient and self-contained Python script that solves the following problem in a markdown code block:",
}
RESPONSE_PREFIX = {
    "instruct": "Below is a Python script with a self-contained function that solves the problem and passes corresponding tests:",
    "perf-instruct": "Below is a Python script with a self-contained function that efficiently solves the problem and passes corresponding tests:",
    "perf-CoT": "Below is a Python script with a self-contained function that efficiently solves the problem and passes corresponding tests:",
    "refine": "Below is a refined and improved final Python script with a self-contained function that solves the problem and passes corresponding tests:",
}

# Fixed value: terminal escape sequences.
ANSI_ESCAPE = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"

# Fixed value: the characters that str.strip, str.split and the class of blanks in Python's patterns take.
BLANK = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Fixed value: the same characters one by one.
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")


def py_strip(x: str | Column) -> Column:
    return F.btrim(c(x), F.lit(BLANKS))


# Fixed value: the line ends of str.splitlines besides "\n" and "\r\n".
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def py_lines(x: str | Column) -> Column:
    """str.splitlines(): no trailing empty line, empty text -> []. Most texts have no line end but "\\n"; a search for
    the others is much cheaper than a pattern over every text."""
    x = c(x)
    others = reduce(or_, [x.contains(e) for e in LINE_ENDS])
    one_end = F.when(others, F.regexp_replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), f"[{LINE_ENDS}]", "\n")).otherwise(x)
    return F.when(x == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(one_end, r"\n\z", ""), "\n", -1))


def lspace(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, rf"^{BLANK}+", ""))


# ---------------------------------------------------------------- cleaning


def strip_ansi(x: str | Column) -> Column:
    return F.regexp_replace(c(x), ANSI_ESCAPE, "")


def truncate_at_stop(x: str | Column, stops: Sequence[str], cap: int = MAX_OUTPUT_CHARS) -> Column:
    """Cut at the earliest stop string (at most ``cap`` characters), then tabs -> 4 spaces."""
    x = c(x)
    pos = [F.when(F.instr(x, s) > 0, F.instr(x, s) - 1) for s in stops]
    cut = F.least(F.lit(cap), *pos) if pos else F.lit(cap)
    return F.replace(F.substring(x, 1, cut), F.lit("\t"), F.lit("    "))


def stop_table(spark) -> DataFrame:
    """(dataset, mode, stop): base stops plus direct-completion or chat extras. Literal, bounded."""
    rows = []
    for ds, extra in DIRECT_COMPLETION_STOPS.items():
        rows += [(ds, "direct", s) for s in BASE_STOPS + extra]
        rows += [(ds, "chat", s) for s in BASE_STOPS + CHAT_STOPS]
    return F.broadcast(spark.createDataFrame(rows, "dataset string, mode string, stop string"))


def build_prompt(prompt: str | Column, mode: str) -> Column:
    """Direct completion: stripped prompt + newline. Chat modes: instruction, fenced problem,
    response prefix and an opened python fence (the plain form of the chat turn)."""
    body = py_strip(prompt)
    if mode == "direct":
        return F.concat(body, F.lit("\n"))
    return F.concat(F.lit(INSTRUCTION_PREFIX[mode] + "\n```\n"), body,
                    F.lit("\n```\n" + RESPONSE_PREFIX[mode] + "\n```python\n"))


def build_refinement_prompt(problem: str | Column, previous: str | Column, instruction: str) -> Column:
    """Plain refinement prompt: instruction, fenced problem, fenced previous solution, then the
    response prefix and an opened python fence."""
    return F.concat(
        F.lit(instruction + "\nProblem Description:\n```\n"), py_strip(problem),
        F.lit("\n```\n\nPrevious Solution:\n```python\n"), py_strip(previous),
        F.lit("\n```\n\n" + RESPONSE_PREFIX["refine"] + "\n```python\n"),
    )


def assemble_solution(prompt: str | Column, impl: str | Column, direct: Column) -> Column:
    return F.when(direct, F.concat(c(prompt), c(impl))).otherwise(c(impl))


def extract_fenced_block(x: str | Column) -> Column:
    """Body of the first ```python / ```python3 fence up to the next closing fence, stripped;
    null when the text has no fence. (Syntax validity is a separate check, see ``syntax_ok``.)"""
    x = c(x)
    parts = F.split(x, r"\n```python3?\n", -1)
    body = F.split(parts.getItem(1), "\n```", -1).getItem(0)
    return F.when(F.instr(x, "\n```") == 0, F.lit(None)).when(F.size(parts) < 2, F.lit(None)).otherwise(py_strip(body))


def fenced_literal_lines(x: str | Column) -> Column:
    """Lines of the first ``` fence with comments cut, blank ones dropped (as an array)."""
    x = c(x)
    inner = F.split(x, "```", -1).getItem(1)
    cleaned = F.transform(py_lines(inner), lambda l: py_strip(F.split(l, "#", -1).getItem(0)))
    return F.filter(cleaned, lambda l: l != "")


def normalize_for_dedup(x: str | Column) -> Column:
    """Drop blank lines and lines starting with '#'."""
    keep = F.filter(py_lines(x), lambda l: (py_strip(l) != "") & ~l.startswith("#"))
    return F.array_join(keep, "\n")


# ---------------------------------------------------------------- legacy cleaner pieces


def strip_prefix_lines(x: str | Column, prefix: str) -> Column:
    return F.array_join(F.filter(py_lines(x), lambda l: ~l.startswith(prefix)), "\n")


def select_chunk(x: str | Column, entry_point: str | Column) -> Column:
    """First fenced chunk that contains 'def <entry_point>', else the whole text (with a leading newline)."""
    text = F.replace(F.concat(F.lit("\n"), c(x)), F.lit("\n```python\n"), F.lit("\n```\n"))
    chunks = F.split(text, "\n```\n", -1)
    target = F.concat(F.lit("def "), c(entry_point))
    hit = F.filter(chunks, lambda ch: ch.contains(target))
    return F.coalesce(F.element_at(hit, 1), text)


def cut_eofs(x: str | Column, eofs: Sequence[str]) -> Column:
    """Cut at each end marker in turn (text before its first occurrence)."""
    out = c(x)
    for e in eofs:
        out = F.substring_index(out, e, 1)
    return out


def fix_indent(x: str | Column) -> Column:
    """Lines indented by exactly 3 spaces get one more; every line ends with a newline."""
    lines = F.transform(py_lines(x), lambda l: F.when(lspace(l) == 3, F.concat(F.lit(" "), l)).otherwise(l))
    return F.when(F.size(lines) == 0, F.lit("")).otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))


def drop_unindented(df: DataFrame, src: str, out: str, protect_before: str | Column, exceptions: Sequence[str],
                    trim_tails: Sequence[str]) -> DataFrame:
    """Drop unindented lines (except the first line starting with ``protect_before``, blank lines and
    lines starting with an exception prefix); the first checked line starting with a tail marker cuts
    everything from there on. Intermediate arrays are real columns so each is computed once."""
    prot = protect_before if isinstance(protect_before, Column) else F.lit(protect_before)
    d = df.withColumn("_lines", py_lines(src))
    d = d.withColumn("_fp", F.array_position(F.transform("_lines", lambda l: l.startswith(prot)), True))

    def flags(l, i):
        exc = F.lit(False)
        for e in exceptions:
            exc = exc | l.startswith(e)
        checked = (i != F.col("_fp")) & (py_strip(l) != "") & ~exc
        tail = F.lit(False)
        for t in trim_tails:
            tail = tail | F.regexp_replace(l, r"\s+\z", "").startswith(t)
        return F.struct(l.alias("l"), i.alias("i"), (checked & (lspace(l) == 0)).alias("cut"), (checked & tail).alias("tail"))

    d = d.withColumn("_f", F.transform("_lines", lambda l, i: flags(l, i + 1)))
    d = d.withColumn("_ft", F.array_position(F.transform("_f", lambda f: f["tail"]), True))
    kept = F.filter("_f", lambda f: ~f["cut"] & ((F.col("_ft") == 0) | (f["i"] < F.col("_ft"))))
    res = F.when(F.size("_lines") == 0, F.lit("")).otherwise(F.array_join(F.transform(kept, lambda f: f["l"]), "\n"))
    return d.withColumn(out, res).drop("_lines", "_fp", "_f", "_ft")


def insert_contract(code: str | Column, entry_point: str | Column, contract: str | Column) -> Column:
    """Insert contract lines after the 'def <entry_point>' line, re-aligning indentation between the
    function body and the contract; blank lines are dropped. Null when the def line is missing."""
    code = F.replace(c(code), F.lit("\t"), F.lit("    "))
    contract = F.replace(c(contract), F.lit("\t"), F.lit("    "))
    lines = F.filter(F.split(code, "\n", -1), lambda l: py_strip(l) != "")
    def_pos = F.array_position(F.transform(lines, lambda l: l.startswith(F.concat(F.lit("def "), c(entry_point)))), True)
    def_line = F.element_at(lines, def_pos.cast("int"))
    # body indentation: the spaces right before the first non-blank character after the def line
    after = F.call_function("substr", code, F.call_function("instr", code, def_line) + F.length(def_line))
    src_indent = F.length(F.regexp_extract(F.regexp_extract(after, r"^(\s*)", 1), r"( *)$", 1))
    con_indent = F.length(F.regexp_extract(F.regexp_extract(contract, r"^(\s*)", 1), r"( *)$", 1))
    pad_c = F.repeat(F.lit(" "), F.greatest(F.lit(0), src_indent - con_indent))
    pad_s = F.repeat(F.lit(" "), F.greatest(F.lit(0), con_indent - src_indent))
    head = F.slice(lines, 1, def_pos.cast("int"))
    cons = F.transform(F.filter(F.split(contract, "\n", -1), lambda l: l != ""), lambda l: F.concat(pad_c, l))
    tail = F.transform(F.slice(lines, (def_pos + 1).cast("int"), F.size(lines)), lambda l: F.concat(pad_s, l))
    return F.when(def_pos > 0, F.array_join(F.concat(head, cons, tail), "\n"))


# ---------------------------------------------------------------- repetition / unicode


# Fixed value: styling characters that separate words.
STYLE_CHARS = "-_#~|─┼\r\n"


def spaced(x: str | Column) -> Column:
    """The text with every blank and styling character as one space."""
    blanks = STYLE_CHARS + BLANKS
    return F.translate(c(x), blanks, " " * len(blanks))


def unique_word_ratio(x: str | Column) -> Column:
    """Styling characters to spaces, collapse whitespace, strip; distinct tokens / tokens."""
    t = spaced(x)
    toks = F.split(F.btrim(F.regexp_replace(t, "  +", " "), F.lit(" ")), " ", -1)
    return F.size(F.array_distinct(toks)) / F.size(toks)


REPETITION_WINDOW = 6000
REPETITION_RATIO = 0.15
REPETITION_STRIKES = 2


def repetition_cut(x: str | Column, window: int = REPETITION_WINDOW, ratio: float = REPETITION_RATIO) -> Column:
    """Character offset where a response is cancelled: end of the second consecutive full window whose
    unique-word ratio is below ``ratio``; null when never."""
    x = c(x)
    nw = F.floor(F.length(x) / window).cast("int")
    idx = F.sequence(F.lit(0), nw - 1)
    low = F.transform(idx, lambda i: unique_word_ratio(F.substring(x, i * window + 1, window)) < ratio)
    hit = F.transform(idx, lambda i: (i > 0) & F.element_at(low, i + 1) & F.element_at(low, F.greatest(i, F.lit(1))))
    first = F.array_position(hit, True)
    return F.when(nw > 1, F.when(first > 0, first * window))


def escape_unicode(x: str | Column) -> Column:
    """unicode-escape encoding (control and non-ASCII characters as backslash escapes), then every
    doubled backslash collapsed to one."""
    chars = F.split(c(x), "", -1)

    def esc(ch):
        cp = F.ascii(ch)
        return (F.when(ch == "\t", F.lit("\\t")).when(ch == "\n", F.lit("\\n")).when(ch == "\r", F.lit("\\r"))
                .when(ch == "\\", F.lit("\\\\"))
                .when((cp < 32) | (cp == 127) | ((cp >= 128) & (cp < 256)), F.format_string("\\x%02x", cp))
                .when((cp >= 256) & (cp < 65536), F.format_string("\\u%04x", cp))
                .when(cp >= 65536, F.format_string("\\U%08x", cp))
                .otherwise(ch))

    return F.replace(F.array_join(F.transform(chars, esc), ""), F.lit("\\\\"), F.lit("\\"))
