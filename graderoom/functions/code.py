"""Per-text Python helpers used inside Arrow-batched tasks (stdlib ``ast`` only).

They are small, row-local pieces: parse check, longest parseable line range, and the top-level
definition list of one text. Grouping, deduplication, reachability and reassembly are Spark jobs
(see ``graderoom.operators.code``).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence

from graderoom.operators.text import ANSI_ESCAPE

ESCAPES = re.compile(ANSI_ESCAPE)


def syntax_check(code: str | None) -> bool:
    if code is None:
        return False
    try:
        ast.parse(code)
        return True
    except (SyntaxError, MemoryError, ValueError, RecursionError):
        return False


def longest_block(text: str) -> str:
    """Longest line range i..j (j > i) that parses, measured in non-blank lines; among equally long
    ranges the first in (i, j) order wins; falls back to line 0.

    Ranges are tried longest first (for each length, i ascending, then j ascending), so the first
    range that parses is the answer and shorter ranges are never parsed. Memory stays O(lines)."""
    from bisect import bisect_left

    text = ESCAPES.sub("", text)
    lines = text.split("\n")
    n = len(lines)
    prefix = [0] * (n + 1)
    for k, line in enumerate(lines):
        prefix[k + 1] = prefix[k] + (1 if line.strip() else 0)
    total = prefix[n]
    for length in range(total, 0, -1):
        for i in range(n - 1):
            target = prefix[i] + length
            if target > total:
                break
            # j > i with prefix[j + 1] == target; prefix is non-decreasing, so these j are contiguous
            j = max(bisect_left(prefix, target) - 1, i + 1)
            while j < n and prefix[j + 1] == target:
                if syntax_check("\n".join(lines[i:j + 1])):
                    return "\n".join(lines[i:j + 1])
                j += 1
    return "\n".join(lines[0:1])


def _names(node: ast.AST) -> set[str]:
    out: set[str] = set()
    for sub in ast.walk(node):
        if isinstance(sub, ast.Name):
            out.add(sub.id)
        elif isinstance(sub, ast.Attribute):
            out.add(sub.attr)
        elif isinstance(sub, ast.arg):
            out.add(sub.arg)
        elif isinstance(sub, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.add(sub.name)
        elif isinstance(sub, ast.keyword) and sub.arg:
            out.add(sub.arg)
        elif isinstance(sub, ast.alias):
            out.add((sub.asname or sub.name).split(".")[0])
    return out


def _has_return(node: ast.AST) -> bool:
    return any(isinstance(sub, ast.Return) for sub in ast.walk(node))


def definitions(code: str) -> list[tuple[int, str, str | None, list[str], str]]:
    """Top-level items of one text: (seq, kind, name, deps, source).

    kind is import / class / function / variable; functions carry ``eligible`` semantics through
    their kind: a function without a return statement is reported as kind 'function_noreturn'.
    Unparsable code yields no rows.
    """
    try:
        tree = ast.parse(code)
    except (SyntaxError, MemoryError, ValueError, RecursionError):
        return []
    lines = code.split("\n")

    def src(node):
        seg = ast.get_source_segment(code, node)
        return seg if seg is not None else "\n".join(lines[node.lineno - 1:node.end_lineno])

    out = []
    for seq, node in enumerate(tree.body):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            out.append((seq, "import", None, [], src(node)))
        elif getattr(node, "decorator_list", None):
            continue  # decorated definitions are not plain top-level definitions
        elif isinstance(node, ast.ClassDef):
            out.append((seq, "class", node.name, sorted(_names(node)), src(node)))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            kind = "function" if _has_return(node) else "function_noreturn"
            out.append((seq, kind, node.name, sorted(_names(node)), src(node)))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            target = node.targets[0] if isinstance(node, ast.Assign) else node.target
            if isinstance(target, ast.Name):
                out.append((seq, "variable", target.id, sorted(_names(node)), src(node)))
    return out


def needed(names: Sequence[str] | None, deps: Sequence[Sequence[str]] | None, entry: str | None) -> list[int]:
    """Places of the definitions that ``entry`` reaches, itself included; the first definition of a name counts."""
    places: dict[str, int] = {}
    for at, name in enumerate([] if names is None else names):
        places.setdefault(name, at)
    seen, todo = set(), [entry]
    while todo:
        at = places.get(todo.pop())
        if at is not None and at not in seen:
            seen.add(at)
            todo.extend(deps[at])
    return sorted(seen)


def literal_check(text: str | None) -> bool:
    """Is the text a Python literal."""
    try:
        ast.literal_eval(text)
        return True
    except (SyntaxError, ValueError, TypeError, MemoryError, RecursionError):
        return False
