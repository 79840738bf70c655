"""Reusable column expressions (JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: str | Column) -> Column:
    """Round a float result to 6 decimals so both engines print the same digits."""
    return F.round(col(c).cast("double"), 6)


def pass_at_k_expr(n: str | Column, c: str | Column, k: str | Column) -> Column:
    """Unbiased pass@k = 1 - C(n-c, k) / C(n, k); 1.0 when n - c < k.

    The ratio is a product of k factors (n-c-j)/(n-j), j = 0..k-1, so the work is bounded by k,
    never by the number of samples.
    """
    n, c, k = col(n).cast("double"), col(c).cast("double"), col(k)
    prod = F.aggregate(
        F.sequence(F.lit(0), k.cast("int") - 1),
        F.lit(1.0),
        lambda acc, j: acc * (n - c - j) / (n - j),
    )
    return F.when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - prod)


def split_lines(text: str | Column) -> Column:
    return F.split(col(text), "\n", -1)


def join_lines(arr: Column) -> Column:
    return F.array_join(arr, "\n")
