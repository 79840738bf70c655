"""Exact percentiles of groups of any size, without a buffer of a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graderoom.operators.ranking import running_within


def exact_percentile(df: DataFrame, keys: list[str], value: str, p: float, out: str) -> DataFrame:
    """(keys..., out): the ``p``-th percentile of ``value`` by linear interpolation between ranks.

    Values are counted first, then their counts are summed in order by ``running_within``, which spreads a hot
    group over many partitions; at most two values of a group hold the wanted ranks. Null values are
    passed over, a group without any other has null; NaN counts as the largest value. Null keys form groups."""
    rows = df.select(F.struct(*keys).alias("_k"), F.col(value).cast("double").alias("_v"))
    counts = rows.where("_v is not null").groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_within(counts, "_k", "_v", values={"_upto": F.col("_c")}, totals=True)
    position = F.lit(p) * (F.col("_upto_total") - 1)
    low, high = F.floor(position), F.ceil(position)
    at = lambda rank: F.max(F.when((rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto")), F.col("_v")))
    ends = ranked.where((low < F.col("_upto")) & (high >= F.col("_upto") - F.col("_c"))).groupBy("_k").agg(
        at(low).alias("_a"), at(high).alias("_b"), F.max(position - low).alias("_f"))
    found = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((1 - F.col("_f")) * F.col("_a") + F.col("_f") * F.col("_b"))
    groups = rows.select("_k").distinct()
    return groups.join(ends.select("_k", found.alias(out)), "_k", "left").select("_k.*", out)
