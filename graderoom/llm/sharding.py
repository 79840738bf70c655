"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graderoom.llm.common import small_side, with_global_index

SHARDS = 16
SEED = 5


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """Deal all rows into ``shards`` runs of one proportional interleaving of the sources.

    Rows are shuffled within their source by a seeded hash and ranked; a row's fractional rank is
    (rank + 0.5) / rows of its source. Sorting all rows by it spreads every source evenly over the
    order, and cutting the order into ``shards`` equal runs gives every shard the mixture of the
    whole. Row counts of shards differ by one at most (law ``rows``).

    Returns the key, source, size (UTF-8 bytes plus 1), text_crc32, shard and slot (the place in
    the shard, from 0). A null text is empty; a null source is a source of its own; rows that
    repeat a key are each dealt; empty tables give an empty table. Both rankings are distributed:
    a source with a third of all rows spans many sorted ranges.
    """
    slim = docs.select(
        F.col(key),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("_group"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(key)).alias("_h"),
    )
    ranked = with_global_index(slim, ["_group", "_h", key, "text_crc32"], "_at", "shard-strata")
    groups = ranked.groupBy("_group").agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_rows"))
    fraction = (F.col("_at") - F.col("_start") + 0.5) / F.col("_rows")
    spread = ranked.join(small_side(groups), "_group").withColumn("_fraction", fraction).drop("_at", "_start", "_rows", "_group")
    placed = with_global_index(spread, ["_fraction", "_h", key, "text_crc32"], "_at", "shard-order")
    rows = placed.agg(F.count(F.lit(1))).scalar()
    return (
        placed.withColumn("_total", rows)
        .withColumn("shard", F.expr(f"cast(_at * {shards} div _total as int)"))
        .withColumn("slot", F.expr(f"_at - (shard * _total + {shards - 1}) div {shards}"))
        .drop("_at", "_total", "_fraction", "_h")
    )
