"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graderoom.session import scratch_path, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words end at the space and at the characters 09 to 0D; no other character separates.
BLANKS = "[\\x20\\x09-\\x0D]+"
ROW_BITS = (1 << 33) - 1
#: Stands for a null key where numpy holds keys (it has no null integer).
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and fixes what was computed."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables of this library's scratch folders that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            if "/graderoom-" in folder:
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def with_global_index(df: DataFrame, order: list[str], name: str, label: str) -> DataFrame:
    """Number all rows 0, 1, 2, ... in the order of ``order`` without a one-task window.

    Rows are dealt into ranges of the order and sorted there; each range counts its rows, and the
    small table of counts (one row per partition) gives the first number of each range. Rows equal
    in all of ``order`` are interchangeable. The sorted rows are written once, so that a lost
    executor cannot change numbers already given.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)))
    )
    kept = materialise(ranged, label)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        kept.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
        .select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    return (
        kept.join(F.broadcast(firsts), "_pid")  # one row per partition of the shuffle
        .withColumn(name, F.col("_first") + F.col("_row"))
        .drop("_pid", "_row", "_first")
    )


def small_side(df: DataFrame, rows: int = 100_000, values: Column | None = None) -> DataFrame:
    """Broadcast a join side only if it has been counted and has at most ``rows`` rows.

    Where rows hold arrays, ``values`` is their number of values in a row, and ten times ``rows`` of them are
    allowed at most. Beyond a bound the side is left to a shuffled join, whose skewed partitions AQE splits.
    """
    if df.limit(rows + 1).count() > rows:
        return df
    if values is not None and (df.agg(F.sum(values)).first()[0] or 0) > 10 * rows:
        return df
    return F.broadcast(df)
