"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graderoom.llm.common import materialise, small_side

TEMPERATURE = 0.7
SEED = 20


def _uniform(*parts: Column | str) -> Column:
    """52 bits of an md5 as a number strictly between 0 and 1."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("null")) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, targets: DataFrame | None = None, temperature: float = TEMPERATURE,
                 total: int | None = None) -> DataFrame:
    """Mean repetitions of a document per source: columns _source, _n, _rate.

    ``targets`` (source, weight) states the wanted shares of rows; sources it does not name get
    none. Without it the share is proportional to ``n ** temperature``. ``total`` is the wanted
    number of rows, by default as many as there are. A null source counts as the source ''.
    """
    sizes = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    if targets is None:
        sizes = sizes.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(float(temperature))))
    else:
        wanted = targets.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("_source")).agg(
            F.sum(F.col("weight").cast("double")).alias("_w"))
        sizes = sizes.join(wanted, "_source", "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    sums = sizes.agg(F.struct(F.sum("_w").alias("w"), F.sum("_n").alias("n")).alias("s")).scalar()
    rows = F.lit(total) if total is not None else sums["n"]
    return sizes.select("_source", "_n", (F.col("_w") / sums["w"] * rows / F.col("_n")).alias("_rate"))


def poisson_cdf(rate: Column) -> Column:
    """Array of P(X <= k), k = 0, 1, ..., far into the tail of a Poisson distribution."""
    last = F.ceil(rate + F.sqrt(rate) * 10 + 20).cast("int")
    start = F.struct(F.lit(0.0).alias("fact"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        fact = F.when(k == 0, F.lit(0.0)).otherwise(acc["fact"] + F.log(F.greatest(k, F.lit(1)).cast("double")))
        upto = acc["sum"] + F.exp(k.cast("double") * F.log(rate) - rate - fact)
        return F.struct(fact.alias("fact"), upto.alias("sum"), F.concat(acc["cdf"], F.array(upto)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(0), last), start, step, lambda acc: acc["cdf"])


def _repeated(docs: DataFrame, targets: DataFrame | None, temperature: float, total: int | None, seed: int,
              key: str) -> DataFrame:
    """_row (the document), n_copies, copy and shuffle_key of every copy, in the shuffled order."""
    rates = source_rates(docs, targets, temperature, total).where("_rate > 0")
    rates = materialise(rates.select("_source", poisson_cdf(F.col("_rate")).alias("_cdf")), "mix-rates")
    name = F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    plain = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("source"), F.lit("")).alias("_source"),
                        name.alias("_name"))
    repeated = (
        plain.join(small_side(rates), "_source")
        .withColumn("_u", _uniform(F.lit(str(seed)), F.col("_name")))
        .withColumn("n_copies", F.size(F.filter("_cdf", lambda c: c <= F.col("_u"))))
        .select("_row", "_name", "n_copies")
        .where("n_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    )
    order = F.md5(F.concat_ws(":", F.lit(str(seed + 1)), "_name", "copy"))
    return repeated.withColumn("shuffle_key", F.substring(order, 1, 16)).drop("_name").orderBy("shuffle_key", "copy")


def mix_sources(docs: DataFrame, targets: DataFrame | None = None, temperature: float = TEMPERATURE,
                total: int | None = None, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """Repeat every document a Poisson number of times with its source's rate as mean, and shuffle.

    The number is the inverse of the Poisson distribution at a hash of (seed, key): the same
    document gets the same number wherever and whenever it is computed. Adds copy (from 1),
    n_copies and shuffle_key, in place of columns of these names; the rows are sorted by shuffle_key over
    all partitions. Documents with the number 0 go. Rows that repeat a key get the same number; a document
    without a key goes by the MD5 of its text, so such documents are drawn each for itself. A null source is the
    source ''. A source with rate 0 gives no rows; an empty table gives none.
    """
    added = ["n_copies", "copy", "shuffle_key"]
    rows = _repeated(docs, targets, temperature, total, seed, key)
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in added], *added)


def mixed_rows(docs: DataFrame, targets: DataFrame | None = None, temperature: float = TEMPERATURE,
               total: int | None = None, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """``mix_sources`` with the columns of ``docs`` alone, whatever they are called."""
    return _repeated(docs, targets, temperature, total, seed, key).select("_row.*")
