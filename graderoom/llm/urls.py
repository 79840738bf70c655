"""URL rules: host-suffix and path-prefix expressions joined to a rule table by short digests.

Each url is expanded into (host suffix, path prefix) expressions. The expressions meet the rules in
an equi-join on the first hexadecimal digits of a SHA-256 digest; a full-digest comparison then
confirms, and the most specific confirmed rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graderoom.llm.common import UPPER

PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Columns host, path, verdict -> one row per (host, path) with digests; block wins a conflict."""
    clean = rules.select(
        F.translate(F.coalesce(F.col("host"), F.lit("")), UPPER, UPPER.lower()).alias("r_host"),
        F.coalesce(F.col("path"), F.lit("")).alias("r_path"),
        F.coalesce(F.col("verdict"), F.lit("block")).alias("r_verdict"),
    ).where("r_host <> ''")
    one = clean.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # allow < block
    full = _digest(F.col("r_host"), F.col("r_path"))
    return one.select("*", full.alias("r_digest"), F.substring(full, 1, PREFIX_DIGITS).alias("r_prefix"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge the column ``url`` of every row; returns all columns plus host, path, rule, verdict.

    A rule (host, path, verdict) fits its host and all subdomains of it, if the url's path starts
    with the rule's path. Of the fitting rules the longest (host plus path) wins; of equally long
    ones the one with the longer host, then block. Rules without a host are ignored. A url that no
    rule fits gets ``default`` and a null rule. A null url, or one without ``://``, has an empty
    host and path. Columns of the input named host, path, rule or verdict are replaced. Repeated
    rows are each judged; an empty table gives an empty table.

    Judging is done once per distinct (host, path), pre-aggregated before the shuffle, so a host
    with a third of all rows costs one row per partition. Path prefixes are taken at the lengths
    that rules have (one small array from a scalar subquery).
    """
    prepared = prepare_rules(rules)
    lengths = prepared.select(F.sort_array(F.collect_set(F.length("r_path"))).alias("l"))
    parsed = pages.drop("host", "path", "rule", "verdict").withColumns(
        {"host": host_of(F.col("url")), "path": path_of(F.col("url"))})

    distinct = parsed.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.transform(
        F.filter("_lengths", lambda n: n <= F.length("path")),
        lambda n: F.substr(F.col("path"), F.lit(1), n))
    expressions = (
        distinct.withColumn("_lengths", lengths.scalar())
        .withColumn("e_host", F.explode(suffixes))
        .withColumn("e_path", F.explode(prefixes))
        .drop("_lengths")
        .withColumn("e_digest", _digest(F.col("e_host"), F.col("e_path")))
        .withColumn("e_prefix", F.substring("e_digest", 1, PREFIX_DIGITS))
    )
    hits = expressions.join(
        prepared, (F.col("e_prefix") == F.col("r_prefix")) & (F.col("e_digest") == F.col("r_digest")))
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"),
        F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"))
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("_best"))
    return (
        parsed.join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default))})
        .drop("_best")
    )
