"""Quality rules with robust multivariate outliers.

Every text gives a vector of transformed statistics. For every language and source the minimum
covariance determinant estimate of location and scatter is found by concentration steps over all
rows; documents far from it in Mahalanobis distance are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graderoom.llm.common import materialise, small_side

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
BLANK = " \t\n\x0b\x0c\r"
STATS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "n_lines long, n_upper long")
#: The vector: log word length, and square roots of the shares of symbols, repeated lines, words in
#: repeated windows, and capitals. FLOOR is the least scale a statistic can have: most clean texts
#: have no symbol at all, and their spread of zero must not make one symbol an outlier.
VECTOR = ("x1", "x2", "x3", "x4", "x5")
FLOOR = (0.08, 0.08, 0.15, 0.12, 0.08)
#: Fixed-point steps per unit: sums of whole numbers do not depend on the order of rows.
STEPS = 1024
#: Share of rows in the concentrated half, and the factor that makes it consistent at a normal
#: distribution of five statistics.
SHARE, CONSISTENT = 0.75, 1.41
#: Squared distance beyond which a document is rejected: chi-square with five degrees, one in 10^11.
#: Tables and texts with a few repeated lines lie below it, as the tails of real texts are heavy.
CUT = 60.0
#: A language and source with fewer rows uses its language, and that the whole table.
LEAST_ROWS = 50
ROUNDS = 6
SHRINK = 0.1
DISTANCE_STEPS = 128
MIN_WORDS = 50


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text; zeros for null."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeated = 0
    if n > 2:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        if len(number) < n:
            size = len(number)
            pairs = ids[:-1] * size + ids[1:]
            if size >= 1 << 20:
                pairs, size = np.unique(pairs, return_inverse=True)[1], size
            _, which, count = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
            again = count[which] > 1
            if again.any():
                cover = np.zeros(n, bool)
                for k in range(3):
                    cover[k:k + n - 2] |= again
                repeated = int(cover.sum())
    return (n, len(text) - sum(map(text.count, BLANK)), len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated, len(lines), len(raw) - len(raw.translate(None, UPPER)))


def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_statistics(t) for t in texts],
                        columns=[c.split()[0] for c in STATS.split(", ")], dtype="int64")


def _ratio(top: str, bottom: str) -> Column:
    return F.sqrt(F.col(f"_q.{top}") / F.greatest(F.col(f"_q.{bottom}"), F.lit(1)))


def with_statistics(docs: DataFrame) -> DataFrame:
    """All columns plus _q (the counts), base_failed, and the vector _x in fixed point."""
    n, repeat = F.col("_q.n_words"), F.col("_q.n_repeat_words")
    # declared as such, or a filter on its result would be pushed below and count every text again
    counts = F.pandas_udf(_statistics, STATS).asNondeterministic()
    values = [F.log(F.greatest(F.col("_q.word_chars"), F.lit(1)) / F.greatest(n, F.lit(1))),
              _ratio("n_symbols", "word_chars"), _ratio("n_dup_lines", "n_lines"),
              _ratio("n_repeat_words", "n_words"), _ratio("n_upper", "word_chars")]
    return (
        docs.withColumn("_q", counts("text"))
        .withColumn("base_failed", (n < MIN_WORDS) | (100 * repeat > 50 * n))
        .withColumn("_x", F.array(*[F.round(v * STEPS).cast("long") for v in values]))
    )


def _groups() -> Column:
    """The three groups of a row, finest first."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return F.array(F.concat_ws("\x1f", F.lit("2"), lang, source), F.concat_ws("\x1f", F.lit("1"), lang), F.lit("0"))


def _inverse(cov: np.ndarray) -> np.ndarray:
    """Inverse scatter with the least scales, and correlations drawn in so that it always exists."""
    regular = (1 - SHRINK) * cov
    np.fill_diagonal(regular, np.maximum(np.diag(cov), np.array(FLOOR) ** 2))
    return np.linalg.inv(regular)


def _distance(x: Column | str = "_x") -> Column:
    """Squared Mahalanobis distance of the vector to columns ``centre`` and ``inverse``."""
    d = len(VECTOR)
    diff = [F.element_at(x, i + 1) / F.lit(float(STEPS)) - F.element_at("centre", i + 1) for i in range(d)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(i, d):
            weight = F.element_at("inverse", i * d + j + 1)
            total = total + diff[i] * diff[j] * weight * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


PARAMS = "g string, n long, centre array<double>, inverse array<double>, cut int"


def _start(rows: DataFrame) -> DataFrame:
    """Medians and scaled median deviations per group, from counts of the fixed-point values."""
    def centred(values: DataFrame, name: str) -> DataFrame:
        counts = values.groupBy("g", "s", "v").agg(F.count(F.lit(1)).alias("c"))
        whole = Window.partitionBy("g", "s")  # at most one row per fixed-point value
        upto = whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        return (counts.withColumn("t", F.sum("c").over(whole)).withColumn("u", F.sum("c").over(upto))
                .where("2 * u >= t").groupBy("g", "s").agg(F.min("v").alias(name), F.max("t").alias("n")))

    long = rows.select("g", F.posexplode("_x").alias("s", "v"))
    medians = materialise(centred(long, "m"), "quality-medians")
    spread = long.join(small_side(medians.drop("n")), ["g", "s"]).withColumn("v", F.abs(F.col("v") - F.col("m")))
    both = materialise(medians.join(centred(spread, "d").drop("n"), ["g", "s"]), "quality-deviations")

    def diagonal(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("s")
        scale = np.maximum(part["d"].to_numpy() * 1.4826 / STEPS, FLOOR)
        return pd.DataFrame({
            "g": [part["g"].iloc[0]], "n": [int(part["n"].iloc[0])], "centre": [part["m"].to_numpy() / STEPS],
            "inverse": [np.diag(scale ** -2.0).ravel()], "cut": [-1]})

    return both.groupBy("g").applyInPandas(diagonal, PARAMS)


def estimate(stats: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Location and inverse scatter per group of the rows that pass the base rules.

    ``stats`` comes from ``with_statistics``. Each round measures every row's distance, counts rows
    and sums their vectors and products per step of the log distance, takes the steps that hold
    the nearest ``SHARE`` of a group's rows, and sets location and scatter from them. Groups are
    the language and source, the language, and the whole. No group is gathered: what leaves a
    task has at most one row per group and distance step.
    """
    d = len(VECTOR)
    rows = materialise(
        stats.where("not base_failed").select("_x", F.explode(_groups()).alias("g")), "quality-vectors")
    params = materialise(_start(rows), "quality-start")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def concentrate(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("b")
        counts = part["c"].to_numpy()
        need = int(np.ceil(SHARE * counts.sum()))
        stop = int(np.searchsorted(np.cumsum(counts), need)) + 1
        near = part.iloc[:stop]
        n = float(near["c"].sum())
        mean = near[[f"s{i}" for i in range(d)]].sum().to_numpy(float) / n / STEPS
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = float(near[f"p{i}_{j}"].sum()) / n / STEPS ** 2 - mean[i] * mean[j]
        return pd.DataFrame({
            "g": [part["g"].iloc[0]], "n": [int(counts.sum())], "centre": [mean],
            "inverse": [_inverse(CONSISTENT * cov).ravel()], "cut": [int(part["b"].iloc[stop - 1])]})

    x = [F.element_at("_x", i + 1) for i in range(d)]
    for _ in range(rounds):
        step = F.floor(F.log1p(_distance()) * DISTANCE_STEPS).cast("int")
        sums = rows.join(small_side(params.select("g", "centre", "inverse")), "g").groupBy("g", step.alias("b")).agg(
            F.count(F.lit(1)).alias("c"), *[F.sum(x[i]).alias(f"s{i}") for i in range(d)],
            *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs])
        params = materialise(sums.groupBy("g").applyInPandas(concentrate, PARAMS), "quality-round")
    return params


def judge(stats: DataFrame, params: DataFrame, cut: float = CUT, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Adds ``distance`` and ``kept``: false if base_failed or if the distance is over ``cut``.

    A row uses the finest of its groups with ``least_rows`` rows; without any, only the base rules
    decide and the distance is null.
    """
    fit = params.where(F.col("n") >= least_rows).select("g", "centre", "inverse")
    out = stats.withColumn("_g", _groups())
    found = []
    for k in range(3):
        side = fit.where(F.col("g").startswith("210"[k])).select(
            F.col("g").alias(f"_g{k}"), F.struct("centre", "inverse").alias(f"_p{k}"))
        out = out.withColumn(f"_g{k}", F.col("_g")[k]).join(small_side(side), f"_g{k}", "left")
        found.append(F.col(f"_p{k}"))
    best = F.coalesce(*found)
    return (
        out.withColumn("centre", best["centre"]).withColumn("inverse", best["inverse"])
        .withColumn("distance", _distance())
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut))
        .drop("_g", "_g0", "_g1", "_g2", "_p0", "_p1", "_p2", "centre", "inverse")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they were.

    Counts are of whole texts. A null text has no words and fails the base rules, as does an empty
    one; a null language or source counts as ''. Rows that repeat a document are judged alike. An
    empty table gives an empty table. Statistics are computed twice (for the estimate and for the
    verdict) rather than carrying texts through a join.
    """
    plain = docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang", "source")
    params = estimate(with_statistics(plain.drop("_row")))
    return judge(with_statistics(plain), params).where("kept").select("_row.*")
