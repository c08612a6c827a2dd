"""Statistics: sums over all rows are Spark aggregates; only tails and one-dimensional searches on one aggregated row are plain arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(df: DataFrame, rows: str, cols: str, values: Sequence[str]) -> DataFrame:
    """Counts of each row value by each of the given column values, 0 where there are none."""
    return df.groupBy(rows).agg(*[F.sum((F.col(cols) == v).cast("int")).alias(v) for v in values])


#: distinct values of a key that one task may hold
FEW_VALUES = 1_000_000


def _by_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal or null ``keys``, which come from ``left``."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]).drop(*[f"_right_{k}" for k in keys])


def _running_counts(counts: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """``counts`` (keys, value, _n) with ``_upto``, how many rows of the keys have that value or a lesser one, and ``_all``.

    Values are cut into ranges that hold like numbers of distinct values; sums run within the ranges and
    over the ranges, so no task sorts all values of a frequent key. NaN is the greatest value.
    """
    cuts = counts.agg(F.percentile_approx(F.col(value).cast("double"), [i / bins for i in range(1, bins)], 100 * bins).alias("_cuts"))  # one row
    bin_ = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c <= F.col(value)))
    ranged, part = counts.join(F.broadcast(cuts)).withColumn("_bin", bin_).drop("_cuts"), [*keys, "_bin"]
    over = Window.partitionBy(*keys)
    sums = ranged.groupBy(*part).agg(F.sum("_n").alias("_s"))
    sums = sums.select(*part, F.coalesce(F.sum("_s").over(over.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_s").over(over).alias("_all"))
    local = ranged.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return _by_keys(local, sums, part).withColumn("_upto", F.col("_upto") + F.col("_before")).drop("_before", "_bin")


def _medians(counts: DataFrame, keys: Sequence[str], value: str, name: str, bins: int) -> DataFrame:
    """(keys, ``name``): the median of the counted values."""
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col(value)))
    mid = (at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))) / 2
    return _running_counts(counts, keys, value, bins).groupBy(*keys).agg(mid.cast("double").alias(name))


def rank_averages(df: DataFrame, keys: Sequence[str], value: str, bins: int = 64) -> DataFrame:
    """Mean, sample deviation, median and MAD (1.4826 times the median distance from the median) of ``value`` by ``keys``.

    While no key has over FEW_VALUES distinct values, by a count, Spark's exact median holds them in a
    task; beyond that medians come from counts of distinct values in ranges, so a frequent key is no
    single task. Null values count for nothing (all null: null figures), null keys are keys.
    """
    figures = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")]
    most = df.groupBy(*keys).agg(F.approx_count_distinct(value).alias("_d")).agg(F.max("_d")).first()[0] or 0
    if most <= FEW_VALUES:
        small = df.groupBy(*keys).agg(*figures, F.median(value).alias("median"))
        mad = _by_keys(df.select(*keys, value), small.select(*keys, "median"), keys).groupBy(*keys).agg((1.4826 * F.median(F.abs(F.col(value) - F.col("median")))).alias("mad"))
        return _by_keys(small, mad, keys)
    one = df.groupBy(*keys).agg(*figures)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    medians = _medians(counts, keys, value, "median", bins)
    far = _by_keys(counts, medians, keys).groupBy(*keys, F.abs(F.col(value) - F.col("median")).alias("_far")).agg(F.sum("_n").alias("_n"))
    mad = _medians(far, keys, "_far", "mad", bins).withColumn("mad", 1.4826 * F.col("mad"))
    found = _by_keys(medians, mad, keys).withColumnsRenamed({k: f"_right_{k}" for k in keys})
    return one.join(found, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys], "left").drop(*[f"_right_{k}" for k in keys])


def avg_rank(df: DataFrame, value: str, rank: str = "rank", bins: int = 64) -> DataFrame:
    """``rank`` of each row's value, ties averaged; null for a null value, NaN ranks last.

    Distinct values are counted first and their running sum is taken in two steps, within ranges of like
    numbers of distinct values and over the ranges, so no task sorts all rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    ranks = _running_counts(counts, [], value, bins).select(value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(rank))
    return df.join(ranks, value, "left")


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1.0 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t))


def chi2_upper(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution, by its finite or error-function series."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))
    tail = math.erfc(math.sqrt(x / 2))
    return tail + math.exp(-x / 2) * sum((x / 2) ** (k - 0.5) / math.gamma(k + 0.5) for k in range(1, (df - 1) // 2 + 1))


def normal_quantile(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def pearson_test(df: DataFrame, x: str, y: str, alpha: float = 0.01) -> DataFrame:
    """One row: r, n, two-sided p and the Fisher interval at level ``alpha``; nulls where n is under 4 or a column is constant."""
    one = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.corr(x, y).alias("r"), F.count("*").alias("n")).first()
    r, n = one["r"], one["n"]
    p = low = high = None
    if r is not None and n > 3:
        p = 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
        if abs(r) < 1:
            z, half = math.atanh(r), normal_quantile(1 - alpha / 2) / math.sqrt(n - 3)
            low, high = math.tanh(z - half), math.tanh(z + half)
    return df.sparkSession.createDataFrame([(r, n, p, low, high)], "r double, n long, p double, low double, high double")


def spearman_test(df: DataFrame, x: str, y: str, alpha: float = 0.01) -> DataFrame:
    """As ``pearson_test``, over average ranks."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return pearson_test(avg_rank(avg_rank(both, "x", "rx"), "y", "ry"), "rx", "ry", alpha)


def random_intercept_ml(df: DataFrame, y: str, xs: Sequence[str], group: str) -> dict:
    """Maximum-likelihood fit of y = intercept + xs + group effect + residual: coefs, se, group and residual variance, logLik, n.

    Groups enter by their sums only, and for any ratio of variances groups of one size enter alike;
    so rows are summed by group and groups by size in Spark. There are at most about the square root
    of twice the number of rows in sizes, which is what the search over the ratio sees.
    """
    cols = ["_1", *xs, y]
    rows = df.select(group, F.lit(1.0).alias("_1"), *[F.col(c).cast("double").alias(c) for c in (*xs, y)]).dropna()
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    per = rows.groupBy(group).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)], *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p{i}_{j}") for i, j in pairs])
    sizes = per.groupBy("n").agg(F.count("*").alias("groups"), *[F.sum(f"p{i}_{j}").alias(f"p{i}_{j}") for i, j in pairs], *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"q{i}_{j}") for i, j in pairs]).toPandas()
    n_rows = int((sizes["n"] * sizes["groups"]).sum())

    def fits(ratios: Sequence[float]) -> list[tuple[float, np.ndarray, np.ndarray, float, float]]:
        out = []
        for ratio in ratios:
            shrink = ratio / (1 + ratio * sizes["n"].to_numpy(float))
            m = np.zeros((k, k))
            for i, j in pairs:
                m[i, j] = m[j, i] = (sizes[f"p{i}_{j}"] - shrink * sizes[f"q{i}_{j}"]).sum()
            xtx, xty, yty = m[:-1, :-1], m[:-1, -1], m[-1, -1]
            beta = np.linalg.solve(xtx, xty)
            sigma2 = float(yty - beta @ xty) / n_rows
            logdet = float((sizes["groups"] * np.log1p(ratio * sizes["n"])).sum())
            out.append((-0.5 * (n_rows * math.log(2 * math.pi * sigma2) + logdet + n_rows), beta, np.sqrt(sigma2 * np.diag(np.linalg.inv(xtx))), sigma2, ratio))
        return out

    grid = [0.0, *np.exp(np.linspace(-9, 5, 24))]
    for _ in range(4):
        found = fits(grid)
        best = max(range(len(grid)), key=lambda i: found[i][0])
        lo, hi = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
        grid = list(np.linspace(lo, hi, 16)) + [grid[best]]
        grid.sort()
    loglik, beta, se, sigma2, ratio = max(fits(grid), key=lambda f: f[0])
    names = ["(intercept)", *xs]
    return {"coefs": dict(zip(names, map(float, beta))), "se": dict(zip(names, map(float, se))), "group_var": ratio * sigma2, "residual_var": sigma2, "loglik": loglik, "n": n_rows, "params": k + 1}


def lr_test(small: dict, large: dict) -> dict:
    """Likelihood-ratio test of two nested fits, with AIC and BIC of both."""
    chisq, df = 2 * (large["loglik"] - small["loglik"]), large["params"] - small["params"]
    ic = lambda m, w: -2 * m["loglik"] + w * m["params"]
    return {"chisq": chisq, "df": df, "p": chi2_upper(chisq, df), "aic": (ic(small, 2), ic(large, 2)), "bic": (ic(small, math.log(small["n"])), ic(large, math.log(large["n"])))}


def duration_summary(durations: DataFrame, value: str) -> DataFrame:
    """Rows MIN, MAX, MEAN, SUM of a decimal column."""
    one = durations.agg(F.min(value).alias("MIN"), F.max(value).alias("MAX"), F.avg(value).alias("MEAN"), F.sum(value).alias("SUM"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in ("MIN", "MAX", "MEAN", "SUM")])).alias("r")).select("r.*")
