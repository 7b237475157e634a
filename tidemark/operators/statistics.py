"""Statistics of returns and tests: bootstrap, permutation, p-values, multiple comparisons, sample moments."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.operators.order import p_bucket, with_running
from tidemark.operators.quantiles import aggregated
from tidemark.operators.resampling import drawn, drawn_blocks, keyed, positions

ITERATIONS = 10_000
SEED = 42


# --- resampling ---

def mean(n: Column, s: Column, q: Column) -> Column:
    return s / n


def std(n: Column, s: Column, q: Column) -> Column:
    return F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / F.greatest(n - 1, F.lit(1)))


def sharpe(n: Column, s: Column, q: Column) -> Column:
    dev = std(n, s, q)
    return F.when(dev < 1e-10, 0.0).otherwise(mean(n, s, q) / dev * math.sqrt(252.0))


#: Statistics of a resample, from its number of values, their sum and the sum of their squares.
STATISTICS: dict[str, Callable[[Column, Column, Column], Column]] = {f.__name__: f for f in (mean, std, sharpe)}


def bootstrap(df: DataFrame, keys: list[str], column: str, statistic: str = "mean", method: str = "iid", block: float | None = None, rounds: int = ITERATIONS, level: float = 0.95, seed: int = SEED) -> DataFrame:
    """keys, n, value, std_error, lower, upper, boot_mean, boot_median of a statistic (``STATISTICS``) of each key's values that aren't null, by resampling.

    Each round draws n values: single ones (iid), blocks of ``block`` values in the order of ts (moving), or blocks of geometric lengths with that mean around a
    circle (stationary); by default the cube root of n, 2 at least.  No key is a task (``resampling``).  The interval is between
    percentiles at the floor of their index, std_error is of the population, the median is at half the number of rounds; under 2 values these are null."""
    if method not in ("iid", "moving", "stationary"):
        raise ValueError(method)
    values = keyed(df, keys, column)
    sizes = values.groupBy("_key").agg(F.count("*").alias("n"), F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("q"))
    if method == "iid":
        found = drawn(values, sizes, F.col("n"), rounds, seed, replaced=True)
    else:
        # a cube root that is whole stays so
        size = F.lit(float(block)) if block else F.greatest(F.lit(2.0), F.floor(F.pow(F.col("n"), F.lit(1 / 3)) + 1e-9) if method == "moving" else F.pow(F.col("n"), F.lit(1 / 3)))
        found = drawn_blocks(positions(df, keys, column), sizes, size, method == "stationary", rounds, seed)
    of = STATISTICS[statistic]
    each = found.join(sizes.select("_key", "n"), "_key").select("_key", of(F.col("n"), F.col("s"), F.col("q")).alias("v"))
    # as many values a key as rounds
    spread = each.groupBy("_key").agg(F.sort_array(F.collect_list("v")).alias("v"), F.stddev_pop("v").alias("std_error"), F.avg("v").alias("boot_mean"))
    alpha = 1.0 - level
    at = lambda i: F.get("v", F.lit(min(int(i), rounds - 1)))
    spread = spread.select("_key", "std_error", at(alpha / 2 * rounds).alias("lower"), at((1 - alpha / 2) * rounds).alias("upper"), "boot_mean", at(rounds // 2).alias("boot_median"))
    names = keyed(df, keys, column, *keys).groupBy("_key").agg(*[F.first(k).alias(k) for k in keys])
    out = sizes.withColumn("value", of(F.col("n"), F.col("s"), F.col("q"))).join(spread, "_key").join(names, "_key")
    return out.select(*keys, "n", "value", *[F.when(F.col("n") >= 2, F.col(c)).alias(c) for c in ("std_error", "lower", "upper", "boot_mean", "boot_median")])


def bootstrap_sharpe(returns: DataFrame, keys: list[str], column: str = "ret", method: str = "stationary", rounds: int = 1000, level: float = 0.95, seed: int = SEED) -> DataFrame:
    """keys, n, sharpe, std_error, lower, upper, grade and the sample statistics (mean, std, skew, kurtosis) of each series of returns (keys, ts, column).
    Grades: high if the lower bound is over 0.5, medium if over 0, low from 252 returns on, else insufficient, as with fewer than 30."""
    found = bootstrap(returns, keys, column, "sharpe", method, None, rounds, level, seed).withColumnRenamed("value", "sharpe")
    grade = F.when(F.col("lower") > 0.5, "high").when(F.col("lower") > 0, "medium").when(F.col("n") >= 252, "low").otherwise("insufficient")
    enough = F.col("n") >= 30
    found = found.select(*keys, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("sharpe", "std_error", "lower", "upper", "boot_mean", "boot_median")], F.when(enough, grade).otherwise("insufficient").alias("grade"))
    moments = sample_statistics(returns, keys, column).select(*keys, "mean", "std", "skew", "kurtosis")
    return _joined(found, moments, keys)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys meet."""
    renamed = right.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]).drop(*[f"_of_{k}" for k in keys])


def permutation_test(df: DataFrame, keys: list[str], column: str, first: Column, rounds: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """keys, n_first, n_second, difference, p: two-sided test of the difference of means between the rows for which ``first`` holds and the others.

    Each round draws a subset of the first group's size without replacement, all subsets being equally likely; no key is a task (``resampling``).
    p = (extreme + 1) / (rounds + 1); null if a group is empty."""
    own = keyed(df, keys, column, *keys, F.coalesce(first, F.lit(False)).alias("_first"))
    mean_of = lambda c: F.avg(F.when(c, F.col("_x")))
    sizes = own.groupBy("_key").agg(F.count("*").alias("n"), F.count_if("_first").alias("m"), (mean_of(F.col("_first")) - mean_of(~F.col("_first"))).alias("d"), F.sum("_x").alias("total"), *[F.first(k).alias(k) for k in keys])
    both = sizes.where("m > 0 and m < n")
    found = drawn(own.select("_key", "_x"), both, F.col("m"), rounds, seed, replaced=False)
    joined = found.join(both, "_key")
    difference = F.col("s") / F.col("m") - (F.col("total") - F.col("s")) / (F.col("n") - F.col("m"))
    p = joined.groupBy("_key").agg(((F.count_if(F.abs(difference) >= F.abs("d") - 1e-12) + 1) / F.lit(rounds + 1)).alias("p"))
    return sizes.join(p, "_key", "left").select(*keys, F.col("m").alias("n_first"), (F.col("n") - F.col("m")).alias("n_second"), F.col("d").alias("difference"), "p")


def cross_confidence(df: DataFrame, keys: list[str], column: str, least: int, floors: tuple[float, float], rounds: int = 1000, seed: int = SEED) -> DataFrame:
    """keys, n, mean, lower, upper, grade: a bootstrap of the mean of one value per member (symbol or sector).

    High: lower bound over 0.5, interval under 0.75 wide, at least 80% of members positive, and the worst over the first floor; medium: lower bound over
    0, 70%, and the worst over the second; insufficient under ``least`` members."""
    found = bootstrap(df, keys, column, "mean", "iid", None, rounds, 0.95, seed)
    own = df.groupBy(*keys).agg(F.min(column).alias("_least"), F.avg((F.col(column) > 0).cast("double")).alias("_positive"))
    low, up, worst, share = F.col("lower"), F.col("upper"), F.col("_least"), F.col("_positive")
    grade = F.when((low > 0.5) & (up - low < 0.75) & (share >= 0.8) & (worst > floors[0]), "high").when((low > 0) & (share >= 0.7) & (worst > floors[1]), "medium").otherwise("low")
    enough = F.col("n") >= least
    return _joined(found, own, keys).select(*keys, "n", F.when(enough, F.col("value")).alias("mean"), F.when(enough, low).alias("lower"), F.when(enough, up).alias("upper"), F.when(enough, grade).otherwise("insufficient").alias("grade"))


def symbol_confidence(results: DataFrame, keys: list[str]) -> DataFrame:
    """Of the Sharpe ratios of the symbols; at least 10."""
    return cross_confidence(results, keys, "sharpe", 10, (-0.25, -0.75))


def sector_confidence(results: DataFrame, keys: list[str]) -> DataFrame:
    """Of the mean Sharpe ratios of the sectors; at least 5."""
    means = results.groupBy(*keys, "sector").agg(F.avg("sharpe").alias("sharpe"))
    return cross_confidence(means, keys, "sharpe", 5, (0.0, -0.25))


# --- distributions ---


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, as a column expression."""
    z = F.abs(x) / math.sqrt(2)
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-z * z)
    return F.when(x >= 0, 1.0 - half).otherwise(half)


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised, by a continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_cdf(t: float, df: float) -> float:
    if df > 1000:
        return 0.5 * math.erfc(-t / math.sqrt(2))
    tail = 0.5 * incomplete_beta(df / (df + t * t), df / 2, 0.5)
    return 1.0 - tail if t > 0 else tail


@F.pandas_udf(DoubleType())
def t_cdf_of(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else t_cdf(x, d) for x, d in zip(t, df, strict=True)], dtype="float64")


def mean_p_values(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, n, mean, t, p: one-sided, that the mean isn't positive; normal from 30 degrees of freedom on; null under 3 values."""
    c = F.col(column)
    own = df.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("_sd"))
    own = own.withColumn("t", F.when(F.col("n") >= 3, F.try_divide(F.col("mean"), F.col("_sd") / F.sqrt("n"))))
    cdf = F.when(F.col("n") - 1 >= 30, normal_cdf(F.col("t"))).otherwise(t_cdf_of("t", (F.col("n") - 1).cast("double")))
    return own.withColumn("p", F.when(F.col("t").isNotNull(), F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), 1.0 - cdf)))).drop("_sd")


# --- multiple comparisons ---


def adjusted(df: DataFrame, p: str = "p", family: list[str] | None = None) -> DataFrame:
    """bonferroni, holm and bh: adjusted p-values over each family (all rows, if none is named; the tests, not the data).  Rows with equal p have
    equal adjusted ones, so distinct values are ordered, by buckets of p; no family passes through one task."""
    keys = family or []
    values = df.where(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    ranked = with_running(values, keys, p_bucket(F.col("_p")), "_p", sums={"_i": F.col("_c")})
    totals = values.groupBy(*keys).agg(F.sum("_c").alias("_m"))
    ranked = ranked.join(totals, keys) if keys else ranked.crossJoin(totals)
    x, m, last = F.col("_p"), F.col("_m"), F.col("_i")
    cap = lambda v: F.least(v, F.lit(1.0))
    ranked = ranked.withColumns({"_h": x * (m - (last - F.col("_c"))), "_q": x * m / last})
    found = with_running(ranked, keys, p_bucket(x), "_p", greatest={"_holm": F.col("_h")}, least_after={"_bh": F.col("_q")})
    found = found.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_p"), cap(x * m).alias("bonferroni"), cap(F.col("_holm")).alias("holm"), cap(F.col("_bh")).alias("bh"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col(p) == F.col("_p")]
    return df.join(found, same, "left").drop("_p", *[f"_of_{k}" for k in keys])


def downgraded(grade: Column, adjusted_p: Column, alpha: float = 0.05) -> Column:
    """High becomes medium and medium low where the adjusted p isn't below alpha; other grades stay."""
    lower = F.when(grade == "high", "medium").when(grade == "medium", "low").otherwise(grade)
    return F.when(adjusted_p >= alpha, lower).otherwise(grade)


# --- moments ---


def sample_statistics(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """n, mean, std (sample), se, min, max, median, q1, q3, skew, kurtosis: moments of 1/n over powers of the sample deviation, excess."""
    x = F.col(column)
    n, mean, sd = F.count(x), F.avg(x), F.stddev_samp(x)
    ratio = F.stddev_pop(x) / sd
    moments = [n.alias("n"), mean.alias("mean"), sd.alias("std"), (sd / F.sqrt(n)).alias("se"), F.min(x).alias("min"), F.max(x).alias("max"), (F.skewness(x) * F.pow(ratio, 3.0)).alias("skew"), ((F.kurtosis(x) + 3.0) * F.pow(ratio, 4.0) - 3.0).alias("kurtosis")]
    out = aggregated(df, keys, moments, {"median": (column, 0.5), "q1": (column, 0.25), "q3": (column, 0.75)})
    return out.select(*keys, "n", "mean", "std", "se", "min", "max", "median", "q1", "q3", "skew", "kurtosis")
