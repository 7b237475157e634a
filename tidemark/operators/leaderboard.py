"""Leaderboards, aggregation over symbols, confidence, and portfolios of equity curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import with_returns
from tidemark.operators.results import by
from tidemark.operators.statistics import adjusted, downgraded
from tidemark.schema import so_far


def across_symbols(results: DataFrame, keys=("strategy_type", "config_id")) -> DataFrame:
    """Per configuration: Sharpe, geometric and plain CAGR, drawdown, hit rate and trades over its symbols."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("symbols"),
        F.avg("sharpe").alias("avg_sharpe"),
        F.min("sharpe").alias("min_sharpe"),
        F.max("sharpe").alias("max_sharpe"),
        (F.exp(F.avg(F.log(F.greatest(1.0 + F.col("cagr"), F.lit(1e-10))))) - 1.0).alias("geo_cagr"),
        F.avg("cagr").alias("avg_cagr"),
        F.max("max_drawdown").alias("worst_drawdown"),
        F.avg("max_drawdown").alias("avg_drawdown"),
        F.avg((F.col("cagr") > 0).cast("double")).alias("hit_rate"),
        F.avg("num_trades").alias("avg_trades"),
    )


def tail_risk(curve: DataFrame, keys=("config_id",), least: int = 30) -> DataFrame:
    """Means over symbols with at least ``least`` returns: cvar_95, skew, kurtosis (sample deviation) and downside_ratio."""
    own = (*keys, "symbol")
    r = with_returns(curve, own).where("ret is not null")
    w = Window.partitionBy(*own)
    r = r.withColumns({"_i": F.row_number().over(w.orderBy("ret", "ts")), "_n": F.count("*").over(w)}).where(F.col("_n") >= least)
    sd, ratio = F.stddev_samp("ret"), F.stddev_pop("ret") / F.stddev_samp("ret")
    bad = F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), 2.0)))
    per = r.groupBy(*own).agg(F.abs(F.avg(F.when(F.col("_i") <= F.greatest(F.ceil(0.05 * F.col("_n")), F.lit(1)), F.col("ret")))).alias("cvar_95"), (F.skewness("ret") * F.pow(ratio, 3.0)).alias("skew"), ((F.kurtosis("ret") + 3.0) * F.pow(ratio, 4.0) - 3.0).alias("kurtosis"), F.try_divide(bad, sd).alias("downside_ratio"))
    return per.groupBy(*keys).agg(*[F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in ("cvar_95", "skew", "kurtosis", "downside_ratio")])


# Weights of the components of the robust score.
WEIGHTS = {
    "default": {"sharpe": 0.25, "min_sharpe": 0.10, "hit_rate": 0.20, "drawdown": 0.15, "tail_risk": 0.10, "kurtosis": 0.10, "regime": 0.10},
    "conservative": {"sharpe": 0.15, "min_sharpe": 0.15, "hit_rate": 0.15, "drawdown": 0.20, "tail_risk": 0.15, "kurtosis": 0.05, "regime": 0.15},
    "aggressive": {"sharpe": 0.40, "min_sharpe": 0.05, "hit_rate": 0.25, "drawdown": 0.10, "tail_risk": 0.10, "kurtosis": 0.05, "regime": 0.05},
}
# Ten weights by risk profile.
PROFILES = {
    "balanced": {"avg_sharpe": 0.15, "oos_sharpe": 0.15, "hit_rate": 0.15, "min_sharpe": 0.10, "max_drawdown": 0.10, "cvar_95": 0.10, "avg_duration": 0.05, "losses": 0.05, "wf_grade": 0.10, "regime": 0.05},
    "conservative": {"avg_sharpe": 0.10, "oos_sharpe": 0.15, "hit_rate": 0.10, "min_sharpe": 0.15, "max_drawdown": 0.15, "cvar_95": 0.15, "avg_duration": 0.00, "losses": 0.05, "wf_grade": 0.10, "regime": 0.05},
    "aggressive": {"avg_sharpe": 0.25, "oos_sharpe": 0.15, "hit_rate": 0.20, "min_sharpe": 0.05, "max_drawdown": 0.10, "cvar_95": 0.05, "avg_duration": 0.00, "losses": 0.05, "wf_grade": 0.10, "regime": 0.05},
    "trend_options": {"avg_sharpe": 0.15, "oos_sharpe": 0.20, "hit_rate": 0.25, "min_sharpe": 0.05, "max_drawdown": 0.10, "cvar_95": 0.05, "avg_duration": 0.05, "losses": 0.10, "wf_grade": 0.05, "regime": 0.00},
}


def profile_weights(profile: str) -> dict[str, float]:
    """The seven weights of a risk profile: half of the out-of-sample weight goes to Sharpe and half to the regime, and duration,
    losses and grade to kurtosis."""
    p = PROFILES[profile]
    return {"sharpe": p["avg_sharpe"] + p["oos_sharpe"] / 2, "min_sharpe": p["min_sharpe"], "hit_rate": p["hit_rate"], "drawdown": p["max_drawdown"], "tail_risk": p["cvar_95"], "kurtosis": p["avg_duration"] + p["losses"] + p["wf_grade"], "regime": p["regime"] + p["oos_sharpe"] / 2}


def robust_score(df: DataFrame, weights: dict[str, float] = WEIGHTS["default"]) -> Column:
    """Weighted sum of clamped components; those whose column is missing or null count as 0.5."""
    clamp = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    parts = {
        "sharpe": ("avg_sharpe", lambda c: clamp(c / 2.0, 0.0, 1.5)),
        "min_sharpe": ("min_sharpe", lambda c: clamp(c / 2.0, -0.5, 1.0)),
        "hit_rate": ("hit_rate", lambda c: c),
        "drawdown": ("worst_drawdown", lambda c: 1.0 - clamp(c, 0.0, 1.0)),
        "tail_risk": ("cvar_95", lambda c: 1.0 - clamp(c * 20.0, 0.0, 1.0)),
        "kurtosis": ("kurtosis", lambda c: 1.0 - clamp(c / 6.0, 0.0, 1.0)),
        "regime": ("regime_penalty", lambda c: 1.0 - clamp(c, 0.0, 1.0)),
    }
    out = F.lit(0.0)
    for name, (column, score) in parts.items():
        part = F.coalesce(score(F.col(column)), F.lit(0.5)) if column in df.columns else F.lit(0.5)
        out = out + weights[name] * part
    return out


#: Cross-symbol metrics that boards rank by, and their columns.
RANKINGS = {"avg_sharpe": "avg_sharpe", "min_sharpe": "min_sharpe", "geo_mean_cagr": "geo_cagr", "hit_rate": "hit_rate", "mean_oos_sharpe": "oos_sharpe"}


def rank_value(df: DataFrame, metric: str) -> Column:
    """The value that a metric ranks by: a column of RANKINGS, or the robust score by the weights of a risk profile (``composite:<profile>``).
    Without an out-of-sample Sharpe the mean Sharpe stands for it."""
    if metric.startswith("composite"):
        return robust_score(df, profile_weights(metric.partition(":")[2] or "balanced"))
    column = RANKINGS[metric]
    return F.col("avg_sharpe") if column not in df.columns else F.coalesce(column, "avg_sharpe") if column == "oos_sharpe" else F.col(column)


def ranked_by(df: DataFrame, metric: str, n: int, key: str = "config_id", per_strategy: int | None = None) -> DataFrame:
    """The board of ``n`` by any cross-symbol metric or profile, with its rank_value."""
    return board(df.withColumn("rank_value", rank_value(df, metric)), "rank_value", n, key, per_strategy)


def board(df: DataFrame, metric: str, n: int, key: str = "config_id", per_strategy: int | None = None) -> DataFrame:
    """The best row of each key, the best ``n`` of these (at most ``per_strategy`` of each strategy), with their rank."""
    best = df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*by(metric, False, key)))).where("_k = 1").drop("_k")
    if per_strategy is not None:
        w = Window.partitionBy("strategy_type").orderBy(*by(metric, False, key))
        best = best.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_strategy).drop("_k")
    best = best.orderBy(*by(metric, False, key)).limit(n)  # a top-k: what is ranked next has n rows
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*by(metric, False, key))))


def with_fdr(df: DataFrame, alpha: float = 0.05, p: str = "p", grade: str = "grade") -> DataFrame:
    """Adjusted p-values over rows that have one, significant, and the grade, lowered where it isn't."""
    out = adjusted(df, p)
    return out.withColumns({"significant": F.col("bh") < alpha, grade: F.when(F.col("bh").isNotNull(), downgraded(F.col(grade), F.col("bh"), alpha)).otherwise(F.col(grade))})


def covered(spans: DataFrame, start: Column, end: Column, least: float = 0.6, most_lag_days: int = 365) -> DataFrame:
    """``spans`` (first, last: dates) of the symbols that cover enough of the window from ``start`` to ``end`` to be aggregated: at least the share ``least`` of its
    days, and begun at most ``most_lag_days`` after it; without dates they don't.  Ranges of less than a day count as one."""
    days = lambda a, b: F.greatest(F.abs(F.datediff(b, a)), F.lit(1)).cast("double")
    enough = days(F.col("first"), F.col("last")) / days(start, end) >= least
    return spans.where(enough & (F.datediff(F.col("first"), start) <= most_lag_days))


def common_dates(curves: DataFrame, group: str | None = None) -> DataFrame:
    """Dates on which every symbol (of the group) has a value: by counting, not by n joins."""
    keys = [group] if group else []
    symbols = curves.groupBy(*keys).agg(F.countDistinct("symbol").alias("_all"))
    per = curves.groupBy(*keys, "ts").agg(F.countDistinct("symbol").alias("_n"))
    joined = per.join(symbols, keys) if keys else per.crossJoin(symbols)
    return joined.where("_n = _all").select(*keys, "ts")


def _common_returns(curves: DataFrame) -> DataFrame:
    own = curves.join(common_dates(curves), "ts", "left_semi").select("symbol", "ts", "equity")
    return with_returns(own, ("symbol",)).where("ret is not null").select("symbol", "ts", "ret")


def _weights(r: DataFrame, weighting: str, last: int) -> DataFrame:
    recent = r.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_k") <= last)
    sd = F.greatest(F.stddev_samp("ret"), F.lit(1e-10))
    raw = {"equal": F.lit(1.0), "inverse_volatility": 1.0 / sd, "inverse_variance": 1.0 / (sd * sd), "sharpe": F.greatest(F.avg("ret") / sd * 252**0.5, F.lit(0.1))}[weighting]
    w = recent.groupBy("symbol").agg(raw.alias("_w"), F.count("*").alias("_used"))
    return w.select("symbol", (F.col("_w") / F.sum("_w").over(Window.partitionBy(F.lit(1)))).alias("weight"))  # a table of symbols


def symbol_weights(curves: DataFrame, weighting: str = "equal", last: int = 60) -> DataFrame:
    """(symbol, weight) of a portfolio of curves."""
    return _weights(_common_returns(curves), weighting, last)


def combine_curves(curves: DataFrame, weighting: str = "equal", how: str = "arithmetic", cash: float = 100_000.0, last: int = 60, least: int = 20) -> DataFrame:
    """ts, ret, equity of the portfolio of symbols over their common dates; empty if these are fewer than ``least``.

    Weights: equal, inverse_volatility, inverse_variance or sharpe (at least 0.1), from the last ``last`` returns."""
    r = _common_returns(curves)
    w = _weights(r, weighting, last)
    joined = r.join(w, "symbol")
    total = F.sum(F.col("weight") * F.col("ret")) if how == "arithmetic" else F.exp(F.sum(F.col("weight") * F.log(F.greatest(1.0 + F.col("ret"), F.lit(1e-10))))) - 1.0
    out = joined.groupBy("ts").agg(total.alias("ret"))
    # one row per date of one portfolio
    every = Window.partitionBy(F.lit(1))
    out = out.withColumn("_n", F.count("*").over(every)).where(F.col("_n") >= least)
    grown = F.exp(F.sum(F.log(F.greatest(1.0 + F.col("ret"), F.lit(1e-10)))).over(every.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))
    return out.select("ts", "ret", (cash * grown).alias("equity"))


def portfolio_summary(curves: DataFrame, weighting: str = "equal", how: str = "arithmetic", cash: float = 100_000.0, last: int = 60, least: int = 20) -> DataFrame:
    """symbols, overlap_days, max_drawdown, sharpe (of the sample deviation), cagr (252 days a year) and the weights of a combined portfolio; no row if
    it is empty."""
    curve = combine_curves(curves, weighting, how, cash, last, least)
    peak = F.greatest(F.max("equity").over(Window.partitionBy(F.lit(1)).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)), F.lit(cash))
    dev = F.stddev_samp("ret")
    row = curve.withColumn("_down", (peak - F.col("equity")) / peak).agg(F.count("*").alias("_n"), F.max("_down").alias("max_drawdown"), F.when(dev > 1e-10, F.avg("ret") / dev * 252**0.5).otherwise(0.0).alias("sharpe"), F.max_by("equity", "ts").alias("_end")).where("_n > 0")
    days = F.col("_n") + 1
    weights = symbol_weights(curves, weighting, last).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "weight")))).alias("weights"), F.count("*").alias("symbols"))
    cagr = F.when(F.col("_end") > 0, F.pow(F.col("_end") / cash, 252.0 / days) - 1.0).otherwise(-1.0)
    return row.crossJoin(weights).select("symbols", days.alias("overlap_days"), "max_drawdown", "sharpe", cagr.alias("cagr"), "weights")


def average_curve(curves: DataFrame) -> DataFrame:
    """Mean equity of the symbols by date."""
    return curves.groupBy("ts").agg(F.avg("equity").alias("equity"), F.count("*").alias("symbols"))


def drawdown_curve(curve: DataFrame, keys=("symbol",)) -> DataFrame:
    """Per bar (equity - peak) / peak, so 0 or below."""
    peak = F.max("equity").over(so_far(keys))
    return curve.select(*keys, "ts", F.try_divide(F.col("equity") - peak, peak).alias("drawdown"))
