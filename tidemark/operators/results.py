"""Tables of sweep results: queries, rankings, groupings, comparisons.

A results table has a row per (symbol, strategy_type, config_id) with metrics; ``config_id`` settles ties in every ranking.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import aggregated

from tidemark.operators.analysis import correlation
from tidemark.operators.order import with_running

RANKINGS = ("sharpe", "cagr", "sortino", "max_drawdown", "calmar", "win_rate", "profit_factor", "total_return")


def by(metric: str, ascending: bool = False, *ties: str) -> list[Column]:
    """NaN and null last, then ties."""
    c = F.nanvl(metric, F.lit(None).cast("double"))
    return [c.asc_nulls_last() if ascending else c.desc_nulls_last(), *[F.col(t) for t in ties or ("config_id",)]]


@dataclass(frozen=True)
class Query:
    """All given thresholds hold; then sort and limit."""

    min_sharpe: float | None = None
    max_drawdown: float | None = None
    min_trades: int | None = None
    max_trades: int | None = None
    min_cagr: float | None = None
    min_win_rate: float | None = None
    symbol: str | None = None
    strategy: str | None = None
    metric: str = "sharpe"
    ascending: bool = False
    limit: int | None = None

    def run(self, df: DataFrame) -> DataFrame:
        tests = [("sharpe", ">=", self.min_sharpe), ("max_drawdown", "<=", self.max_drawdown), ("num_trades", ">=", self.min_trades), ("num_trades", "<=", self.max_trades), ("cagr", ">=", self.min_cagr), ("win_rate", ">=", self.min_win_rate), ("symbol", "=", self.symbol), ("strategy_type", "=", self.strategy)]
        for column, how, value in tests:
            if value is not None:
                c, v = F.col(column), F.lit(value)
                df = df.where(c >= v if how == ">=" else c <= v if how == "<=" else c == v)
        ties = [c for c in ("symbol", "config_id") if c in df.columns]
        df = df.orderBy(*by(self.metric, self.ascending, *ties))
        return df if self.limit is None else df.limit(self.limit)


def top(df: DataFrame, n: int, metric: str = "sharpe", ascending: bool = False) -> DataFrame:
    return Query(metric=metric, ascending=ascending, limit=n).run(df)


def top_per(df: DataFrame, key: str, n: int, metric: str, ascending: bool = False, prefer_traded: bool = False) -> DataFrame:
    """The first ``n`` rows of each key; ``prefer_traded`` puts rows with trades before those without."""
    ties = [c for c in ("symbol", "config_id") if c in df.columns and c != key]
    order = ([(F.col("num_trades") > 0).desc()] if prefer_traded else []) + by(metric, ascending, *ties)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def sliced(df: DataFrame, start: int, end: int, keys: list[str], order: str = "ts") -> DataFrame:
    """Rows number ``start`` to ``end`` (exclusive) of each series."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).where((F.col("_n") >= start) & (F.col("_n") < end)).drop("_n")


def split_by_date(df: DataFrame, train_end: str, gap_days: int = 0) -> tuple[DataFrame, DataFrame]:
    """Before ``train_end``, and from ``gap_days`` after it on; by ts, or else by date."""
    column = next((c for c in ("ts", "date") if c in df.columns), None)
    if column is None:
        raise ValueError("neither ts nor date")
    end = F.lit(train_end).cast("timestamp_ntz")
    return df.where(F.col(column) < end), df.where(F.col(column) >= end + F.expr(f"make_dt_interval({gap_days})"))


def heatmap(df: DataFrame, metric: str) -> DataFrame:
    keys = [c for c in ("symbol", "strategy_type") if c in df.columns]
    return df.select(*keys, "entry_lookback", "exit_lookback", F.col(metric).alias("value"))


# --- aggregations ---


def summary(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("sharpe").alias("avg_sharpe"), F.max("sharpe").alias("max_sharpe"), F.min("sharpe").alias("min_sharpe"), F.avg("cagr").alias("avg_cagr"), F.avg("max_drawdown").alias("avg_drawdown"), F.avg("num_trades").alias("avg_trades"))


def sensitivity(df: DataFrame, metric: str) -> DataFrame:
    """(parameter, param_value, mean, variance, count) by entry and by exit, nulls being values: one pass, by grouping sets."""
    entry, leave = F.col("entry_lookback"), F.col("exit_lookback")
    grouped = df.groupingSets([[entry], [leave]], entry, leave).agg(F.grouping("entry_lookback").alias("_by_exit"), F.avg(metric).alias("mean"), F.var_pop(metric).alias("variance"), F.count("*").alias("count"))
    by_exit = F.col("_by_exit") == 1
    return grouped.select(F.when(by_exit, "exit_lookback").otherwise("entry_lookback").alias("parameter"), F.when(by_exit, leave).otherwise(entry).cast("string").alias("param_value"), "mean", "variance", "count")


def compare_strategies(df: DataFrame) -> DataFrame:
    return df.groupBy("strategy_type").agg(
        F.count("*").alias("n_configs"), F.avg("sharpe").alias("avg_sharpe"), F.max("sharpe").alias("best_sharpe"), F.min("sharpe").alias("worst_sharpe"), F.avg("cagr").alias("avg_cagr"), F.max("cagr").alias("best_cagr"), F.avg("max_drawdown").alias("avg_drawdown"), F.max("max_drawdown").alias("worst_drawdown"), F.avg("num_trades").alias("avg_trades")
    ).orderBy(F.desc("best_sharpe"), "strategy_type")


def strategy_summary(df: DataFrame) -> DataFrame:
    """Medians, means and sample deviations by strategy, the best median first."""
    columns = ("sharpe", "cagr", "max_drawdown")
    stats = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    out = aggregated(df, ["strategy_type"], [F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"), *stats], {f"median_{c}": (c, 0.5) for c in columns})
    return out.select("strategy_type", "n", "symbols", *[f"{n}_{c}" for c in columns for n in ("mean", "median", "std")]).orderBy(F.desc("median_sharpe"), "strategy_type")


def symbol_summary(df: DataFrame) -> DataFrame:
    means = [F.count("*").alias("n"), F.avg("sharpe").alias("mean_sharpe"), F.max("sharpe").alias("max_sharpe"), F.avg("cagr").alias("mean_cagr"), F.avg("max_drawdown").alias("mean_drawdown")]
    return aggregated(df, ["symbol"], means, {"median_sharpe": ("sharpe", 0.5)}).select("symbol", "n", "mean_sharpe", "median_sharpe", "max_sharpe", "mean_cagr", "mean_drawdown")


def matrix(df: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """Mean Sharpe by strategy and, as columns, symbol."""
    return df.groupBy("strategy_type").pivot("symbol", symbols).agg(F.avg("sharpe"))


def robustness(df: DataFrame, least_symbols: int = 1) -> DataFrame:
    out = df.groupBy("strategy_type", "config_id").agg(F.countDistinct("symbol").alias("symbols"), F.avg("sharpe").alias("mean_sharpe"), F.stddev_samp("sharpe").alias("std_sharpe"), F.min("sharpe").alias("min_sharpe"), F.max("sharpe").alias("max_sharpe"), F.avg((F.col("sharpe") > 0).cast("double")).alias("win_ratio"))
    out = out.where(F.col("symbols") >= least_symbols)
    dev = F.coalesce("std_sharpe", F.lit(0.0))
    return out.withColumns({"robust_score": F.col("mean_sharpe") - 0.5 * dev, "robustness": F.col("mean_sharpe") / (1.0 + dev)})


def top_performers(df: DataFrame, share: float = 0.1, width: float = 0.01) -> DataFrame:
    """By strategy: rows, rows among the best ``share`` of all, and the percentage.  The cut is a rank over counts by value, in buckets of ``width``."""
    values = df.groupBy((-F.col("sharpe")).alias("_v")).agg(F.count("*").alias("n"))
    ranked = with_running(values, [], F.floor(F.col("_v") / width), "_v", sums={"upto": F.col("n")})
    out = df.join(ranked.select((-F.col("_v")).alias("sharpe"), (F.col("upto") - F.col("n")).alias("before")), "sharpe").crossJoin(df.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("most")))
    return out.groupBy("strategy_type").agg(F.count("*").alias("total"), F.count_if(F.col("before") < F.col("most")).alias("in_top")).withColumn("pct_in_top", 100.0 * F.col("in_top") / F.col("total"))


def parameter_stats(df: DataFrame, parameter: str, share: float = 0.25) -> DataFrame:
    """By strategy: mean, min and max of a parameter among the best ``share`` by Sharpe, and its correlation with Sharpe."""
    w = Window.partitionBy("strategy_type")
    ranked = df.where(F.col(parameter).isNotNull()).withColumns({"_r": F.row_number().over(w.orderBy(*by("sharpe", False, *[c for c in ("symbol", "config_id") if c in df.columns]))), "_n": F.count("*").over(w)})
    best = F.when(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share)), F.col(parameter).cast("double"))
    return ranked.groupBy("strategy_type").agg(F.avg(best).alias("mean_best"), F.min(best).alias("min_best"), F.max(best).alias("max_best"), correlation(F.col(parameter).cast("double"), F.col("sharpe")).alias("correlation"))


def universal_winners(df: DataFrame, least_symbols: int = 20) -> DataFrame:
    """Configurations by how often they are in the upper half, quarter and tenth of their symbol; equal values share the mean rank."""
    w = Window.partitionBy("symbol")
    ties = F.count("*").over(Window.partitionBy("symbol", "sharpe"))
    ranked = df.withColumn("percentile", (F.rank().over(w.orderBy(F.desc("sharpe"))) + (ties - 1) / 2.0) / F.count("*").over(w))
    counts = [F.count_if(F.col("percentile") <= p).alias(n) for p, n in ((0.5, "top_half"), (0.25, "top_quarter"), (0.1, "top_tenth"))]
    return ranked.groupBy("strategy_type", "config_id").agg(F.countDistinct("symbol").alias("symbols"), *counts, F.avg("percentile").alias("mean_percentile")).where(F.col("symbols") >= least_symbols)


def exploded(df: DataFrame, column: str = "components") -> DataFrame:
    return df.withColumn("component", F.explode(column))


def combo_components(df: DataFrame) -> DataFrame:
    """By component of combinations: count, mean, median, configurations, share of all combinations."""
    total = df.agg(F.countDistinct("config_id").alias("all_combos"))
    out = aggregated(exploded(df), ["component"], [F.count("*").alias("n"), F.avg("sharpe").alias("mean_sharpe"), F.countDistinct("config_id").alias("configs")], {"median_sharpe": ("sharpe", 0.5)})
    out = out.select("component", "n", "mean_sharpe", "median_sharpe", "configs")
    return out.crossJoin(total).withColumn("pct_of_combos", 100.0 * F.col("configs") / F.col("all_combos")).drop("all_combos")


def synergy(combos: DataFrame, singles: DataFrame, keys: tuple[str, ...] = ("symbol", "config_id")) -> DataFrame:
    """Sharpe of each combination minus the mean of its components' own (0 for none found)."""
    own = singles.groupBy("strategy_type").agg(F.avg("sharpe").alias("own")).withColumnRenamed("strategy_type", "component")
    out = exploded(combos).join(own, "component", "left").groupBy(*keys).agg(F.max("sharpe").alias("sharpe"), F.coalesce(F.avg("own"), F.lit(0.0)).alias("expected"))
    return out.withColumn("synergy", F.col("sharpe") - F.col("expected"))


def voting_methods(df: DataFrame) -> DataFrame:
    """Of combinations, by voting_method: count, median, mean and deviation of Sharpe, and medians and means of the rest, the best median first."""
    means = [F.count("*").alias("n"), F.avg("sharpe").alias("mean_sharpe"), F.stddev_samp("sharpe").alias("std_sharpe"), F.avg("max_drawdown").alias("avg_max_dd"), F.avg("num_trades").alias("avg_trades")]
    out = aggregated(df.where("is_combo"), ["voting_method"], means, {"median_sharpe": ("sharpe", 0.5), "median_cagr": ("cagr", 0.5)})
    return out.select("voting_method", "n", "median_sharpe", "mean_sharpe", "std_sharpe", "median_cagr", "avg_max_dd", "avg_trades").orderBy(F.desc("median_sharpe"), "voting_method")


def combo_robustness(df: DataFrame, least_symbols: int = 5) -> DataFrame:
    """Combo and Single: the number of configurations on at least ``least_symbols`` symbols, and the means over them of the share of symbols with a
    positive Sharpe, of Sharpe, of its deviation and of mean / (1 + deviation); 0 where there are none."""
    own = df.groupBy("is_combo", "strategy_type", "config_id").agg(F.count("*").alias("n"), F.avg("sharpe").alias("m"), F.stddev_samp("sharpe").alias("d"), F.avg((F.col("sharpe") > 0).cast("double")).alias("w")).where(F.col("n") >= least_symbols)
    found = own.groupBy("is_combo").agg(F.count("*").alias("num_configs"), F.avg("w").alias("avg_symbol_win_ratio"), F.avg("m").alias("avg_sharpe"), F.avg("d").alias("avg_sharpe_std"), F.avg(F.col("m") / (1.0 + F.coalesce("d", F.lit(0.0)))).alias("avg_robustness_score"))
    both = df.sparkSession.createDataFrame([("Combo", True), ("Single", False)], "category string, is_combo boolean")
    return both.join(found, "is_combo", "left").drop("is_combo").fillna(0)


def combo_against_single(df: DataFrame, key: str = "is_combo") -> DataFrame:
    return aggregated(df, [key], [F.count("*").alias("n"), F.avg("sharpe").alias("mean_sharpe"), F.max("sharpe").alias("max_sharpe"), (100.0 * F.avg((F.col("sharpe") > 0).cast("double"))).alias("pct_positive")], {"median_sharpe": ("sharpe", 0.5)}).select(key, "n", "mean_sharpe", "median_sharpe", "max_sharpe", "pct_positive")


def discovery(df: DataFrame, n: int = 10) -> DataFrame:
    """last_discovery: the latest iteration among the best ``n``; stagnation: iterations since."""
    best = df.orderBy(F.desc("sharpe"), "config_id").limit(n).agg(F.max("iteration").alias("last_discovery"))
    return best.crossJoin(df.agg(F.max("iteration").alias("iterations"))).withColumn("stagnation", F.col("iterations") - F.col("last_discovery"))


def entropy(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Shannon entropy in bits of a histogram of equal bins from least to greatest."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)))
    counts = df.where(F.col(column).isNotNull()).crossJoin(ends).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.col("total")
    return counts.crossJoin(counts.agg(F.sum("n").alias("total"))).agg((-F.sum(p * F.log2(p))).alias("entropy"), F.count("*").alias("bins_used"))


def parameter_spread(df: DataFrame, parameters: list[str], early: int = 20, late: int = 50, bins: int = 20) -> DataFrame:
    """By strategy and parameter: least, greatest, mean, deviation, count, means and deviations of early iterations (up to ``early``) and late ones (the
    last ``late`` and what is before them by one; the later half if there are no more), and the entropy of ``bins`` equal bins; 0 under two values."""
    ends = df.agg(F.max("iteration").alias("_most")).select(F.when(F.col("_most") > late, F.col("_most") - late).otherwise(F.floor(F.col("_most") / 2)).alias("_late"))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).cast("double").alias("value")) for p in parameters]))
    own = df.select("strategy_type", "iteration", each.alias("x")).select("strategy_type", "iteration", "x.*").where("value is not null").crossJoin(ends)
    keys, x = ["strategy_type", "parameter"], F.col("value")
    is_early, is_late = F.col("iteration") <= early, F.col("iteration") >= F.col("_late")
    stats = own.groupBy(*keys).agg(F.min(x).alias("all_min"), F.max(x).alias("all_max"), F.avg(x).alias("all_mean"), F.stddev_samp(x).alias("all_std"), F.count(x).alias("all_count"), F.avg(F.when(is_early, x)).alias("early_mean"), F.stddev_samp(F.when(is_early, x)).alias("early_std"), F.avg(F.when(is_late, x)).alias("late_mean"), F.stddev_samp(F.when(is_late, x)).alias("late_std"))
    return stats.join(_entropies(own, keys, "value", bins), keys, "left").withColumn("entropy", F.when(F.col("all_count") < 2, 0.0).otherwise(F.coalesce("entropy", F.lit(0.0))))


def _entropies(df: DataFrame, keys: list[str], column: str, bins: int) -> DataFrame:
    """keys, entropy in bits of a histogram of ``bins`` equal bins between the least and the greatest value of each group."""
    ends = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count(column).alias("_all"))
    at = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))), F.lit(bins - 1)))
    counts = df.where(F.col(column).isNotNull()).join(ends, keys).groupBy(*keys, at.alias("_bin")).agg(F.count("*").alias("_n"), F.first("_all").alias("_all"))
    p = F.col("_n") / F.col("_all")
    return counts.groupBy(*keys).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def convergence(df: DataFrame, column: str = "sharpe", bins: int = 10, least: int = 5) -> DataFrame:
    """iteration_start, iteration_end, entropy, sample_size of consecutive windows of iterations (a tenth of them each), with initial and final
    entropy and the relative decrease between them; windows with fewer than ``least`` values, and fewer iterations than that, give no rows."""
    steps = df.select("iteration").distinct()
    # a table of iterations
    steps = steps.withColumns({"_k": F.row_number().over(Window.orderBy("iteration")) - 1, "_all": F.count("*").over(Window.partitionBy(F.lit(1)))})
    steps = steps.where(F.col("_all") >= 5).select("iteration", F.floor(F.col("_k") / F.greatest(F.lit(1), F.floor(F.col("_all") / 10))).alias("_w"))
    own = df.where(F.col(column).isNotNull()).join(steps, "iteration")
    spans = steps.groupBy("_w").agg(F.min("iteration").alias("iteration_start"), F.max("iteration").alias("iteration_end"))
    found = own.groupBy("_w").agg(F.count("*").alias("sample_size")).where(F.col("sample_size") >= least).join(_entropies(own, ["_w"], column, bins), "_w").join(spans, "_w")
    ends = found.agg(F.min_by("entropy", "_w").alias("initial_entropy"), F.max_by("entropy", "_w").alias("final_entropy"), F.count("*").alias("_c"))
    rate = F.when((F.col("_c") >= 2) & (F.col("initial_entropy") > 0), (F.col("initial_entropy") - F.col("final_entropy")) / F.col("initial_entropy")).otherwise(0.0)
    return found.crossJoin(ends).select("iteration_start", "iteration_end", "entropy", "sample_size", "initial_entropy", "final_entropy", rate.alias("convergence_rate"))


def uniqueness(df: DataFrame) -> DataFrame:
    """By iteration: configurations first seen in it, and all seen up to it; with the number of tests and of configurations, the share of
    duplicates, and the rate, new configurations per iteration after the first."""
    first = df.groupBy("config_id").agg(F.min("iteration").alias("iteration")).groupBy("iteration").agg(F.count("*").alias("new_configs"))
    # a table of iterations
    steps = df.select("iteration").distinct().join(first, "iteration", "left").fillna(0, ["new_configs"])
    seen = steps.withColumn("seen", F.sum("new_configs").over(Window.orderBy("iteration")))
    ends = seen.agg(F.min("iteration").alias("_lo"), F.max("iteration").alias("_hi"), F.min_by("seen", "iteration").alias("_from"), F.max("seen").alias("unique_configs"))
    total = df.agg(F.count("*").alias("total_tests"))
    out = seen.crossJoin(ends).crossJoin(total)
    rate = F.when(F.col("_hi") > F.col("_lo"), (F.col("unique_configs") - F.col("_from")) / (F.col("_hi") - F.col("_lo") + 1)).otherwise(0.0)
    return out.select("iteration", "new_configs", "seen", "total_tests", "unique_configs", (1.0 - F.col("unique_configs") / F.col("total_tests")).alias("duplicate_ratio"), rate.alias("uniqueness_rate"))


def coverage(df: DataFrame, x: str, y: str, cells: int = 10) -> DataFrame:
    """Share of a grid of cells x cells that has rows."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    cell = lambda c: F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 0).otherwise(F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) * cells / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))), F.lit(cells - 1)))
    return df.crossJoin(ends).agg(F.countDistinct(cell(x), cell(y)).alias("visited")).withColumn("coverage", F.col("visited") / float(cells * cells))


# --- merging and comparing tables of results ---


def merged(old: DataFrame, new: DataFrame, key: list[str], metric: str = "sharpe", limit: int | None = None) -> DataFrame:
    """The better row of each key in either table, ranked."""
    both = old.unionByName(new, allowMissingColumns=True)
    best = both.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*by(metric, False, *key)))).where("_r = 1").drop("_r")
    out = best.orderBy(*by(metric, False, *key))
    return out if limit is None else out.limit(limit)


def merged_counts(old: DataFrame, new: DataFrame, key: list[str], count: str) -> DataFrame:
    return old.unionByName(new).groupBy(*key).agg(F.sum(count).alias(count))


def compared(a: DataFrame, b: DataFrame, key: list[str], metrics: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(metric, max_diff, mean_diff, within) of two tables joined on their key."""
    both = a.select(*key, *metrics).join(b.select(*key, *[F.col(m).alias("_" + m) for m in metrics]), key)
    wide = both.agg(*[f(F.abs(F.col(m) - F.col("_" + m))).alias(f"{n}_{m}") for m in metrics for n, f in (("max", F.max), ("mean", F.avg))])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"max_{m}").alias("max_diff"), F.col(f"mean_{m}").alias("mean_diff")) for m in metrics]))
    return wide.select(rows.alias("r")).select("r.*").withColumn("within", F.col("max_diff") <= tolerance)


def distinct_hash(df: DataFrame, *columns: str) -> DataFrame:
    """config_hash of the named columns, the same in every run."""
    return df.withColumn("config_hash", F.xxhash64(F.to_json(F.struct(*sorted(columns)))))
