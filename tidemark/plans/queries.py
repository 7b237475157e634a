"""Queries over the driver's tables: one or more per operator, with doubles rounded so that results can be compared."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import chunks
from tidemark.functions import indicators as ind
from tidemark.functions import recurrence as rec
from tidemark.operators import analysis, cluster, explore, leaderboard, long_series, results, scan, sector, statistics, sweep, validation
from tidemark.operators import signals as sig
from tidemark.operators.backtest import Costs, along_path, fills, long_only, paired, pyramid, trades, turtle_size, volatility_size
from tidemark.operators.metrics import metrics, streaks, with_returns
from tidemark.sources import bars as src
from tidemark.sources import quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
COSTS = Costs(cash=1_000_000.0, qty=1.0, fee_bps=10.0, slip_bps=5.0)


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 4, **other: int) -> DataFrame:
    """``other``: digits of some columns.  Where short decimals meet in a mean or a product, more digits keep ties out."""
    return df.select(*[(F.round(c, other.get(c, digits)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def nation(spark: SparkSession, d: str) -> DataFrame:
    return src.bars_nation(spark, d)


def keyed(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return rounded(df.select("symbol", "ts", *columns), digits)


def flags(df: DataFrame, *columns: str) -> DataFrame:
    """Booleans that may be null as integers."""
    return df.withColumns({c: F.col(c).cast("int") for c in columns})


def result_table(spark: SparkSession, d: str) -> DataFrame:
    """A table in the shape of sweep results, from orders by nation, market segment and priority."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    c = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = read("orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    p = F.col("o_totalprice")
    o = o.groupBy(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"), F.col("c_mktsegment").alias("strategy_type"), F.col("o_orderpriority").alias("priority")).agg(
        F.round(F.avg(p) / 100_000 - 2.5, 4).alias("sharpe"), F.round(F.min(p) / F.max(p) - 0.05, 4).alias("cagr"), F.round(1 - F.min(p) / F.max(p), 4).alias("max_drawdown"), F.round(F.max(p) / 200_000 - 1, 4).alias("sortino"), F.round(F.avg((p > 250_000).cast("double")), 4).alias("win_rate"), F.count("*").alias("num_trades"), F.round(F.sum(p) / 1_000_000 - 1, 4).alias("total_return")
    )
    lookback = F.substring("priority", 1, 1).cast("int")
    return o.select("symbol", "sector", "strategy_type", F.concat_ws("-", "strategy_type", "priority").alias("config_id"), (lookback * 5).alias("entry_lookback"), F.length("strategy_type").alias("exit_lookback"), "sharpe", "cagr", "max_drawdown", "sortino", "win_rate", "num_trades", "total_return", lookback.alias("iteration"))


# --- sources and quality ---


@query
def src_bars_event(spark, d):
    return rounded(src.bars_event(spark, d))


@query
def src_bars_nation(spark, d):
    return rounded(nation(spark, d))


@query
def src_date_range(spark, d):
    return src.date_range(nation(spark, d))


@query
def src_by_year(spark, d):
    return src.by_year(nation(spark, d)).select("symbol", "year", "bars")


@query
def join_sector(spark, d):
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    dim = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))
    return src.with_sector(nation(spark, d).drop("sector"), dim).groupBy("sector").agg(F.count("*").alias("bars"), F.countDistinct("symbol").alias("symbols"))


def _orders_as_bars(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), "o_orderkey", F.col("o_totalprice").alias("open"), (F.col("o_totalprice") + F.col("o_orderkey") % 3 - 1).alias("high"), (F.col("o_totalprice") - F.col("o_orderkey") % 5 + 1).alias("low"), F.col("o_totalprice").alias("close"))


@query
def dq_duplicates(spark, d):
    return quality.duplicates(_orders_as_bars(spark, d))


@query
def dq_disorder(spark, d):
    return quality.disorder(_orders_as_bars(spark, d), "o_orderkey")


@query
def dq_gaps(spark, d):
    return quality.gaps(nation(spark, d), 7)


@query
def dq_invalid(spark, d):
    return quality.invalid_prices(_orders_as_bars(spark, d))


@query
def dq_report(spark, d):
    return quality.report(_orders_as_bars(spark, d), "o_orderkey")


# --- window indicators ---


@query
def ind_donchian(spark, d):
    up, low = ind.donchian(20)
    return keyed(nation(spark, d).withColumns({"upper": up, "lower": low}), "upper", "lower")


@query
def ind_moving(spark, d):
    cols = {"sma": ind.sma(20), "sma_volume": ind.sma(10, "volume"), "max_close": ind.rolling_max(20), "max_high": ind.rolling_max(20, "high"), "min_close": ind.rolling_min(20), "min_low": ind.rolling_min(20, "low"), "std": ind.rolling_std(20), "proximity": ind.high_proximity(50)}
    return keyed(nation(spark, d).withColumns(cols), *cols)


@query
def ind_bollinger(spark, d):
    cols = dict(zip(("middle", "upper", "lower", "bandwidth"), ind.bollinger(20, 2.0), strict=True))
    return keyed(nation(spark, d).withColumns(cols), *cols)


@query
def ind_starc(spark, d):
    cols = dict(zip(("middle", "upper", "lower"), ind.starc(20, 10, 2.0), strict=True))
    return keyed(ind.with_true_range(nation(spark, d)).withColumns(cols | {"atr": ind.atr(10)}), "true_range", "atr", *cols)


@query
def ind_aroon(spark, d):
    up, down = ind.aroon(25)
    return keyed(ind.with_bar_number(nation(spark, d)).withColumns({"up": up, "down": down}), "up", "down")


@query
def ind_oscillators(spark, d):
    b = ind.cci(nation(spark, d), 20)
    return keyed(b.withColumns({"williams": ind.williams_r(14), "roc": ind.roc(10), "momentum": ind.momentum(50)}), "cci", "williams", "roc", "momentum")


@query
def ind_stochastic(spark, d):
    return keyed(ind.stochastic(nation(spark, d), 10, 5, 5), "stoch_k", "stoch_d")


@query
def ind_ichimoku(spark, d):
    return keyed(ind.ichimoku(nation(spark, d), 9, 26, 52), "tenkan", "kijun", "senkou_a", "senkou_b", "cloud")


@query
def ind_ranges(spark, d):
    up, low = ind.breakout_levels(0.5)
    plus, minus = ind.directional_moves()
    b = ind.calendar_range(nation(spark, d).withColumns({"prior_range": ind.prior_range(), "level_up": up, "level_down": low, "plus_dm": plus, "minus_dm": minus}), 2, "month")
    return keyed(b, "prior_range", "level_up", "level_down", "plus_dm", "minus_dm", "or_high", "or_low", "or_complete")


@query
def ind_approx(spark, d):
    cols = dict(zip(("sar_basic", "sar_upper", "sar_lower", "sar_up"), ind.psar_approx(14, 0.12), strict=True)) | {"st_up": ind.supertrend_approx(10, 0.3)} | dict(zip(("box_top", "box_bottom"), ind.darvas_approx(3), strict=True))
    return keyed(flags(ind.cci_approx(ind.IndicatorSet().add(**cols).apply(nation(spark, d)), 20), "sar_up", "st_up"), "cci_approx", *cols)


# --- recurrences ---


def _along(bars: DataFrame, /, **steppers) -> DataFrame:
    return rec.along(bars, ["symbol"], ["ts"], steppers)


@query
def rec_ema(spark, d):
    return keyed(_along(nation(spark, d), a=rec.ema(20, "ema"), b=rec.wilder(14, "close", "wilder"), c=rec.ema_adjusted(20)), "ema", "wilder", "ema_adjusted")


@query
def rec_rsi_macd(spark, d):
    return keyed(_along(nation(spark, d), a=rec.rsi(14), b=rec.macd()), "rsi", "macd", "macd_signal", "macd_hist")


@query
def rec_dmi(spark, d):
    return keyed(_along(nation(spark, d), a=rec.dmi(14)), "plus_di", "minus_di", "adx")


@query
def rec_heikin_ashi(spark, d):
    return keyed(_along(nation(spark, d), a=rec.heikin_ashi()), "ha_open", "ha_high", "ha_low", "ha_close", digits=6)


@query
def rec_adjusted(spark, d):
    b = ind.with_true_range(nation(spark, d))
    out = _along(b, a=rec.wilder_adjusted(14, "true_range", "atr_adjusted"), b=rec.dmi_adjusted(14), c=rec.heikin_ashi_adjusted())
    return keyed(out, "atr_adjusted", "adjusted_plus_di", "adjusted_minus_di", "adjusted_adx", *[f"adjusted_ha_{c}" for c in ("open", "high", "low", "close")], digits=8)


@query
def rec_supertrend(spark, d):
    b = ind.with_true_range(nation(spark, d)).withColumn("atr", ind.atr(10))
    return keyed(flags(_along(b, a=rec.supertrend(0.3), b=rec.supertrend(0.3, classic=True, prefix="classic")), "st_up", "classic_up"), "st_up", "st_value", "classic_up", "classic_value")


@query
def rec_parabolic_sar(spark, d):
    return keyed(flags(_along(nation(spark, d), a=rec.parabolic_sar()), "sar_up"), "sar", "sar_up")


@query
def rec_darvas(spark, d):
    return keyed(flags(_along(nation(spark, d), a=rec.darvas(2)), "box_complete"), "box_top", "box_bottom", "box_complete")


# --- one series over many tasks ---


def one(spark: SparkSession, d: str) -> DataFrame:
    """All events as one series, in chunks of a fraction of it."""
    return chunks.chunked(src.bars_one(spark, d), rows=600)


@query
def one_means(spark, d):
    means = [chunks.Smoothing("ema", "close", 20, 2.0 / 21), chunks.Smoothing("wilder", "close", 14, 1.0 / 14)]
    return keyed(chunks.smoothed(one(spark, d), means), "ema", "wilder")


@query
def one_rsi(spark, d):
    return keyed(chunks.rsi(one(spark, d)), "rsi")


@query
def one_macd(spark, d):
    return keyed(chunks.macd(one(spark, d)), "macd", "macd_signal", "macd_hist")


@query
def one_dmi(spark, d):
    return keyed(chunks.dmi(one(spark, d)), "plus_di", "minus_di", "adx")


def _one_simulated(spark, d) -> DataFrame:
    """Momentum over a bar: in on a rise over 5 %, out on a fall over 3 %."""
    b = chunks.previous(one(spark, d), ["close"], "_p")
    change = F.col("close") / F.col("_p.close") - 1
    return long_series.long_only(b.withColumns({"raw_entry": change > 0.05, "raw_exit": change < -0.03}).drop("_p"), COSTS)


@query
def one_long_only(spark, d):
    out = _one_simulated(spark, d).select("symbol", "ts", "position_state", "entry_fill", "exit_fill", "fill_price", "fill_fees", "cash", "equity", "drawdown")
    return rounded(out, fill_price=8, fill_fees=10, drawdown=8)


@query
def one_metrics(spark, d):
    return rounded(long_series.metrics(_one_simulated(spark, d), COSTS))


# --- strategies ---

#: Parameters under which each strategy trades on the weekly bars.
PARAMS = {"tsmom": {"lookback": 50}, "starc": {"k": 0.1}, "keltner": {"k": 0.1}, "high_52w": {"n": 52, "entry_pct": 0.9, "exit_pct": 0.5}, "high_52w_momentum": {"n": 52, "entry_pct": 0.9, "exit_pct": 0.5}, "high_52w_trailing": {"n": 52, "entry_pct": 0.9, "trail": 0.3}, "bollinger_squeeze": {"k": 0.5, "squeeze": 0.5}, "rsi": {"n": 5, "oversold": 45.0, "overbought": 55.0}, "rsi_bollinger": {"n": 5, "oversold": 45.0, "k": 0.5}, "confluence": {"n": 5, "oversold": 45.0, "overbought": 55.0}, "dmi_adx": {"threshold": 12.0}, "macd_adx": {"threshold": 8.0}} | {s: {"k": 0.2} for s in ("supertrend", "supertrend_volume", "supertrend_confirmed", "supertrend_cooldown")} | {"supertrend_asymmetric": {"entry_k": 0.1, "exit_k": 0.3}}


def _strategy_query(name: str):
    def run(spark, d):
        out = sig.STRATEGIES[name](nation(spark, d), **PARAMS.get(name, {}))
        return out.select("symbol", "ts", "raw_entry", "raw_exit", *[c for c in ("raw_entry_short", "raw_exit_short") if c in out.columns])

    return run


for _name in sig.STRATEGIES:
    QUERIES[f"str_{_name}"] = _strategy_query(_name)


@query
def str_vote_majority(spark, d):
    return sig.combine(nation(spark, d), sig.multi_horizon("donchian", [10, 20, 40])).select("symbol", "ts", "raw_entry", "raw_exit")


@query
def str_vote_weighted(spark, d):
    return sig.combine(nation(spark, d), sig.multi_horizon("tsmom", [5, 10, 20]), "weighted", [5, 10, 20]).select("symbol", "ts", "raw_entry", "raw_exit")


@query
def str_vote_unanimous(spark, d):
    return sig.combine(nation(spark, d), [("donchian", {}), ("roc", {})], "unanimous").select("symbol", "ts", "raw_entry", "raw_exit")


# --- simulation ---


def simulated(spark, d) -> DataFrame:
    return long_only(sig.donchian(nation(spark, d)), COSTS)


@query
def bt_long_only(spark, d):
    return keyed(simulated(spark, d), "position_state", "entry_fill", "exit_fill", "fill_price", "fill_fees", "cash", "equity")


@query
def bt_trades(spark, d):
    return rounded(trades(simulated(spark, d)).drop("trade_no"))


@query
def bt_paired_fills(spark, d):
    return rounded(paired(fills(simulated(spark, d))))


@query
def bt_long_short(spark, d):
    return keyed(along_path(sig.donchian(nation(spark, d)), COSTS), "position_state", "fill_side", "fill_price", "cash", "equity")


@query
def bt_sized(spark, d):
    b = ind.with_true_range(sig.donchian(nation(spark, d))).withColumn("atr", ind.atr(14))
    return keyed(along_path(b.withColumn("size", volatility_size(1e11, F.col("atr"), 100.0)), COSTS, "long_only", "size"), "position_qty", "cash", "equity")


@query
def bt_turtle_size(spark, d):
    b = _along(ind.with_true_range(nation(spark, d)), a=rec.wilder(20, "true_range", "atr_w"))
    return keyed(b.withColumn("size", turtle_size(1e15, F.col("atr_w"))), "atr_w", "size", digits=2)


@query
def bt_pyramid(spark, d):
    b = _along(ind.with_true_range(sig.donchian(nation(spark, d))), a=rec.wilder(14, "true_range", "atr_w"))
    return keyed(pyramid(b, "atr_w", COSTS, units=3, k=0.1), "units", "exit_units", "avg_entry_price", "net_pnl", "equity")


@query
def met_metrics(spark, d):
    return rounded(metrics(simulated(spark, d), COSTS))


@query
def met_streaks(spark, d):
    return rounded(streaks(trades(simulated(spark, d))))


@query
def out_drawdown_curve(spark, d):
    return keyed(leaderboard.drawdown_curve(simulated(spark, d)), "drawdown")


# --- sweeps ---


@query
def swp_donchian(spark, d):
    return rounded(sweep.donchian_sweep(nation(spark, d), sweep.grid(entry=[10, 20, 40, 55], exit=[5, 10, 20]), COSTS).drop("config_id"))


@query
def swp_strategies(spark, d):
    grids = {"ma_cross": sweep.grid(fast=[5, 10], slow=[20, 50]), "tsmom": sweep.grid(lookback=[20, 50]), "high_52w": sweep.grid(n=[26, 52], entry_pct=[0.9], exit_pct=[0.5]), "opening_range": sweep.grid(n=[2], period=["month"])}
    return rounded(sweep.multi_strategy_sweep(nation(spark, d), grids, COSTS).select("symbol", "strategy_type", "config_id", "total_return", "sharpe", "max_drawdown", "num_trades"))


@query
def swp_costs(spark, d):
    return rounded(sweep.cost_sensitivity(sig.donchian(nation(spark, d)), [0.0, 25.0, 100.0], 1.0, COSTS.cash))


@query
def swp_neighbours(spark, d):
    # lookbacks of five apart become neighbours
    r = result_table(spark, d).withColumn("entry_lookback", (F.col("entry_lookback") / 5).cast("int"))
    return rounded(sweep.neighbours(r).drop("value"), 8, variance=12)


# --- results ---


@query
def rel_query(spark, d):
    return results.Query(min_sharpe=-0.2, max_drawdown=0.9, min_trades=5, min_win_rate=0.3, limit=50).run(result_table(spark, d)).select("symbol", "config_id", "sharpe", "max_drawdown")


@query
def rel_top_per_sector(spark, d):
    return results.top_per(result_table(spark, d), "sector", 3, "sharpe").select("sector", "symbol", "config_id", "sharpe", "rank")


@query
def rel_heatmap(spark, d):
    return results.heatmap(result_table(spark, d), "sharpe")


@query
def rel_split(spark, d):
    train, test = results.split_by_date(nation(spark, d), "1998-01-01 00:00:00", 30)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).groupBy("symbol", "part").agg(F.count("*").alias("bars"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query
def rel_slice(spark, d):
    return keyed(results.sliced(nation(spark, d), 10, 20, ["symbol"]), "close")


@query
def agg_summary(spark, d):
    return rounded(results.summary(result_table(spark, d)))


@query
def agg_sensitivity(spark, d):
    return rounded(results.sensitivity(result_table(spark, d), "sharpe"))


@query
def agg_compare(spark, d):
    return rounded(results.compare_strategies(result_table(spark, d)))


@query
def agg_strategy_summary(spark, d):
    return rounded(results.strategy_summary(result_table(spark, d)))


@query
def agg_symbol_summary(spark, d):
    return rounded(results.symbol_summary(result_table(spark, d)))


@query
def agg_matrix(spark, d):
    names = [f"NATION_{i}" for i in range(25)]  # the whole dimension
    return rounded(results.matrix(result_table(spark, d), names))


@query
def agg_robustness(spark, d):
    return rounded(results.robustness(result_table(spark, d), 10))


@query
def agg_top_performers(spark, d):
    return rounded(results.top_performers(result_table(spark, d)))


@query
def agg_universal_winners(spark, d):
    return rounded(results.universal_winners(result_table(spark, d), 10))


@query
def agg_parameters(spark, d):
    return rounded(results.parameter_stats(result_table(spark, d), "entry_lookback"))


@query
def agg_best_per_symbol(spark, d):
    return results.top_per(result_table(spark, d), "symbol", 1, "sharpe", prefer_traded=True).select("symbol", "config_id", "sharpe")


@query
def agg_best_per_strategy(spark, d):
    return results.top_per(result_table(spark, d), "strategy_type", 1, "sharpe", prefer_traded=True).select("strategy_type", "symbol", "config_id", "sharpe")


@query
def agg_combos(spark, d):
    r = result_table(spark, d).withColumn("components", F.array("strategy_type", F.concat(F.lit("p"), F.col("iteration").cast("string"))))
    return rounded(results.combo_components(r))


@query
def agg_synergy(spark, d):
    r = result_table(spark, d)
    others = r.select("strategy_type").distinct().select(F.col("strategy_type").alias("other"))
    # each configuration with each strategy as its second component: five rows of a dimension
    combos = r.crossJoin(others).withColumn("components", F.array("strategy_type", "other")).withColumn("config_id", F.concat_ws("+", "config_id", "other"))
    return rounded(results.synergy(combos, r))


@query
def agg_combo_single(spark, d):
    return rounded(results.combo_against_single(result_table(spark, d).withColumn("is_combo", F.col("iteration") > 2)))


@query
def agg_discovery(spark, d):
    return results.discovery(result_table(spark, d))


@query
def agg_entropy(spark, d):
    return rounded(results.entropy(result_table(spark, d), "max_drawdown"))


@query
def agg_uniqueness(spark, d):
    return rounded(results.uniqueness(result_table(spark, d)))


def _combos(spark, d) -> DataFrame:
    return result_table(spark, d).withColumns({"is_combo": F.col("iteration") > 2, "voting_method": F.when(F.col("iteration") == 3, "majority").when(F.col("iteration") == 4, "weighted").otherwise("unanimous")})


@query
def agg_voting_methods(spark, d):
    return rounded(results.voting_methods(_combos(spark, d)))


@query
def agg_combo_robustness(spark, d):
    return rounded(results.combo_robustness(_combos(spark, d)))


@query
def agg_parameter_spread(spark, d):
    return rounded(results.parameter_spread(result_table(spark, d), ["num_trades", "sortino"], early=2, late=3))


@query
def agg_convergence(spark, d):
    return rounded(results.convergence(result_table(spark, d)))


@query
def agg_coverage(spark, d):
    return rounded(results.coverage(result_table(spark, d), "sharpe", "cagr"))


@query
def join_merge_boards(spark, d):
    r = result_table(spark, d).select("symbol", "config_id", "sharpe")
    return results.merged(r.where("sharpe > -1"), r.where("sharpe < 0.2"), ["symbol", "config_id"])


@query
def join_compare(spark, d):
    r = result_table(spark, d)
    return rounded(results.compared(r, r.withColumn("sharpe", F.col("sharpe") + 0.001), ["symbol", "config_id"], ["sharpe", "cagr"]))


# --- sectors ---


@query
def sec_performance(spark, d):
    return rounded(sector.performance(result_table(spark, d)))


@query
def sec_dispersion(spark, d):
    return rounded(sector.dispersion(result_table(spark, d), "sharpe"))


@query
def sec_universe(spark, d):
    return rounded(sector.against_universe(result_table(spark, d)))


@query
def sec_best(spark, d):
    return rounded(sector.best_strategies(result_table(spark, d), "sharpe"))


@query
def sec_concentration(spark, d):
    return rounded(sector.concentration(result_table(spark, d), "total_return"))


@query
def sec_ranked(spark, d):
    return rounded(sector.ranked(result_table(spark, d)))


@query
def sec_strategies(spark, d):
    return rounded(sector.strategy_sectors(result_table(spark, d)))


# --- statistics ---


def _buy_and_hold(spark, d) -> DataFrame:
    return nation(spark, d).withColumn("equity", F.col("close"))


@query
def stat_sample(spark, d):
    return rounded(statistics.sample_statistics(result_table(spark, d), ["sector"], "sharpe"))


@query
def stat_p_values(spark, d):
    return rounded(statistics.adjusted(statistics.mean_p_values(result_table(spark, d).withColumn("sharpe", F.col("sharpe") + 0.05), ["config_id"], "sharpe")))


@query
def stat_bootstrap(spark, d):
    return rounded(statistics.bootstrap_sharpe(with_returns(_buy_and_hold(spark, d)), ["symbol"]))


@query
def stat_bootstrap_mean(spark, d):
    return rounded(statistics.bootstrap(result_table(spark, d), ["sector"], "sharpe"))


@query
def stat_permutation(spark, d):
    r = result_table(spark, d)
    return rounded(statistics.permutation_test(r, ["sector"], "sharpe", F.col("strategy_type") == "BUILDING"))


@query
def ana_distribution(spark, d):
    return rounded(analysis.return_distribution(_buy_and_hold(spark, d)))


@query
def ana_volatility_regimes(spark, d):
    return analysis.volatility_regimes(nation(spark, d), 10).select("symbol", "ts", "regime")


@query
def ana_trend_regimes(spark, d):
    return analysis.trend_regimes(nation(spark, d)).select("symbol", "ts", "regime")


@query
def ana_drawdown_regimes(spark, d):
    return analysis.drawdown_regimes(simulated(spark, d)).select("symbol", "ts", "regime")


@query
def ana_by_regime(spark, d):
    s = simulated(spark, d)
    return rounded(analysis.by_regime(s, analysis.volatility_regimes(nation(spark, d), 10), trades(s)))


@query
def ana_regime_concentration(spark, d):
    s = simulated(spark, d)
    return rounded(analysis.concentration(analysis.by_regime(s, analysis.trend_regimes(nation(spark, d)), trades(s)), "trend"))


@query
def ana_regime_scores(spark, d):
    s = simulated(spark, d)
    b, t = nation(spark, d), trades(s)
    kinds = (analysis.volatility_regimes(b, 10), analysis.trend_regimes(b), analysis.drawdown_regimes(s))
    return rounded(analysis.regime_scores(*[analysis.by_regime(s, k, t) for k in kinds]))


@query
def ana_excursions(spark, d):
    return rounded(analysis.excursions(nation(spark, d), trades(simulated(spark, d))).select("symbol", "entry_ts", "exit_ts", "mae", "mfe", "bars_held", "ret"))


@query
def ana_trades(spark, d):
    return rounded(analysis.trade_analysis(analysis.excursions(nation(spark, d), trades(simulated(spark, d)))))


@query
def ana_holding(spark, d):
    return rounded(analysis.holding_histogram(analysis.excursions(nation(spark, d), trades(simulated(spark, d)))))


# --- validation, clusters, leaderboards ---


@query
def val_folds(spark, d):
    return validation.walk_forward_folds(spark, 600)


@query
def val_cv(spark, d):
    return validation.cv_splits(spark, 600, 5, 5, 300)


@query
def val_walk_forward(spark, d):
    return rounded(validation.fold_results(_buy_and_hold(spark, d), 100, 5, 30, 30).select("symbol", "fold", "is_sharpe", "oos_sharpe", "oos_return"))


@query
def val_grades(spark, d):
    return rounded(validation.walk_forward(validation.fold_results(_buy_and_hold(spark, d), 100, 5, 30, 30)))


@query
def val_thirds(spark, d):
    return rounded(validation.equity_folds(_buy_and_hold(spark, d)))


@query
def val_pooled(spark, d):
    return rounded(validation.pooled_walk_forward(validation.equity_folds(_buy_and_hold(spark, d))))


@query
def stat_symbol_confidence(spark, d):
    return rounded(statistics.symbol_confidence(result_table(spark, d), ["config_id"]))


@query
def stat_sector_confidence(spark, d):
    return rounded(statistics.sector_confidence(result_table(spark, d), ["config_id"]))


@query
def clu_kmeans(spark, d):
    found, _ = cluster.cluster(results.robustness(result_table(spark, d)), ["mean_sharpe", "std_sharpe", "win_ratio"], 3)
    return cluster.cluster_summary(found, ["mean_sharpe"])


@query
def clu_diverse(spark, d):
    return cluster.diverse(results.robustness(result_table(spark, d)), 6, ["mean_sharpe", "win_ratio"], "mean_sharpe").select("config_id", "cluster", "mean_sharpe")


@query
def lb_across_symbols(spark, d):
    return rounded(leaderboard.across_symbols(result_table(spark, d)))


@query
def lb_robust_score(spark, d):
    a = leaderboard.across_symbols(result_table(spark, d))
    return rounded(a.select("config_id", leaderboard.robust_score(a).alias("score"), leaderboard.robust_score(a, leaderboard.profile_weights("trend_options")).alias("trend_score")), 12)


@query
def lb_board(spark, d):
    return rounded(leaderboard.board(leaderboard.across_symbols(result_table(spark, d)), "avg_sharpe", 8, per_strategy=2).select("rank", "config_id", "avg_sharpe"))


@query
def lb_ranked_by_profile(spark, d):
    a = leaderboard.across_symbols(result_table(spark, d))
    rows = [leaderboard.ranked_by(a, f"composite:{p}", 10, per_strategy=3).select(F.lit(p).alias("profile"), "rank", "config_id", "rank_value") for p in leaderboard.PROFILES]
    return rounded(reduce(DataFrame.unionByName, rows))


@query
def lb_ranked_by_metric(spark, d):
    a = leaderboard.across_symbols(result_table(spark, d))
    rows = [leaderboard.ranked_by(a, m, 5).select(F.lit(m).alias("metric"), "rank", "config_id", "rank_value") for m in leaderboard.RANKINGS]
    return rounded(reduce(DataFrame.unionByName, rows))


@query
def lb_common_dates(spark, d):
    return leaderboard.common_dates(src.bars_event(spark, d))


def _events_held(spark, d) -> DataFrame:
    return src.bars_event(spark, d).select("symbol", "ts", (F.col("close") + 1000.0).alias("equity"))


@query
def lb_portfolio(spark, d):
    return rounded(leaderboard.combine_curves(_events_held(spark, d)), 3)


@query
def lb_portfolio_inverse(spark, d):
    return rounded(leaderboard.combine_curves(_events_held(spark, d), "inverse_volatility", "geometric"), 3)


@query
def lb_portfolio_summary(spark, d):
    found = leaderboard.portfolio_summary(_events_held(spark, d), "inverse_volatility")
    return rounded(found.withColumn("largest_weight", F.array_max(F.map_values("weights"))).drop("weights"))


@query
def exp_untested(spark, d):
    """Ranges of orders by customer, finished ones taken for tested."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    r = o.select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("config_hash"), F.to_date("o_orderdate").alias("tested_start"), F.date_add(F.to_date("o_orderdate"), F.floor(F.col("o_totalprice") / 1000).cast("int")).alias("tested_end"))
    return explore.untested(r.where("o_orderstatus <> 'F'"), r.where("o_orderstatus = 'F'")).drop("o_orderstatus")


@query
def lb_covered(spark, d):
    """Customers whose orders cover enough of all orders' days."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    spans = o.groupBy(F.col("o_custkey").alias("symbol")).agg(F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))
    window = o.agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    return leaderboard.covered(spans.crossJoin(F.broadcast(window)), F.col("start"), F.col("end")).select("symbol", "first", "last")


@query
def exp_samples(spark, d):
    return explore.sample_table(spark, "donchian", 50)


@query
def exp_coverage(spark, d):
    tested = result_table(spark, d).select(F.lit("donchian").alias("strategy_type"), F.create_map(F.lit("entry"), F.col("num_trades").cast("double") * 7, F.lit("exit"), F.col("entry_lookback").cast("double")).alias("params"))
    return explore.visits(tested, "donchian")


@query
def out_scan(spark, d):
    return rounded(scan.scan(nation(spark, d), [("donchian", {}), ("high_52w", PARAMS["high_52w"]), ("roc", {})], fresh=10))


@query
def out_latest(spark, d):
    return rounded(scan.latest(sig.donchian(nation(spark, d)), 10))


@query
def out_artifact(spark, d):
    return scan.artifact(sig.donchian(nation(spark, d)), "donchian", {"entry": 20, "exit": 10}, ["dc_entry_upper", "dc_exit_lower"])


@query
def out_candles(spark, d):
    return rounded(scan.candles(nation(spark, d), "NATION_2"))
