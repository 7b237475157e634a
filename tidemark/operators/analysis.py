"""Returns, regimes and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators.metrics import sharpe, with_returns
from tidemark.schema import KEYS, series, so_far


def nearest(values: Column, p: float) -> Column:
    """The value at index round(p (n-1)) of a sorted array."""
    return F.get(values, F.round(p * (F.size(values) - 1)).cast("int"))


def return_distribution(curve: DataFrame, keys=KEYS) -> DataFrame:
    """n, mean, std (population), skew, kurtosis (excess), var_95, var_99 (nearest rank), cvar_95, cvar_99 (mean of the worst ceil(pn)) by series.
    Ranks come from a sort within the series; no array of a series is built."""
    r = with_returns(curve, keys).where("ret is not null")
    w = Window.partitionBy(*keys)
    r = r.withColumns({"_i": F.row_number().over(w.orderBy("ret", "ts")), "_n": F.count("*").over(w)})
    at = lambda p: F.abs(F.max(F.when(F.col("_i") == F.round(p * (F.col("_n") - 1)) + 1, F.col("ret"))))
    tail = lambda p: F.abs(F.avg(F.when(F.col("_i") <= F.greatest(F.ceil(p * F.col("_n")), F.lit(1)), F.col("ret"))))
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("std"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurtosis"), at(0.05).alias("var_95"), at(0.01).alias("var_99"), tail(0.05).alias("cvar_95"), tail(0.01).alias("cvar_99"))


def volatility_regimes(bars: DataFrame, n: int = 14, high: float = 1.5, low: float = 0.75, keys=KEYS) -> DataFrame:
    """regime by ATR against its nearest-rank median: high, low or neutral (also in the warm-up)."""
    df = ind.with_true_range(bars, keys).withColumn("atr", ind.atr(n, keys))
    w = Window.partitionBy(*keys)
    df = df.withColumns({"_i": F.row_number().over(w.orderBy(F.col("atr").asc_nulls_last(), "ts")), "_n": F.count("atr").over(w)})
    df = df.withColumn("_median", F.max(F.when(F.col("_i") == F.round(0.5 * (F.col("_n") - 1)) + 1, F.col("atr"))).over(w))
    regime = F.when(F.col("atr") > high * F.col("_median"), "high").when(F.col("atr") < low * F.col("_median"), "low").otherwise("neutral")
    return df.withColumn("regime", regime).drop("_i", "_n", "_median")


def trend_regimes(bars: DataFrame, n: int = 50, strong: float = 0.02, weak: float = 0.005, keys=KEYS) -> DataFrame:
    """regime by the one-bar slope of the simple mean: strong_up, up, neutral, down, strong_down."""
    df = bars.withColumn("_sma", ind.sma(n, keys=keys)).withColumn("slope", F.try_divide(F.col("_sma"), F.lag("_sma").over(series(keys))) - 1)
    s = F.col("slope")
    regime = F.when(s > strong, "strong_up").when(s > weak, "up").when(s < -strong, "strong_down").when(s < -weak, "down").otherwise("neutral")
    return df.withColumn("regime", regime).drop("_sma")


def drawdown_regimes(curve: DataFrame, steps: tuple[float, float, float] = (0.05, 0.1, 0.2), keys=KEYS) -> DataFrame:
    """regime by running drawdown: normal, shallow, deep, and from the last step on recovery."""
    d = F.col("drawdown")
    regime = F.when(d < steps[0], "normal").when(d < steps[1], "shallow").when(d < steps[2], "deep").otherwise("recovery")
    return with_returns(curve, keys).withColumn("regime", regime)


def by_regime(curve: DataFrame, regimes: DataFrame, trades: DataFrame, keys=KEYS) -> DataFrame:
    """Per regime: days, share of days, trades entered, win rate, mean net profit, compounded return and Sharpe.  Bars and entries that
    no regime matches count as neutral."""
    state = regimes.select(*keys, "ts", "regime")
    r = with_returns(curve.select(*keys, "ts", "equity"), keys).join(state, [*keys, "ts"], "left").withColumn("regime", F.coalesce("regime", F.lit("neutral")))
    # a product of factors, as a sum of logarithms and the parity of negative ones
    factor = 1.0 + F.coalesce("ret", F.lit(0.0))
    size = F.exp(F.sum(F.when(factor != 0, F.log(F.abs(factor)))))
    sign = F.when(F.count_if(factor == 0) > 0, 0.0).when(F.count_if(factor < 0) % 2 == 1, -1.0).otherwise(1.0)
    days = r.groupBy(*keys, "regime").agg(F.count("*").alias("days"), (size * sign - 1.0).alias("total_return"), sharpe().alias("sharpe"))
    days = days.withColumn("share", F.col("days") / F.sum("days").over(Window.partitionBy(*keys)))
    t = trades.join(state.withColumnRenamed("ts", "entry_ts"), [*keys, "entry_ts"], "left").withColumn("regime", F.coalesce("regime", F.lit("neutral")))
    t = t.groupBy(*keys, "regime").agg(F.count("*").alias("trades"), F.avg((F.col("net_pnl") > 0).cast("double")).alias("win_rate"), F.avg("net_pnl").alias("avg_net_pnl"))
    return days.join(t, [*keys, "regime"], "left").fillna(0, ["trades", "win_rate", "avg_net_pnl"])


# The regimes of each kind, all of which count in a concentration.
REGIMES = {"volatility": ("high", "neutral", "low"), "trend": ("strong_up", "up", "neutral", "down", "strong_down"), "drawdown": ("normal", "shallow", "deep", "recovery")}


def concentration(regime_rows: DataFrame, kind: str = "volatility", keys=KEYS) -> DataFrame:
    """hhi of the absolute returns of all regimes of the kind, score = (hhi - 1/n) / (1 - 1/n) within 0 and 1 (0 without returns), the dominant regime, its
    share (of positive returns, if its own is positive), and the penalty: 0 up to a score of 0.5, then rising to 1.  Of equal regimes the last
    in order dominates."""
    names = REGIMES[kind]
    of = {r: F.coalesce(F.max(F.when(F.col("regime") == r, F.col("total_return"))), F.lit(0.0)) for r in names}
    out = regime_rows.groupBy(*keys).agg(*[v.alias(f"_{r}") for r, v in of.items()])
    each = [F.col(f"_{r}") for r in names]
    total = sum((F.abs(c) for c in each[1:]), F.abs(each[0]))
    positive = sum((F.greatest(c, F.lit(0.0)) for c in each[1:]), F.greatest(each[0], F.lit(0.0)))
    out = out.withColumns({"_total": total, "_positive": positive})
    out = out.withColumn("_top", F.greatest(*[F.struct(F.abs(c).alias("size"), F.lit(i).alias("i"), F.lit(r).alias("regime"), c.alias("ret")) for i, (r, c) in enumerate(zip(names, each, strict=True))]))
    some, low = F.col("_total") >= 1e-10, 1.0 / len(names)
    hhi = sum((c * c for c in each[1:]), each[0] * each[0]) / (F.col("_total") * F.col("_total"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("hhi") - low) / (1.0 - low)))
    share = F.when((F.col("_positive") > 0) & (F.col("_top.ret") > 0), F.col("_top.ret") / F.col("_positive")).otherwise(F.col("_top.size") / F.col("_total"))
    out = out.withColumn("hhi", F.when(some, hhi).otherwise(0.0)).withColumn("score", F.when(some, score).otherwise(0.0))
    out = out.withColumns({"dominant": F.when(some, F.col("_top.regime")).otherwise(names[0]), "dominant_share": F.when(some, share).otherwise(0.0)})
    return out.select(*keys, "hhi", "score", "dominant", "dominant_share", F.when(F.col("score") <= 0.5, 0.0).otherwise((F.col("score") - 0.5) * 2.0).alias("penalty"))


def combined_score(vol: Column, trend: Column, drawdown: Column) -> Column:
    """Weighted mean of the scores that are there: .4/.4/.2, .5/.5 (trend), .7/.3 (drawdown) or volatility alone."""
    return F.when(trend.isNotNull() & drawdown.isNotNull(), 0.4 * vol + 0.4 * trend + 0.2 * drawdown).when(trend.isNotNull(), 0.5 * vol + 0.5 * trend).when(drawdown.isNotNull(), 0.7 * vol + 0.3 * drawdown).otherwise(vol)


def regime_scores(volatility: DataFrame, trend: DataFrame | None = None, drawdown: DataFrame | None = None, keys=KEYS) -> DataFrame:
    """keys, score, dominant and dominant_share of each kind of by_regime() rows given, and combined_score."""
    kinds = [(n, d) for n, d in (("volatility", volatility), ("trend", trend), ("drawdown", drawdown)) if d is not None]
    out = None
    for kind, rows in kinds:
        own = concentration(rows, kind, keys).select(*keys, *[F.col(c).alias(f"{kind}_{c}") for c in ("score", "dominant", "dominant_share")])
        out = own if out is None else out.join(own, [*keys], "left")
    score = lambda n: F.col(f"{n}_score") if n in dict(kinds) else F.lit(None).cast("double")
    return out.withColumn("combined_score", combined_score(score("volatility"), score("trend"), score("drawdown")))


def analyse(curve: DataFrame, bars: DataFrame, trades: DataFrame, keys=KEYS) -> dict[str, DataFrame]:
    """The three parts of an analysis: distribution of returns, regimes of volatility, trades."""
    return {"distribution": return_distribution(curve, keys), "regimes": by_regime(curve, volatility_regimes(bars, keys=keys), trades, keys), "trades": trade_analysis(excursions(bars, trades, keys), keys)}


def excursions(bars: DataFrame, trades: DataFrame, keys=KEYS) -> DataFrame:
    """Trades with mae, mfe (shares of the entry price), bars held (both ends included), entry_vol and ret.

    A range join turned into an equi-join: since trades of a series don't overlap, each bar belongs to the latest trade entered at or before it,
    found by a running last over bars and entries in one sort."""
    df = ind.with_true_range(bars, keys).withColumn("atr", ind.atr(14, keys))
    entered = trades.select(*keys, F.col("entry_ts").alias("ts"), F.struct("trade_no", "entry_ts", "exit_ts", "entry_price", "exit_price", "net_pnl").alias("_trade"))
    marked = df.join(entered, [*keys, "ts"], "left")
    # an exit bar may also be the next entry: it counts for both
    w = series(keys)
    held = marked.withColumns({"_open": F.last("_trade", ignorenulls=True).over(so_far(keys)), "_before": F.last("_trade", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    both = F.array_distinct(F.array("_open", "_before"))
    rows = held.select(*keys, "ts", "high", "low", "close", "atr", F.explode(F.filter(both, lambda t: t.isNotNull())).alias("t")).where("ts <= t.exit_ts")
    p = F.col("t.entry_price")
    out = rows.groupBy(*keys, "t").agg(F.max((p - F.col("low")) / p).alias("mae"), F.max((F.col("high") - p) / p).alias("mfe"), F.count("*").alias("bars_held"), F.max(F.when(F.col("ts") == F.col("t.entry_ts"), 100.0 * F.col("atr") / F.col("close"))).alias("entry_vol"))
    out = out.select(*keys, "t.*", F.greatest("mae", F.lit(0.0)).alias("mae"), F.greatest("mfe", F.lit(0.0)).alias("mfe"), "bars_held", "entry_vol")
    return out.withColumn("ret", (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, over rows that have both; 0 where either doesn't vary."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def trade_analysis(found: DataFrame, keys=KEYS) -> DataFrame:
    """Holding times, excursions, edge ratios (mfe over mae, finite ones) and the correlation of entry volatility with return and win.
    Order statistics are ranks from sorts within the series; no array of a series is built."""
    win = F.col("net_pnl") > 0
    edge = F.when(F.col("mae") > 0, F.col("mfe") / F.col("mae"))
    w = Window.partitionBy(*keys)
    found = found.withColumns({"_n": F.count("*").over(w)} | {f"_{c}": F.row_number().over(w.orderBy(c, "entry_ts")) - 1 for c in ("bars_held", "mae", "mfe")})
    at = lambda c, i: F.max(F.when(F.col(f"_{c}") == i, F.col(c)))
    index = lambda c, num, den: at(c, F.floor(F.col("_n") * num / den))
    agg = [F.count("*").alias("trades"), F.avg("bars_held").alias("mean_bars"), F.stddev_pop("bars_held").alias("std_bars"), F.min("bars_held").alias("min_bars"), F.max("bars_held").alias("max_bars"), index("bars_held", 1, 2).alias("median_bars"), index("bars_held", 1, 4).alias("p25_bars"), index("bars_held", 3, 4).alias("p75_bars")]
    for c in ("mae", "mfe"):
        agg += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"), F.max(c).alias(f"max_{c}"), index(c, 1, 2).alias(f"median_{c}"), index(c, 3, 4).alias(f"p75_{c}"), index(c, 9, 10).alias(f"p90_{c}"), F.avg(F.when(win, F.col(c))).alias(f"winners_{c}"), F.avg(F.when(~win, F.col(c))).alias(f"losers_{c}")]
    agg += [F.avg(edge).alias("mean_edge"), F.avg((edge > 1).cast("double")).alias("pct_edge_over_1"), correlation(F.col("entry_vol"), F.col("ret")).alias("corr_vol_return"), correlation(F.col("entry_vol"), win.cast("double")).alias("corr_vol_win")]
    return found.groupBy(*keys).agg(*agg)


def holding_histogram(found: DataFrame, edges: tuple[int, ...] = (5, 10, 20, 50), keys=KEYS) -> DataFrame:
    """bucket, trades, share, avg_return, win_rate of each holding time: every bucket of a series with trades, the overflow only if it has any."""
    held = F.col("bars_held")
    labels = [f"{lo + 1}-{hi} days" for lo, hi in zip((0, *edges), edges, strict=False)] + [f"{edges[-1] + 1}+ days"]
    at = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        at = F.when(held <= edges[i], i).otherwise(at)
    counts = found.groupBy(*keys, at.alias("_i")).agg(F.count("*").alias("trades"), F.avg("ret").alias("avg_return"), F.avg((F.col("net_pnl") > 0).cast("double")).alias("win_rate"))
    every = found.groupBy(*keys).agg(F.count("*").alias("_all")).withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(len(labels))])))
    out = every.join(counts, [*keys, "_i"], "left").fillna(0, ["trades", "avg_return", "win_rate"]).where(f"_i < {len(edges)} or trades > 0")
    return out.select(*keys, F.element_at(F.array(*map(F.lit, labels)), F.col("_i") + 1).alias("bucket"), "trades", (F.col("trades") / F.col("_all")).alias("share"), "avg_return", "win_rate")
