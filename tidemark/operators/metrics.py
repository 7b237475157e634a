"""Performance of equity curves and trades: one aggregation per run over the simulated bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.backtest import Costs
from tidemark.schema import KEYS, series, so_far

YEAR = 252
CAP = 999.99


def with_returns(curve: DataFrame, keys=KEYS) -> DataFrame:
    """ret (0 where the last equity is about 0, null at the first bar) and drawdown (positive) of an equity column."""
    was = F.lag("equity").over(series(keys))
    out = curve.withColumns({"_was": was, "_peak": F.max("equity").over(so_far(keys))})
    ret = F.when(F.abs("_was") > 1e-10, (F.col("equity") - F.col("_was")) / F.col("_was")).when(F.col("_was").isNotNull(), 0.0)
    down = F.when(F.col("_peak") > 0, (F.col("_peak") - F.col("equity")) / F.col("_peak")).otherwise(0.0)
    return out.withColumns({"ret": ret, "drawdown": down}).drop("_was", "_peak")


def sharpe(ret: str = "ret") -> Column:
    dev = F.stddev_pop(ret)
    return F.coalesce(F.when(dev > 0, F.avg(ret) * YEAR / (dev * YEAR**0.5)), F.lit(0.0))


def sortino(ret: str = "ret") -> Column:
    """Downside deviation over all returns."""
    dev = F.sqrt(F.avg(F.when(F.col(ret) < 0, F.col(ret) * F.col(ret)).when(F.col(ret).isNotNull(), 0.0)))
    return F.coalesce(F.when(dev > 0, F.avg(ret) * YEAR / (dev * YEAR**0.5)), F.lit(0.0))


def cagr(last: Column, years: Column, cash: float) -> Column:
    return F.when(years <= 0, 0.0).when(last <= 0, -1.0).otherwise(F.pow(last / cash, 1.0 / years) - 1.0)


def metrics(simulated: DataFrame, costs: Costs = Costs(), keys=KEYS) -> DataFrame:  # noqa: B008
    """total_return, cagr, sharpe, sortino, max_drawdown, calmar, win_rate, profit_factor, num_trades, turnover per run."""
    return performance(with_returns(simulated, keys), costs, keys)


def performance(returns: DataFrame, costs: Costs = Costs(), keys=KEYS) -> DataFrame:  # noqa: B008
    """metrics() of simulated bars that have ret and drawdown."""
    net = F.col("net_pnl")
    out = returns.groupBy(*keys).agg(
        F.max_by("equity", "ts").alias("final_equity"),
        ((F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))) / 86_400).cast("long").alias("_days"),
        sharpe().alias("sharpe"),
        sortino().alias("sortino"),
        F.max("drawdown").alias("max_drawdown"),
        F.count(net).alias("num_trades"),
        F.count(F.when(net > 0, 1)).alias("_wins"),
        F.coalesce(F.sum(F.when(net > 0, net)), F.lit(0.0)).alias("_won"),
        F.coalesce(F.sum(F.when(net < 0, -net)), F.lit(0.0)).alias("_lost"),
        F.coalesce(F.sum(F.abs(F.col("fill_price")) * costs.qty), F.lit(0.0)).alias("_traded"),
    )
    years = F.col("_days") / 365.25
    out = out.withColumns({"total_return": (F.col("final_equity") - costs.cash) / costs.cash, "cagr": cagr(F.col("final_equity"), years, costs.cash)})
    capital = (costs.cash + F.col("final_equity")) / 2.0
    return out.select(
        *keys,
        "final_equity",
        "total_return",
        "cagr",
        "sharpe",
        "sortino",
        "max_drawdown",
        F.when(F.col("max_drawdown") > 0, F.col("cagr") / F.col("max_drawdown")).otherwise(0.0).alias("calmar"),
        F.when(F.col("num_trades") > 0, F.col("_wins") / F.col("num_trades")).otherwise(0.0).alias("win_rate"),
        F.when(F.col("_lost") > 0, F.least(F.col("_won") / F.col("_lost"), F.lit(CAP))).when(F.col("_won") > 0, CAP).otherwise(0.0).alias("profit_factor"),
        "num_trades",
        F.when((years > 0) & (capital > 0), F.col("_traded") / capital / years).otherwise(0.0).alias("turnover"),
    )


def streaks(trade_rows: DataFrame, keys=KEYS, order: str = "trade_no") -> DataFrame:
    """max_losses, max_wins and avg_losing_streak of trades in order; a trade that isn't a win is a loss."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    out = trade_rows.withColumn("_win", F.col("net_pnl") > 0)
    out = out.withColumn("_run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "_win").orderBy(order)))
    runs = out.groupBy(*keys, "_win", "_run").agg(F.count("*").alias("n"))
    lost, won = F.when(~F.col("_win"), F.col("n")), F.when(F.col("_win"), F.col("n"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(lost), F.lit(0)).alias("max_losses"), F.coalesce(F.max(won), F.lit(0)).alias("max_wins"), F.coalesce(F.avg(lost), F.lit(0.0)).alias("avg_losing_streak"))
