"""Sectors: dispersion, comparison with the universe, concentration, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import aggregated

from tidemark.operators.results import by


def performance(df: DataFrame) -> DataFrame:
    """17 aggregates by sector, the best mean Sharpe first; deviations are of the population."""
    stats = [f(c).alias(f"{n}_{c}") for c in ("sharpe", "cagr", "max_drawdown") for n, f in (("avg", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return df.groupBy("sector").agg(F.count("*").alias("n"), *stats, F.avg("sortino").alias("avg_sortino"), F.avg("win_rate").alias("avg_win_rate"), F.avg("num_trades").alias("avg_trades"), F.sum("num_trades").alias("total_trades")).orderBy(F.desc("avg_sharpe"), "sector")


def dispersion(df: DataFrame, metric: str) -> DataFrame:
    """cv is NaN where the mean is about 0; quartiles are interpolated."""
    m = F.col(metric)
    out = aggregated(df, ["sector"], [F.count(m).alias("n"), F.avg(m).alias("mean"), F.stddev_pop(m).alias("std"), F.min(m).alias("min"), F.max(m).alias("max")], {"median": (metric, 0.5), "q25": (metric, 0.25), "q75": (metric, 0.75)})
    return out.withColumns({"range": F.col("max") - F.col("min"), "cv": F.when(F.abs("mean") > 1e-10, F.col("std") / F.abs("mean")).otherwise(float("nan"))})


def against_universe(df: DataFrame) -> DataFrame:
    """Sector means less the means over all rows; relative_score = 2 sharpe + cagr - drawdown + sortino."""
    cols = ("sharpe", "cagr", "max_drawdown", "sortino")
    own = df.groupBy("sector").agg(*[F.avg(c).alias(c) for c in cols])
    out = own.crossJoin(df.agg(*[F.avg(c).alias("u_" + c) for c in cols]))
    out = out.select("sector", *[(F.col(c) - F.col("u_" + c)).alias("delta_" + c) for c in cols])
    score = 2 * F.col("delta_sharpe") + F.col("delta_cagr") - F.col("delta_max_drawdown") + F.col("delta_sortino")
    return out.withColumn("relative_score", score).orderBy(F.desc("relative_score"), "sector")


def best_strategies(df: DataFrame, metric: str) -> DataFrame:
    """The strategy with the best mean in each sector."""
    own = df.groupBy("sector", "strategy_type").agg(F.count("*").alias("n"), F.avg(metric).alias("avg_metric"), F.max(metric).alias("max_metric"))
    w = Window.partitionBy("sector").orderBy(*by("avg_metric", False, "strategy_type"))
    return own.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").orderBy(F.desc("avg_metric"), "sector")


def concentration(df: DataFrame, metric: str) -> DataFrame:
    """Total, percentage of all, and running percentage from the greatest down; a table of sectors only."""
    own = df.groupBy("sector").agg(F.sum(metric).alias("total"))
    everything = Window.partitionBy(F.lit(1))
    own = own.withColumn("pct", F.try_divide(100.0 * F.col("total"), F.sum("total").over(everything)))
    return own.withColumn("cumulative_pct", F.sum("pct").over(Window.orderBy(F.desc("total"), "sector").rowsBetween(Window.unboundedPreceding, 0)))


def ranked(df: DataFrame) -> DataFrame:
    """Ranks by mean Sharpe, CAGR and drawdown, and their mean."""
    own = df.groupBy("sector").agg(F.avg("sharpe").alias("avg_sharpe"), F.avg("cagr").alias("avg_cagr"), F.avg("max_drawdown").alias("avg_drawdown"))
    ranks = {"sharpe_rank": by("avg_sharpe", False, "sector"), "cagr_rank": by("avg_cagr", False, "sector"), "drawdown_rank": by("avg_drawdown", True, "sector")}
    own = own.withColumns({k: F.row_number().over(Window.orderBy(*v)) for k, v in ranks.items()})
    return own.withColumn("composite_rank", (F.col("sharpe_rank") + F.col("cagr_rank") + F.col("drawdown_rank")) / 3.0)


def of(df: DataFrame, sectors: list[str]) -> DataFrame:
    """Rows of the sectors; all rows if none is named."""
    return df.where(F.col("sector").isin(sectors)) if sectors else df


def strategy_sectors(df: DataFrame, least: int = 5) -> DataFrame:
    return aggregated(df, ["strategy_type", "sector"], [F.count("*").alias("n"), F.avg("sharpe").alias("mean_sharpe")], {"median_sharpe": ("sharpe", 0.5)}).where(F.col("n") >= least)
