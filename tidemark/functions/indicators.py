"""Indicators as window expressions.  The value at a bar uses that bar and earlier ones; it is null until the window is full.

All take ``keys``, the columns that tell series apart (by default the symbol; in sweeps also the configuration).  Indicators over one key share one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import KEYS, bar_number, complete, full, full_prior, prior, series, so_far, trailing


def _c(name: str) -> Column:
    return F.col(name)


def donchian(n: int, keys=KEYS) -> tuple[Column, Column]:
    """Highest high and lowest low of the ``n`` bars before."""
    return full_prior(n, F.max("high").over(prior(n, keys)), keys), full_prior(n, F.min("low").over(prior(n, keys)), keys)


def sma(n: int, column: str = "close", keys=KEYS) -> Column:
    return full(n, F.avg(column).over(trailing(n, keys)), keys)


def rolling_max(n: int, column: str = "close", keys=KEYS) -> Column:
    return full(n, F.max(column).over(trailing(n, keys)), keys)


def rolling_min(n: int, column: str = "close", keys=KEYS) -> Column:
    return full(n, F.min(column).over(trailing(n, keys)), keys)


def rolling_std(n: int, column: str = "close", keys=KEYS) -> Column:
    """Population standard deviation."""
    return full(n, F.stddev_pop(column).over(trailing(n, keys)), keys)


def true_range(keys=KEYS) -> Column:
    before = F.lag("close").over(series(keys))
    return F.greatest(_c("high") - _c("low"), F.abs(_c("high") - before), F.abs(_c("low") - before))


def with_true_range(bars: DataFrame, keys=KEYS) -> DataFrame:
    return bars.withColumn("true_range", true_range(keys))


def atr(n: int, keys=KEYS) -> Column:
    """Simple mean of true_range, which must be a column."""
    return sma(n, "true_range", keys)


def bollinger(n: int, k: float, keys=KEYS) -> tuple[Column, Column, Column, Column]:
    """middle, upper, lower, bandwidth."""
    mid, dev = sma(n, "close", keys), rolling_std(n, "close", keys)
    return mid, mid + k * dev, mid - k * dev, F.when(mid > 0, 2 * k * dev / mid).otherwise(F.when(mid.isNotNull(), 0.0))


def starc(n: int, atr_n: int, k: float, keys=KEYS) -> tuple[Column, Column, Column]:
    mid, a = sma(n, "close", keys), atr(atr_n, keys)
    return mid, mid + k * a, mid - k * a


def high_proximity(n: int, column: str = "close", keys=KEYS) -> Column:
    """close over the highest ``column`` (close or high); 0 if that isn't positive."""
    top = rolling_max(n, column, keys)
    return F.when(top > 0, _c("close") / top).otherwise(F.when(top.isNotNull(), 0.0))


def opening_range(n: int, keys=KEYS) -> tuple[Column, Column]:
    return donchian(n, keys)


def calendar_range(bars: DataFrame, n: int, period: str = "week", keys=KEYS) -> DataFrame:
    """or_high, or_low, or_complete: the range of the first ``n`` bars of the calendar period, as far as it is known at each bar."""
    key = F.date_trunc(period, "ts")
    out = bars.withColumn("_period", key)
    w = series((*keys, "_period"))
    out = out.withColumn("_in", F.row_number().over(w))
    run = so_far((*keys, "_period"))
    opening = lambda c: F.when(F.col("_in") <= n, F.col(c))
    return out.withColumns({"or_high": F.max(opening("high")).over(run), "or_low": F.min(opening("low")).over(run), "or_complete": F.col("_in") >= n}).drop("_period", "_in")


def prior_range(keys=KEYS) -> Column:
    return F.coalesce(F.lag(_c("high") - _c("low")).over(series(keys)), F.lit(0.0))


def breakout_levels(k: float, keys=KEYS) -> tuple[Column, Column]:
    return _c("open") + k * prior_range(keys), _c("open") - k * prior_range(keys)


def directional_moves(keys=KEYS) -> tuple[Column, Column]:
    """+DM and -DM; 0 at the first bar."""
    up, down = _c("high") - F.lag("high").over(series(keys)), F.lag("low").over(series(keys)) - _c("low")
    return F.when((up > down) & (up > 0), up).otherwise(0.0), F.when((down > up) & (down > 0), down).otherwise(0.0)


def aroon(n: int, keys=KEYS) -> tuple[Column, Column]:
    """up and down over ``n`` bars; of equal extremes the most recent counts."""
    i = bar_number(keys)
    w = trailing(n, keys)
    up = F.max(F.struct("high", "_bar")).over(w)["_bar"]
    down = F.min(F.struct("low", (-_c("_bar")).alias("b"))).over(w)["b"]
    return full(n, 100.0 * (n - (i - up)) / n, keys), full(n, 100.0 * (n - (i + down)) / n, keys)


def with_bar_number(bars: DataFrame, keys=KEYS) -> DataFrame:
    return bars.withColumn("_bar", bar_number(keys))


def williams_r(n: int, keys=KEYS) -> Column:
    top, low = rolling_max(n, "high", keys), rolling_min(n, "low", keys)
    return F.when(top == low, -50.0).otherwise(-100.0 * F.try_divide(top - _c("close"), top - low))


def roc(n: int, keys=KEYS) -> Column:
    was = F.lag("close", n).over(series(keys))
    return F.try_divide(100.0 * (_c("close") - was), was)


def momentum(n: int, keys=KEYS) -> Column:
    return F.try_divide(_c("close"), F.lag("close", n).over(series(keys))) - 1.0


def typical_price() -> Column:
    return (_c("high") + _c("low") + _c("close")) / 3.0


def cci(bars: DataFrame, n: int, name: str = "cci", keys=KEYS) -> DataFrame:
    """(TP - mean TP) / (0.015 mean absolute deviation), 0 where there is none."""
    w = trailing(n, keys)
    out = bars.withColumn("_tp", typical_price()).withColumns({"_tps": F.collect_list("_tp").over(w), "_mean": F.avg("_tp").over(w)})
    # sums in window order, hence the same in each run
    deviation = F.aggregate("_tps", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_mean"))) / n
    value = F.when(deviation == 0, 0.0).otherwise(F.try_divide(F.col("_tp") - F.col("_mean"), 0.015 * deviation))
    return out.withColumn(name, full(n, value, keys)).drop("_tp", "_tps", "_mean")


def stochastic(bars: DataFrame, n: int, smooth: int, d: int, keys=KEYS) -> DataFrame:
    """stoch_k, stoch_d: both only where all three steps exist."""
    top, low = rolling_max(n, "high", keys), rolling_min(n, "low", keys)
    raw = F.when(top == low, 50.0).otherwise(100.0 * F.try_divide(_c("close") - low, top - low))
    out = bars.withColumn("_raw", raw)
    out = out.withColumn("_k", complete(smooth, F.avg("_raw").over(trailing(smooth, keys)), F.col("_raw"), keys))
    out = out.withColumn("stoch_d", complete(d, F.avg("_k").over(trailing(d, keys)), F.col("_k"), keys))
    return out.withColumn("stoch_k", F.when(F.col("stoch_d").isNotNull(), F.col("_k"))).drop("_raw", "_k")


def middle(n: int, keys=KEYS) -> Column:
    return (rolling_max(n, "high", keys) + rolling_min(n, "low", keys)) / 2.0


def ichimoku(bars: DataFrame, tenkan: int, kijun: int, senkou: int, keys=KEYS) -> DataFrame:
    """tenkan, kijun, senkou_a, senkou_b (not displaced), cloud_top, cloud_bottom, cloud (above, below, inside)."""
    n = max(tenkan, kijun, senkou)
    out = bars.withColumns({"tenkan": full(n, middle(tenkan, keys), keys), "kijun": full(n, middle(kijun, keys), keys), "senkou_b": full(n, middle(senkou, keys), keys)})
    out = out.withColumn("senkou_a", (_c("tenkan") + _c("kijun")) / 2.0)
    out = out.withColumns({"cloud_top": F.greatest("senkou_a", "senkou_b"), "cloud_bottom": F.least("senkou_a", "senkou_b")})
    cloud = F.when(_c("close") > _c("cloud_top"), "above").when(_c("close") < _c("cloud_bottom"), "below").when(_c("cloud_top").isNotNull(), "inside")
    return out.withColumn("cloud", cloud)


# --- approximations of the vectorised engine, by name ---


def cci_approx(bars: DataFrame, n: int, name: str = "cci_approx", keys=KEYS) -> DataFrame:
    """Mean deviation taken as 0.7979 standard deviations."""
    w = trailing(n, keys)
    out = bars.withColumn("_tp", typical_price())
    return out.withColumn(name, full(n, F.try_divide(F.col("_tp") - F.avg("_tp").over(w), 0.015 * 0.7979 * F.stddev_pop("_tp").over(w)), keys)).drop("_tp")


def supertrend_approx(n: int, k: float, keys=KEYS) -> Column:
    """Uptrend while close is above the raw lower band."""
    return _c("close") > (_c("high") + _c("low")) / 2.0 - k * atr(n, keys)


def darvas_approx(n: int, keys=KEYS) -> tuple[Column, Column]:
    """Top and bottom: extremes of the 2n bars before the current one."""
    return donchian(2 * n, keys)


def psar_approx(n: int, factor: float, keys=KEYS) -> tuple[Column, Column, Column, Column]:
    """Middle of the bar, bands of ``factor`` ATRs around it, and uptrend while close is above the lower one."""
    middle, reach = (_c("high") + _c("low")) / 2.0, factor * atr(n, keys)
    return middle, middle + reach, middle - reach, _c("close") > middle - reach


class IndicatorSet:
    """A list of named indicators, added to bars in one projection: ``IndicatorSet().add(fast=sma(10), slow=sma(50)).apply(bars)``."""

    def __init__(self, found: dict[str, Column] | None = None):
        self.found = found or {}

    def add(self, **columns: Column) -> IndicatorSet:
        return IndicatorSet(self.found | columns)

    def bands(self, names: tuple[str, ...], columns: tuple[Column, ...]) -> IndicatorSet:
        """Several columns of one indicator."""
        return IndicatorSet(self.found | dict(zip(names, columns, strict=False)))

    def apply(self, bars: DataFrame, keys=KEYS) -> DataFrame:
        return with_true_range(bars, keys).withColumns(self.found)
