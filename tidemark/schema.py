"""The schema of bars, and the windows that series are read through."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("timeframe", T.StringType()),
    ]
)
KEYS = ("symbol",)


def series(keys=KEYS):
    return Window.partitionBy(*keys).orderBy("ts")


def trailing(n: int, keys=KEYS):
    """The last ``n`` bars, the current one included."""
    return series(keys).rowsBetween(-(n - 1), 0)


def prior(n: int, keys=KEYS):
    """The ``n`` bars before the current one."""
    return series(keys).rowsBetween(-n, -1)


def so_far(keys=KEYS):
    from pyspark.sql import Window as W

    return series(keys).rowsBetween(W.unboundedPreceding, 0)


def before(keys=KEYS):
    from pyspark.sql import Window as W

    return series(keys).rowsBetween(W.unboundedPreceding, -1)


def bar_number(keys=KEYS) -> Column:
    """0 for the first bar of a series."""
    return F.row_number().over(series(keys)) - 1


def full(n: int, value: Column, keys=KEYS) -> Column:
    """``value`` once the series has ``n`` bars; null before."""
    return F.when(F.row_number().over(series(keys)) >= n, value)


def full_prior(n: int, value: Column, keys=KEYS) -> Column:
    return F.when(F.row_number().over(series(keys)) > n, value)


def complete(n: int, value: Column, over: Column, keys=KEYS) -> Column:
    """``value`` where the last ``n`` values of ``over`` are all there: for windows on nullable columns."""
    return F.when(F.count(over).over(trailing(n, keys)) == n, value)
