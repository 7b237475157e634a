"""Data-quality checks of bars; each gives a table of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicates(bars: DataFrame) -> DataFrame:
    """(symbol, ts, count) of keys that occur more than once."""
    return bars.groupBy("symbol", "ts").agg(F.count("*").alias("count")).where("count > 1")


def disorder(bars: DataFrame, arrival: str) -> DataFrame:
    """Rows whose ts is before that of the row that arrived before them."""
    w = Window.partitionBy("symbol").orderBy(arrival)
    return bars.withColumn("previous_ts", F.lag("ts").over(w)).where("ts < previous_ts").select("symbol", arrival, "ts", "previous_ts")


def gaps(bars: DataFrame, days: int = 1) -> DataFrame:
    """(symbol, from_ts, to_ts, expected_bars) where consecutive bars are over ``days`` whole days apart, the bar length; weekends count."""
    w = Window.partitionBy("symbol").orderBy("ts")
    out = bars.select("symbol", F.lag("ts").over(w).alias("from_ts"), F.col("ts").alias("to_ts"))
    whole = F.floor((F.unix_seconds(F.col("to_ts").cast("timestamp")) - F.unix_seconds(F.col("from_ts").cast("timestamp"))) / (86_400 * days))
    return out.withColumn("expected_bars", (whole - 1).cast("long")).where("expected_bars > 0")


def invalid_prices(bars: DataFrame) -> DataFrame:
    """One row per bar whose prices contradict one another, with the reasons in fixed order."""
    tests = (("high<open", F.col("high") < F.col("open")), ("high<close", F.col("high") < F.col("close")), ("high<low", F.col("high") < F.col("low")), ("low>open", F.col("low") > F.col("open")), ("low>close", F.col("low") > F.col("close")))
    return bars.select("symbol", "ts", F.concat_ws(", ", *[F.when(c, F.lit(n)) for n, c in tests]).alias("reasons")).where("reasons <> ''")


def report(bars: DataFrame, arrival: str, days: int = 1) -> DataFrame:
    """(check, issues) with a row for each of the four checks; the data are clean if all are 0."""
    kinds = {"duplicate": duplicates(bars), "out_of_order": disorder(bars, arrival), "gap": gaps(bars, days), "invalid_ohlc": invalid_prices(bars)}
    out = None
    for kind, found in kinds.items():
        counted = found.agg(F.count("*").alias("issues")).select(F.lit(kind).alias("check"), "issues")
        out = counted if out is None else out.unionByName(counted)
    return out
