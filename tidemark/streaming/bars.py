"""Bars from a stream of events, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(events: DataFrame, length: str = "1 hour", late: str = "1 hour", symbol: str = "event_type", price: str = "value", order: str = "event_id") -> DataFrame:
    """Bars of a (streaming) table of symbol, ts, price; events later than ``late`` are left out."""
    at = F.struct("ts", order)
    folded = events.withWatermark("ts", late).groupBy(F.window("ts", length), F.col(symbol).alias("symbol")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return folded.select(F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "symbol", F.lit(length).alias("timeframe"))
