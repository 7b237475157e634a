"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import sweep
from tidemark.plans.queries import COSTS, QUERIES
from tidemark.schema import bar_number

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ("met_metrics", "ind_moving", "rec_rsi_macd", "str_supertrend", "swp_donchian", "agg_robustness", "sec_dispersion", "ana_distribution", "val_walk_forward", "lb_portfolio", "out_scan")


def ten_minute_bars(spark: SparkSession, most: int = 3774) -> DataFrame:
    """One series of at most as many bars as fifteen years of trading days, of all events in ten-minute bars."""
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("at", F.window("ts", "10 minutes")["start"])
    at = F.struct("ts", "event_id")
    b = e.groupBy("at").agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume"))
    b = b.select(F.col("at").alias("ts"), "open", "high", "low", "close", "volume", F.lit("ALL").alias("symbol"))
    return b.withColumn("_i", bar_number()).where(F.col("_i") < most).drop("_i")


def grid_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The full Donchian grid entry 5..300, exit 3..150 on one series: 43,808 grid points, of which those with exit below entry run."""
    return sweep.donchian_sweep(ten_minute_bars(spark), sweep.grid(entry=range(5, 301), exit=range(3, 151)), COSTS)


#: 10,000 configurations of five strategies.
MIXED = {
    "donchian": sweep.grid(entry=range(20, 120, 2), exit=range(3, 19)) + sweep.grid(entry=range(21, 121, 2), exit=range(3, 19)) + sweep.grid(entry=range(122, 322), exit=[20, 60]),
    "ma_cross": sweep.grid(fast=range(5, 45), slow=range(50, 300, 5)),
    "rsi": sweep.grid(n=range(2, 42), oversold=[20.0, 25.0, 30.0, 35.0, 40.0], overbought=[55.0, 60.0, 65.0, 70.0, 75.0, 80.0, 85.0, 90.0, 95.0, 99.0]),
    "supertrend": sweep.grid(atr=range(3, 43), k=[0.5 + 0.1 * i for i in range(50)]),
    "bollinger_squeeze": sweep.grid(n=range(10, 50), k=[1.5, 1.75, 2.0, 2.25, 2.5], squeeze=[0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.1, 0.12]),
}


def mixed_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.multi_strategy_sweep(ten_minute_bars(spark), MIXED, COSTS)


def timed(spark: SparkSession, f) -> float:
    start = time.perf_counter()
    f(spark, SF).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    builder = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: QUERIES[n] for n in NAMES} | {"sweep_grid_43808": grid_sweep, f"sweep_{sum(map(len, MIXED.values()))}_of_five": mixed_sweep}
    timed(spark, QUERIES["met_metrics"])  # starts the session and compiles
    took = {n: round(timed(spark, f), 3) for n, f in queries.items()}
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rstrip("/").rsplit("sf", 1)[-1]}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
