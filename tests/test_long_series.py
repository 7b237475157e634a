"""Scans over chunks of time equal one pass along the series, for any width of chunks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import chunks
from tidemark.functions import recurrence as rec
from tidemark.operators import backtest, long_series
from tidemark.operators import metrics as met


@pytest.fixture(scope="module")
def bars(spark):
    """A long series, a short one, one of a single bar, and one with gaps; bars without a symbol take no part."""
    r = np.random.default_rng(8)
    rows = []
    for symbol, n, gap in (("A", 600, 0.0), ("B", 40, 0.0), ("C", 1, 0.0), ("D", 150, 0.5)):
        day, c = dt.datetime(2020, 1, 1), 100.0
        for _ in range(n):
            c += r.normal()
            h, lo, o = c + abs(r.normal()), c - abs(r.normal()), c + r.normal() / 4
            rows.append((symbol, day, o, max(h, o), min(lo, o), c, None if r.random() < 0.2 else float(r.normal())))
            day += dt.timedelta(hours=int(1 + 200 * gap * (r.random() < 0.1)))
    rows.append((None, day, 1.0, 1.0, 1.0, 1.0, 1.0))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, x double").cache()


def same(a, b, columns):
    a, b = (x.where("symbol is not null").select("symbol", "ts", *columns).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b) > 0
    for c in columns:
        if a[c].dtype == float or b[c].dtype == float:
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), c
        else:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


WIDTHS = [5 * 3600, 64 * 3600, 10**9]


@pytest.mark.parametrize("seconds", WIDTHS)
def test_means(bars, seconds):
    own = chunks.chunked(bars, seconds=seconds)
    got = chunks.smoothed(own, [chunks.Smoothing("e", "close", 20, 2.0 / 21), chunks.Smoothing("w", "x", 14, 1.0 / 14)])
    want = rec.along(bars, ["symbol"], ["ts"], {"e": rec.ema(20, "e"), "w": rec.wilder(14, "x", "w")})
    same(got, want, ["e", "w"])


@pytest.mark.parametrize(("f", "step", "columns"), [
    (chunks.macd, rec.macd(), ["macd", "macd_signal", "macd_hist"]), (chunks.rsi, rec.rsi(), ["rsi"]), (chunks.dmi, rec.dmi(), ["plus_di", "minus_di", "adx"]),
    (chunks.heikin_ashi, rec.heikin_ashi(), ["ha_open", "ha_high", "ha_low", "ha_close"]),
])
def test_indicators(bars, f, step, columns):
    same(f(chunks.chunked(bars, seconds=20 * 3600)), rec.along(bars, ["symbol"], ["ts"], {"s": step}), columns)


@pytest.mark.parametrize("seconds", [7 * 3600, 64 * 3600])
def test_simulation(bars, seconds):
    rng = F.pmod(F.xxhash64("ts", "symbol"), F.lit(9))
    signals = bars.withColumns({"raw_entry": F.when(rng != 8, rng < 3), "raw_exit": (rng > 1) & (rng < 5)})
    costs = backtest.Costs(fee_bps=10, slip_bps=5, qty=3)
    got, want = long_series.long_only(chunks.chunked(signals, seconds=seconds), costs), backtest.long_only(signals, costs)
    columns = ["position_state", "entry_fill", "exit_fill", "fill_price", "fill_fees", "cash", "equity", "trade_no", "entry_ts", "entry_price", "gross_pnl", "net_pnl"]
    same(got, want, columns)
    same(got, met.with_returns(want), ["ret", "drawdown"])
    a, b = (x.where("symbol is not null").orderBy("symbol").toPandas() for x in (long_series.metrics(got, costs), met.metrics(want, costs)))
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)


def test_one_series_is_dealt_to_many_tasks(spark, bars):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which puts so few bars together
    own = chunks.chunked(bars.where("symbol = 'A'"), rows=64)
    parts = chunks.smoothed(own, [chunks.Smoothing("e", "close", 20, 0.1)]).select(F.spark_partition_id().alias("p"), "_chunk").distinct().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.p for r in parts}) > 4 and 9 <= len({r._chunk for r in parts}) <= 12


def test_carried():
    r = np.random.default_rng(2)
    for n in (0, 1, 127, 128, 129, 1000):
        x, y, want = r.normal(size=n), 0.7, []
        for v in x:
            y = 0.9 * v + 0.1 * y
            want.append(y)
        assert np.allclose(chunks.carried(x, 0.9, 0.7), want, rtol=1e-12, atol=0)


def test_no_bars(spark):
    none = spark.createDataFrame([], "symbol string, ts timestamp, open double, high double, low double, close double")
    assert chunks.dmi(chunks.macd(chunks.chunked(none))).count() == 0
