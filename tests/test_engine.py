"""Golden values, invariants and round trips."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.functions import recurrence as rec
from tidemark.operators import cluster, explore, leaderboard, results, scan, statistics, sweep, validation
from tidemark.operators import signals as sig
from tidemark.operators.backtest import Costs, along_path, long_only, pyramid, trades
from tidemark.operators.metrics import metrics
from tidemark.sources import bars as src
from tidemark.streaming.bars import streaming_bars

SF = "/root/testdata/sf0.001"


def frame(spark, closes, symbol="TEST", highs=None, lows=None, opens=None):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float((opens or closes)[i]), float((highs or closes)[i]), float((lows or closes)[i]), float(c), 1000.0, symbol, "1d") for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, open double, high double, low double, close double, volume double, symbol string, timeframe string")


def column(df, name):
    return [r[name] for r in df.orderBy("ts").select(name).collect()]


@pytest.fixture(scope="module")
def walk(spark):
    r = np.random.default_rng(4)
    c = (100 + np.cumsum(r.normal(0, 1, 400))).round(2).tolist()
    return frame(spark, c, highs=[x + 1 for x in c], lows=[x - 1 for x in c], opens=[x + 0.25 for x in c]).cache()


def test_donchian_looks_at_prior_bars(spark):
    up, low = ind.donchian(5)
    b = frame(spark, [100 + i for i in range(10)], highs=[102, 103, 104, 105, 106, 107, 108, 109, 110, 111], lows=[98, 99, 100, 101, 102, 103, 104, 105, 106, 107])
    out = b.withColumns({"u": up, "l": low})
    assert column(out, "u")[:6] == [None] * 5 + [106.0] and column(out, "l")[5] == 98.0


def test_sma_and_ema_seed(spark):
    b = frame(spark, [100, 101, 102, 103, 104])
    assert column(b.withColumn("s", ind.sma(3)), "s") == [None, None, 101.0, 102.0, 103.0]
    assert column(rec.along(b, ["symbol"], ["ts"], {"e": rec.ema(3, "e")}), "e") == [None, None, 101.0, 102.0, 103.0]


def test_fill_at_next_open_and_costs(spark):
    b = frame(spark, [10, 11, 12, 13, 14, 15], opens=[10, 11, 12, 13, 14, 15])
    i = F.dayofmonth("ts")
    s = b.withColumns({"raw_entry": i == 3, "raw_exit": i == 5})
    out = long_only(s, Costs(cash=1000, qty=10, fee_bps=10, slip_bps=5))
    t = trades(out).collect()[0]
    assert t.entry_price == pytest.approx(13 * 1.0005) and t.exit_price == pytest.approx(15 * 0.9995)
    assert t.net_pnl == pytest.approx(10 * (t.exit_price - t.entry_price) - 10 * 0.001 * (t.exit_price + t.entry_price))
    assert column(out, "equity")[-1] == pytest.approx(1000 + t.net_pnl)
    with pytest.raises(ValueError):
        Costs(qty=0)


@pytest.mark.parametrize("name", sorted(sig.STRATEGIES))
def test_no_look_ahead(walk, name):
    changed = walk.withColumn("close", F.when(F.dayofyear("ts") + 366 * (F.year("ts") - 2024) > 300, F.col("close") * 2).otherwise(F.col("close")))
    f = sig.STRATEGIES[name]
    p = {"lookback": 20} if name == "tsmom" else {"n": 60} if name.startswith("high_52w") else {}
    cut = F.dayofyear("ts") + 366 * (F.year("ts") - 2024) <= 300
    a, b = (f(x, **p).where(cut).select("ts", "raw_entry", "raw_exit").orderBy("ts").collect() for x in (walk, changed))
    assert a == b and len(a) == 300


def test_closed_form_matches_path(walk):
    rng = F.pmod(F.xxhash64("ts"), F.lit(7))
    s = walk.withColumns({"raw_entry": rng < 3, "raw_exit": (rng > 1) & (rng < 5)})
    a, b = (x.select("ts", "position_state", F.round("equity", 6).alias("e")).orderBy("ts").collect() for x in (long_only(s), along_path(s, mode="long_only")))
    assert a == b


def test_states_cross_batches(spark, walk):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = column(rec.along(walk, ["symbol"], ["ts"], {"r": rec.rsi(14), "d": rec.dmi(5)}), "adx")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == column(rec.along(walk, ["symbol"], ["ts"], {"d": rec.dmi(5)}), "adx")


@pytest.mark.parametrize("name", sorted(sweep.MACHINES))
def test_machines_match_windows(walk, name):
    """Vector machines simulate what the windowed strategies give, for the defaults and a variant of every strategy."""
    variant = {"tsmom": {"lookback": 20}, "high_52w": {"n": 60, "entry_pct": 0.99, "exit_pct": 0.98}, "high_52w_momentum": {"n": 60, "entry_pct": 0.97}, "high_52w_trailing": {"n": 60, "trail": 0.02}, "ma_cross": {"fast": 5, "slow": 20, "kind": "ema"}, "keltner": {"k": 0.3}, "starc": {"k": 0.2}, "bollinger_squeeze": {"squeeze": 0.3, "k": 0.8}, "dmi_adx": {"threshold": 15.0}}
    variant |= {s: {"k": 1.0} for s in ("supertrend", "supertrend_volume", "supertrend_confirmed", "supertrend_cooldown")} | {"supertrend_asymmetric": {"entry_k": 0.8, "exit_k": 1.2}}
    configs = [{}, variant[name]] if name in variant else [{}]
    a, b = (f(walk, name, configs, Costs(fee_bps=5)).toPandas().sort_values("config_id").reset_index(drop=True) for f in (sweep.strategy_sweep, sweep.windowed_sweep))
    assert a.config_id.tolist() == b.config_id.tolist() and a.params.tolist() == b.params.tolist()
    for c in ("final_equity", "sharpe", "sortino", "max_drawdown", "profit_factor", "num_trades", "turnover", "cagr"):
        np.testing.assert_allclose(a[c], b[c], rtol=1e-9, atol=1e-12)


def test_plan_does_not_grow_with_the_grid(walk):
    plans = [sweep.multi_strategy_sweep(walk, {"ma_cross": sweep.grid(fast=range(2, n), slow=[50, 100]), "rsi": sweep.grid(n=range(5, n))})._jdf.queryExecution().executedPlan().toString().count("Exchange") for n in (8, 40)]
    assert plans[0] == plans[1]


def test_depth_grids():
    # Valid configurations of some strategies at the three depths.
    sizes = {d: {s: len(c) for s, c in g.items()} for d, g in sweep.DEPTHS.items()}
    assert [sizes[d]["donchian"] for d in ("quick", "standard", "comprehensive")] == [3, 16, 34] and [len(g) for g in sizes.values()] == [26, 26, 26]
    assert sizes["standard"]["ma_cross"] == 16 and sizes["comprehensive"]["psar"] == 75 and sizes["quick"]["turtle_s1"] == 1


def test_neighbours(spark):
    rows = [("s", "t", f"{n}/{k}", n, k, v) for n, k, v in ((10, 5, 1.0), (11, 5, 1.2), (12, 6, 0.8), (13, 5, 9.0), (40, 5, 2.0))]
    got = {r.config_id: r for r in sweep.neighbours(spark.createDataFrame(rows, "symbol string, strategy_type string, config_id string, entry_lookback int, exit_lookback int, sharpe double")).collect()}
    assert got["10/5"].n == 2 and got["10/5"].stability == pytest.approx(1.0) and got["40/5"].n == 0 and got["40/5"].stability == 1
    assert got["11/5"].stability == pytest.approx(1 / (1 + abs(1.2 - 3.6) / np.std([1.0, 0.8, 9.0])))


def test_grades_fall_no_lower_than_low(spark):
    df = spark.createDataFrame([("high",), ("medium",), ("low",), ("insufficient",)], "g string")
    assert [r.x for r in df.select(statistics.downgraded(F.col("g"), F.lit(0.5)).alias("x")).collect()] == ["medium", "low", "low", "insufficient"]


def test_concentration_counts_absent_regimes(spark):
    from tidemark.operators import analysis

    rows = [("a", "high", 0.2), ("b", "high", 0.0), ("c", "high", 0.1), ("c", "neutral", -0.1), ("c", "low", 0.1)]
    got = {r.symbol: r for r in analysis.concentration(spark.createDataFrame(rows, "symbol string, regime string, total_return double")).collect()}
    assert (got["a"].score, got["a"].dominant, got["a"].dominant_share) == (1.0, "high", 1.0) and got["b"].score == 0
    assert got["c"].score == pytest.approx(0, abs=1e-12) and got["c"].dominant == "low" and got["c"].dominant_share == pytest.approx(0.5)


def test_sweep_matches_windows(walk):
    configs = sweep.grid(entry=[10, 30], exit=[5, 20])
    a = sweep.donchian_sweep(walk, configs, Costs(fee_bps=5), chunk=2).toPandas().sort_values("config_id").reset_index(drop=True)
    b = sweep.strategy_sweep(walk, "donchian", configs, Costs(fee_bps=5)).toPandas().sort_values("config_id").reset_index(drop=True)
    assert a.config_id.tolist() == b.config_id.tolist() and len(a) == 3
    for c in ("final_equity", "sharpe", "sortino", "max_drawdown", "profit_factor", "num_trades", "turnover", "cagr"):
        np.testing.assert_allclose(a[c], b[c], rtol=1e-9, atol=1e-12)


def test_metrics_of_nothing(walk):
    m = metrics(long_only(sig.hold(walk))).first()
    assert m.sharpe == m.max_drawdown == m.num_trades == m.profit_factor == m.total_return == 0


def test_pyramid_adds_units(spark):
    b = frame(spark, [10, 11, 12, 13, 14, 15, 16, 10]).withColumns({"raw_entry": F.dayofmonth("ts") == 1, "raw_exit": F.col("close") == 16, "a": F.lit(1.0)})
    out = pyramid(b, "a", Costs(), units=3, k=0.5)
    assert max(column(out, "units")) == 3 and column(out, "exit_units")[-1] == 3


def test_store_round_trip(spark, walk, tmp_path):
    src.write_store(walk, str(tmp_path))
    out = src.scan_symbol(spark, str(tmp_path), "TEST", "1d", dt.date(2024, 2, 1), dt.date(2024, 2, 10))
    assert out.count() == 10
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan and "GreaterThanOrEqual(ts" in plan
    with pytest.raises(src.NoData):
        src.scan_symbol(spark, str(tmp_path), "NONE")


def test_vendor_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-02,10,12,9,11,5.5,100\n2024-01-03,null,null,null,null,null,null\n")
    row = src.read_vendor_csv(spark, str(tmp_path / "a.csv"), "X").collect()
    assert len(row) == 1 and (row[0].open, row[0].close) == (5.0, 5.5)
    doc = {"chart": {"result": [{"timestamp": [86400, 0, 172800], "indicators": {"quote": [{"open": [1, 1, 2], "high": [2, 2, 3], "low": [1, 1, 1], "close": [2, 2, 2], "volume": [5, 5, None]}], "adjclose": [{"adjclose": [1, 1, 2]}]}}], "error": None}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    got = src.read_vendor_chart(spark, str(tmp_path / "a.json"), "X").orderBy("ts").collect()
    assert [(r.open, r.close, r.volume) for r in got] == [(0.5, 1.0, 5.0), (2.0, 2.0, 0.0)]
    assert src.parse_tickers("a, b # x\nc") == ["A", "B", "C"]


def test_universe(spark):
    u = src.read_universe(spark, '[[sectors]]\nid = "a"\nname = "A"\ntickers = ["x", "y"]\n[[sectors]]\nid = "b"\nname = "B"\ntickers = ["y"]\n')
    assert {r.symbol: r.sector for r in src.sector_lookup(u).collect()} == {"X": "A", "Y": "B"}


def test_distributions():
    assert statistics.t_cdf(2.228, 10) == pytest.approx(0.975, abs=1e-4) and statistics.t_cdf(0, 5) == 0.5
    assert statistics.incomplete_beta(0.5, 2, 2) == pytest.approx(0.5)


def test_bootstrap_of_long_series(spark):
    """More values than any cap would let pass; the interval of the mean of normal values is that of theory."""
    df = spark.range(300_000).select(F.lit("a").alias("k"), "id", F.randn(3).alias("x")).unionByName(spark.range(50).select(F.lit("b").alias("k"), "id", (F.col("id") % 5).cast("double").alias("x")))
    got = {r.k: r for r in statistics.bootstrap(df, ["k"], "x", rounds=200).collect()}
    assert got["a"].n == 300_000 and got["b"].n == 50 and got["b"].value == pytest.approx(2.0)
    assert got["a"].std_error == pytest.approx(300_000**-0.5, rel=0.2) and got["a"].lower < got["a"].value < got["a"].upper
    assert got["b"].std_error == pytest.approx(2**0.5 / 50**0.5, rel=0.25)


@pytest.mark.parametrize("method", ["iid", "moving", "stationary"])
def test_bootstrap_of_sharpe(spark, walk, method):
    from tidemark.operators.metrics import with_returns

    r = with_returns(walk.withColumn("equity", F.col("close")))
    a, b = (statistics.bootstrap_sharpe(r, ["symbol"], method=method, rounds=300).first() for _ in range(2))
    x = np.array([v.ret for v in r.where("ret is not null").orderBy("ts").collect()])
    assert [v if isinstance(v, str) else pytest.approx(v, rel=1e-9) for v in a] == list(b)  # pages' sums meet in any order
    assert a.n == 399 and a.sharpe == pytest.approx(x.mean() / x.std(ddof=1) * 252**0.5) and a.lower < a.sharpe < a.upper and a["mean"] == pytest.approx(x.mean())


def test_permutation(spark):
    r = np.random.default_rng(0)
    rows = [("far", i, float(v), i < 50) for i, v in enumerate([*r.normal(0, 1, 50), *r.normal(2, 1, 50)])] + [("same", i, float(v), i < 50) for i, v in enumerate(r.normal(0, 1, 100))] + [("one", 0, 1.0, True)]
    got = {x.k: x for x in statistics.permutation_test(spark.createDataFrame(rows, "k string, i int, x double, f boolean"), ["k"], "x", F.col("f"), rounds=500).collect()}
    assert got["far"].p < 0.01 and got["same"].p > 0.05 and got["one"].p is None and got["far"].n_first == 50


def test_adjusted_matches_one_sort(spark):
    r = np.random.default_rng(1)
    p = np.round(r.random(500) ** 3, 2)
    got = statistics.adjusted(spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(999, None)], "config_id int, p double")).toPandas().set_index("config_id")
    order = np.argsort(p, kind="stable")
    holm = np.minimum(np.maximum.accumulate(p[order] * (500 - np.arange(500))), 1)
    bh = np.minimum(np.minimum.accumulate((p[order] * 500 / np.arange(1, 501))[::-1])[::-1], 1)
    np.testing.assert_allclose(got.loc[order, "holm"], holm)
    np.testing.assert_allclose(got.loc[order, "bh"], bh)
    assert np.isnan(got.loc[999, "bh"])


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "config_id string, p double")
    got = {r.config_id: r for r in statistics.adjusted(df).collect()}
    assert got["a"].bonferroni == pytest.approx(0.04) and got["c"].holm == pytest.approx(0.09) and got["b"].holm == pytest.approx(0.09)
    assert got["c"].bh == pytest.approx(0.04 * 4 / 3) and got["b"].bh == pytest.approx(0.04 * 4 / 3) and got["d"].bh == 0.5


def test_folds(spark):
    folds = validation.walk_forward_folds(spark, 400).collect()
    assert [tuple(f) for f in folds] == [(0, 0, 252, 257, 320), (1, 63, 315, 320, 383)]
    with pytest.raises(validation.TooShort):
        validation.walk_forward_folds(spark, 100)


def test_explore(spark):
    s = explore.latin_hypercube("donchian", 20, 1)
    assert s == explore.latin_hypercube("donchian", 20, 1) and all(5 <= c["entry"] <= 500 and 2 <= c["exit"] <= 200 for c in s)
    sched = explore.Schedule()
    assert sched.exploit_probability(0) == 0 and sched.exploit_probability(50) == 0.25 and sched.exploit_probability(10_000) == 0.05
    assert [explore.combo_size(i) for i in (0, 3, 6, 8, 20, 60)] == [1, 1, 3, 2, 4, 4] and explore.combo_size(20, 3) == 2 and explore.combo_size(20, warm_up=30) == 1
    # Shares of modes after the warm-up, with winners and little coverage, in it, and each fifth iteration.
    assert dict(sched.shares(151, 0.1, True)) == pytest.approx({"local": 0.775 * 0.15, "exploit": 0.225, "random": 0.775 * 0.45, "cover": 0.775 * 0.4})
    assert dict(sched.shares(3)) == {"cover": 0.5, "random": 0.4, "local": 0.1} and sched.shares(55) == (("random", 1.0),)
    draws = [sched.mode(i, 0.7, True) for i in range(51, 3000) if i % 5]
    assert 0.3 < draws.count("random") / len(draws) < 0.45 and draws[0] == sched.mode(51, 0.7, True)
    tested = spark.createDataFrame([("donchian", {"entry": 5.0, "exit": 200.0}), ("donchian", {"entry": 500.0, "exit": 2.0})], "strategy_type string, params map<string,double>")
    assert {r.cell for r in explore.visits(tested, "donchian").collect()} == {49 * 50, 49}
    assert scan.parse_grid("entry:5..9:2;exit:1,2") == {"entry": [5, 7, 9], "exit": [1, 2]}
    assert scan.parse_strategy("Donchian:20,x,10") == ("donchian", [20.0, 10.0])


def test_strategy_grammar():
    assert scan.strategy_of("Donchian:20,x") == ("donchian", {"entry": 20, "exit": 20}) and scan.strategy_of("macross:5,9,EMA")[1] == {"fast": 5, "slow": 9, "kind": "ema"}
    assert scan.strategy_of("52wk_high") == ("high_52w", {"n": 252, "entry_pct": 0.95, "exit_pct": 0.9})
    with pytest.raises(ValueError):
        scan.strategy_of("nothing:1")


def test_sweep_config():
    from tidemark.sources.configs import sweep_config

    doc = {"symbols": ["A", "B"], "data": {"start_date": "2015-01-01"}, "backtest": {"fees_bps": 5}, "strategies": {"donchian": {"entry_lookbacks": [10, 20], "exit_lookbacks": [5, 15]}, "tsmom": {"enabled": False}, "aroon": None, "unknown": {}}}
    c = sweep_config(doc)
    assert c.symbols == ["A", "B"] and c.start == "2015-01-01" and c.costs.fee_bps == 5 and c.costs.qty == 100
    assert len(c.grids["donchian"]) == 3 and len(c.grids["aroon"]) == 5 and c.total == 8 and sweep_config({}).total == 0


def test_cells(spark):
    df = explore.random_cells(spark, "donchian", 200)
    back = df.withColumn("params", explore.center_of("donchian", F.col("cell"))).withColumn("again", explore.cell_of("donchian"))
    assert df.count() > 150 and back.where("cell <> again").count() == 0
    least = explore.least_visited(spark.createDataFrame([(c.cell, 3) for c in df.limit(5).collect()], "cell long, visits int"), df, 3).collect()
    assert all(r.visits == 0 for r in least)


def test_runs_and_scans(spark, tmp_path):
    from tidemark.sources import results as files

    df = spark.createDataFrame([("A", 1.0)], "symbol string, sharpe double")
    files.save_run(df, sweep.manifest(spark, df, sweep="x"), str(tmp_path / "run"))
    found, manifest = files.load_run(spark, str(tmp_path / "run"))
    assert found.collect() == df.collect() and manifest.first()["rows"] == 1
    (tmp_path / "scan.json").write_text(json.dumps([{"symbol": "A", "signal": "entry"}, {"symbol": "B", "signal": "exit"}]))
    assert files.read_scan(spark, str(tmp_path / "scan.json")).count() == 2


def test_clusters_and_boards(spark):
    rows = [(f"c{i}", "s" + str(i % 2), float(i % 4), float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "config_id string, strategy_type string, sharpe double, cagr double")
    out, inertia = cluster.cluster(df, ["sharpe", "cagr"], 3)
    assert out.count() == 20 and inertia > 0 and cluster.representatives(out).count() == 3
    with pytest.raises(ValueError):
        cluster.cluster(df, ["sharpe"], 11)
    assert cluster.diverse(df, 6, ["sharpe", "cagr"]).count() == 6
    b = leaderboard.board(df, "sharpe", 3, per_strategy=2).collect()
    assert [r.rank for r in b] == [1, 2, 3] and b[0].config_id == "c11"
    assert results.top(df.withColumn("symbol", F.lit("x")), 2, "cagr").first().config_id == "c19"


def test_streaming_bars_equal_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    q = streaming_bars(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("bars_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("bars_out").toPandas()
    want = streaming_bars(e).toPandas().merge(got, on=["symbol", "ts"])
    assert len(got) > 0 and len(want) == len(got) and (want.close_x == want.close_y).all()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_rest_without_training_operators():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "tidemark"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "tidemark.llm" in p.read_text()]
    assert isinstance(pd.DataFrame(), pd.DataFrame)


def test_result_files(spark, tmp_path):
    from tidemark.sources import results as files

    df = spark.sql("select 1 iteration, 'donchian' strategy_type, 'c' config_id, 7L config_hash, date'2020-01-01' tested_start, date'2021-01-01' tested_end")
    files.append_history(df, str(tmp_path / "h"))
    files.append_history(df, str(tmp_path / "h"))
    (tmp_path / "h" / "bad.json").write_text("{not json\n")
    h = files.read_history(spark, str(tmp_path / "h"))
    assert h.count() == 2 and len(files.tested_index(h).first().ranges) == 1
    other = df.withColumn("config_hash", F.lit(8).cast("long"))
    assert explore.untested(df.unionByName(other), h).count() == 1
    files.save_snapshot(df, str(tmp_path / "s"))
    assert files.load_snapshot(spark, str(tmp_path / "s")).columns == df.columns
    files.write_results(df.withColumn("m", F.create_map(F.lit("a"), F.lit(1))), str(tmp_path / "r.csv"))
    assert spark.read.csv(str(tmp_path / "r.csv"), header=True).count() == 1
