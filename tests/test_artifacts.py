"""Artifact documents: whole JSON files with the required members, streamed in order."""

import datetime as dt
import json
import pathlib

import numpy as np
import pytest

from tidemark.operators import artifacts
from tidemark.operators.backtest import Costs

# The required members of a document, its rules, its cost model and its vectors.
REQUIRED = {"schema_version", "strategy_id", "symbol", "timeframe", "indicators", "rules", "fill_model", "cost_model", "parameters", "parity_vectors"}


@pytest.fixture(scope="module")
def bars(spark):
    r = np.random.default_rng(5)
    rows = []
    for s, n in (('A"b', 300), ("C", 5)):
        c = 100.0
        for i in range(n):
            c += float(r.normal())
            rows.append((dt.datetime(2021, 1, 1) + dt.timedelta(days=i), c, c + 1, c - 1, c, 10.0, s, "1d"))
    return spark.createDataFrame(rows, "ts timestamp_ntz, open double, high double, low double, close double, volume double, symbol string, timeframe string").repartition(7).cache()


def written(spark, bars, path):
    lines = None
    for n, m in ((10, 5), (20, 10)):
        own = artifacts.lines(*artifacts.donchian(bars, n, m), Costs(fee_bps=10, slip_bps=5))
        lines = own if lines is None else lines.unionByName(own)
    artifacts.write(lines, path)
    files = list(pathlib.Path(path).rglob("part-*.txt"))
    return {(d["symbol"], d["metadata"]["config_id"]): d for d in (json.loads(f.read_text()) for f in files)}, len(files)


def test_documents(spark, bars, tmp_path):
    found, files = written(spark, bars, str(tmp_path / "a"))
    assert files == 4 and set(found) == {(s, c) for s in ('A"b', "C") for c in ("donchian_10_5", "donchian_20_10")}
    closes = {s: [(r.ts, r.high, r.low, r.close) for r in bars.where(bars.symbol == s).orderBy("ts").collect()] for s in ('A"b', "C")}
    for (symbol, config), d in found.items():
        assert d.keys() >= REQUIRED and d["fill_model"] == "NextOpen" and d["cost_model"] == {"fees_bps_per_side": 10, "slippage_bps": 5} and d["timeframe"] == "1d"
        assert {"condition", "pine_condition"} <= d["rules"]["entry"].keys() and {i["id"] for i in d["indicators"]} == {"donchian_entry", "donchian_exit"}
        v, own = d["parity_vectors"]["vectors"], closes[symbol]
        n, m = d["parameters"]["entry_lookback"], d["parameters"]["exit_lookback"]
        assert [x["ts"] for x in v] == [t.strftime("%Y-%m-%dT%H:%M:%SZ") for t, *_ in own] and d["data_range"] == {"start": v[0]["ts"], "end": v[-1]["ts"]}
        state = 0
        for i, x in enumerate(v):
            up, low = (max(h for _, h, _, _ in own[i - n : i]) if i >= n else None), (min(lo for _, _, lo, _ in own[i - m : i]) if i >= m else None)
            assert x.get("indicators", {}).get("donchian_entry", {}).get("upper") == up and x.get("indicators", {}).get("donchian_exit", {}).get("lower") == low
            want = None
            if not state and up is not None and own[i][3] > up:
                state, want = 1, "enter_long"
            elif state and low is not None and own[i][3] < low:
                state, want = 0, "exit_long"
            assert x.get("signal") == want and x["position_after"] == ("long" if state else "flat")
    assert any(x.get("signal") for x in found['A"b', "donchian_10_5"]["parity_vectors"]["vectors"])


def test_no_document_is_collected(bars):
    plan = artifacts.lines(*artifacts.donchian(bars, 10, 5))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
