"""Parameter sweeps: every configuration of a grid on every series.

``donchian_sweep`` walks along each series once and keeps the state of all configurations of a chunk in vectors: the running extremes of the
last n bars for all n come from one accumulated maximum over a ring of highs.  Bars are sent once per chunk of configurations, and only
one row per (symbol, configuration) leaves.  A series of any length takes bounded memory.

``multi_strategy_sweep`` does the same for most strategies, whose signals have vector machines (``machines``): bars are sent once per chunk of
configurations, of whatever strategy, and the plan doesn't grow with the grid.  Strategies without one (SAR, Darvas, calendar ranges, ensembles, some
oscillators) are simulated in windows, a branch of the plan per configuration; their grids are small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.backtest import Costs, long_only
from tidemark.operators.grids import DEPTHS, grid, valid  # noqa: F401  (part of this module's interface)
from tidemark.operators.machines import MACHINES, History, handles
from tidemark.operators.metrics import CAP, YEAR, metrics
from tidemark.operators.signals import STRATEGIES

METRICS = "final_equity double, total_return double, cagr double, sharpe double, sortino double, max_drawdown double, calmar double, win_rate double, profit_factor double, num_trades long, turnover double"
CHUNK = 4096
MIXED_CHUNK = 1024


def config_id(strategy: str, config: dict) -> str:
    """Name of a configuration with all of its parameters."""
    return strategy + "".join(f"_{k}{v:g}" if isinstance(v, (int, float)) else f"_{k}{v}" for k, v in sorted(config.items()))


class _Runs:
    """State of many long-only runs at once; ``step`` takes one bar and the signals of all runs."""

    def __init__(self, n: int, costs: Costs):
        self.c, self.n = costs, n
        zero = lambda: np.zeros(n)
        self.pos, self.pending = np.zeros(n, bool), np.zeros(n, bool)
        self.cash, self.price, self.paid = np.full(n, costs.cash), zero(), zero()
        self.peak, self.down, self.last = zero(), zero(), np.full(n, costs.cash)
        self.sum, self.mean, self.m2, self.bad, self.returns = zero(), zero(), zero(), zero(), 0
        self.wins, self.trades, self.won, self.lost, self.traded = zero(), zero(), zero(), zero(), zero()
        self.first_ts = self.last_ts = None

    def step(self, ts, opened: float, close: float, entry: np.ndarray, leave: np.ndarray) -> None:
        c, first = self.c, self.first_ts is None
        if self.pending.any():
            buys, sells = np.nonzero(self.pending & ~self.pos)[0], np.nonzero(self.pending & self.pos)[0]
            if len(buys):
                p = c.buy(opened)
                fees = c.fees(p, c.qty)
                self.cash[buys] -= p * c.qty + fees
                self.price[buys], self.paid[buys] = p, fees
                self.traded[buys] += p * c.qty
            if len(sells):
                p = c.sell(opened)
                fees = c.fees(p, c.qty)
                self.cash[sells] += p * c.qty - fees
                net = (p - self.price[sells]) * c.qty - fees - self.paid[sells]
                self.trades[sells] += 1
                self.wins[sells] += net > 0
                self.won[sells] += np.maximum(net, 0)
                self.lost[sells] += np.maximum(-net, 0)
                self.traded[sells] += p * c.qty
            self.pos ^= self.pending
        equity = self.cash + self.pos * (c.qty * close)
        if first:
            self.first_ts = ts
        else:
            self.returns += 1
            small = np.abs(self.last) <= 1e-10
            r = np.where(small, 0.0, (equity - self.last) / np.where(small, 1.0, self.last))
            d = r - self.mean
            self.mean += d / self.returns
            self.m2 += d * (r - self.mean)
            self.bad += np.minimum(r, 0.0) ** 2
        np.maximum(self.peak, equity, out=self.peak) if not first else self.peak.__setitem__(slice(None), equity)
        np.maximum(self.down, np.where(self.peak > 0, (self.peak - equity) / np.where(self.peak > 0, self.peak, 1.0), 0.0), out=self.down)
        self.last, self.last_ts = equity, ts
        self.pending = np.where(self.pos, leave, entry)

    def table(self) -> pd.DataFrame:
        c, n = self.c, max(self.returns, 1)
        days = int((self.last_ts - self.first_ts) // np.timedelta64(1, "D"))
        years = days / 365.25
        dev, bad = np.sqrt(self.m2 / n), np.sqrt(self.bad / n)
        ratio = lambda d: np.where(d > 0, self.mean * YEAR / np.where(d > 0, d * YEAR**0.5, 1.0), 0.0)
        growth = np.where(self.last > 0, np.maximum(self.last, 1e-300) / c.cash, 0.0) ** (1 / years) - 1 if years > 0 else np.zeros(self.n)
        capital = (c.cash + self.last) / 2
        factor = np.where(self.lost > 0, np.minimum(self.won / np.where(self.lost > 0, self.lost, 1), CAP), np.where(self.won > 0, CAP, 0.0))
        return pd.DataFrame({
            "final_equity": self.last, "total_return": (self.last - c.cash) / c.cash, "cagr": growth, "sharpe": ratio(dev), "sortino": ratio(bad), "max_drawdown": self.down,
            "calmar": np.where(self.down > 0, growth / np.where(self.down > 0, self.down, 1), 0.0), "win_rate": np.where(self.trades > 0, self.wins / np.maximum(self.trades, 1), 0.0), "profit_factor": factor, "num_trades": self.trades.astype(np.int64),
            "turnover": np.where((capital > 0) & (years > 0), self.traded / np.where(capital > 0, capital, 1) / (years or 1), 0.0),
        })


def donchian_sweep(bars: DataFrame, configs: list[dict], costs: Costs = Costs(), chunk: int = CHUNK) -> DataFrame:  # noqa: B008
    """symbol, entry_lookback, exit_lookback, config_id and the metrics of each valid configuration."""
    configs = valid("donchian", configs)
    parts = [configs[i : i + chunk] for i in range(0, len(configs), chunk)]
    longest = max((c["entry"] for c in configs), default=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = runs = highs = lows = None
        seen = 0

        def done() -> pd.DataFrame:
            own = parts[key[1]]
            out = runs.table()
            out.insert(0, "symbol", key[0])
            out.insert(1, "entry_lookback", [c["entry"] for c in own])
            out.insert(2, "exit_lookback", [c["exit"] for c in own])
            out.insert(3, "config_id", [config_id("donchian", c) for c in own])
            return out

        for b in batches:
            for symbol, part, ts, opened, high, low, close in zip(b["symbol"], b["part"], b["ts"].to_numpy(), b["open"].to_numpy(), b["high"].to_numpy(), b["low"].to_numpy(), b["close"].to_numpy(), strict=True):
                if (symbol, part) != key:
                    if key is not None:
                        yield done()
                    key, seen = (symbol, part), 0
                    entries, exits = (np.array([c[k] for c in parts[part]]) for k in ("entry", "exit"))
                    warm = np.maximum(entries, exits)
                    runs, highs, lows = _Runs(len(entries), costs), np.full(longest, -np.inf), np.full(longest, np.inf)
                # newest first: position n-1 of the accumulated extremes is that of the last n bars
                upper, lower = np.maximum.accumulate(highs), np.minimum.accumulate(lows)
                ready = seen >= warm
                runs.step(ts, opened, close, ready & (close > upper[entries - 1]), ready & (close < lower[exits - 1]))
                highs[1:], lows[1:] = highs[:-1].copy(), lows[:-1].copy()
                highs[0], lows[0] = high, low
                seen += 1
        if key is not None:
            yield done()

    spread = bars.select("symbol", "ts", "open", "high", "low", "close", F.explode(F.array(*[F.lit(i) for i in range(len(parts))])).alias("part"))
    # a partition per (symbol, chunk) is wanted, but not known before: enough of them, and the planner merges none that were asked for
    dealt = spread.repartition("symbol", "part").sortWithinPartitions("symbol", "part", "ts")
    return dealt.mapInPandas(run, f"symbol string, entry_lookback int, exit_lookback int, config_id string, {METRICS}")


RUN = f"symbol string, strategy_type string, config_id string, params map<string,string>, {METRICS}"


def _walked(bars: DataFrame, parts: list[tuple[str, list[dict]]], costs: Costs) -> DataFrame:
    """RUN rows of chunks of configurations: one walk along each series for each chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = machine = past = runs = None

        def done() -> pd.DataFrame:
            strategy, configs = parts[key[1]]
            out = runs.table()
            out.insert(0, "symbol", key[0])
            out.insert(1, "strategy_type", strategy)
            out.insert(2, "config_id", [config_id(strategy, c) for c in configs])
            out.insert(3, "params", [{k: str(v) for k, v in c.items()} for c in configs])
            return out

        columns = ("symbol", "part", "ts", "open", "high", "low", "close", "volume")
        for b in batches:
            for symbol, part, ts, *bar in zip(*(b[c].to_numpy() for c in columns), strict=True):
                if (symbol, part) != key:
                    if key is not None:
                        yield done()
                    key = symbol, part
                    machine = MACHINES[parts[part][0]](parts[part][1])
                    past, runs = History(machine.longest()), _Runs(machine.size, costs)
                past.push(*bar)
                entry, leave = machine.step(past)
                ready = past.seen > machine.warm
                runs.step(ts, bar[0], bar[3], entry & ready, leave & ready)
        if key is not None:
            yield done()

    spread = bars.select("symbol", "ts", "open", "high", "low", "close", "volume", F.explode(F.array(*[F.lit(i) for i in range(len(parts))])).alias("part"))
    return spread.repartition("symbol", "part").sortWithinPartitions("symbol", "part", "ts").mapInPandas(run, RUN)


def windowed_sweep(bars: DataFrame, strategy: str, configs: list[dict], costs: Costs = Costs()) -> DataFrame:  # noqa: B008
    """RUN rows of the valid configurations of any strategy, each in windows by symbol."""
    out = None
    for c in valid(strategy, configs):
        own = metrics(long_only(STRATEGIES[strategy](bars, **c), costs), costs)
        params = F.create_map(*[F.lit(x) for k, v in c.items() for x in (k, str(v))]).cast("map<string,string>")
        own = own.select("symbol", F.lit(strategy).alias("strategy_type"), F.lit(config_id(strategy, c)).alias("config_id"), params.alias("params"), *[m for m in own.columns if m != "symbol"])
        out = own if out is None else out.unionByName(own)
    return out


def multi_strategy_sweep(bars: DataFrame, grids: dict[str, list[dict]], costs: Costs = Costs(), chunk: int = MIXED_CHUNK) -> DataFrame:  # noqa: B008
    """symbol, strategy_type, config_id, params and the metrics of each valid configuration of each strategy."""
    parts, out = [], None
    for name, configs in grids.items():
        own = valid(name, configs)
        vector = [c for c in own if handles(name, c)]
        parts += [(name, vector[i : i + chunk]) for i in range(0, len(vector), chunk)]
        if rest := [c for c in own if not handles(name, c)]:
            found = windowed_sweep(bars, name, rest, costs)
            out = found if out is None else out.unionByName(found)
    if parts:
        found = _walked(bars, parts, costs)
        out = found if out is None else found.unionByName(out)
    return bars.sparkSession.createDataFrame([], RUN) if out is None else out


def strategy_sweep(bars: DataFrame, strategy: str, configs: list[dict], costs: Costs = Costs()) -> DataFrame:  # noqa: B008
    return multi_strategy_sweep(bars, {strategy: configs}, costs)


def write_in_batches(bars: DataFrame, strategy: str, configs: list[dict], path: str, costs: Costs = Costs(), batch: int = 50) -> DataFrame:  # noqa: B008
    """Append results a batch of configurations at a time; returns the summary of what was written."""
    own = valid(strategy, configs)
    for i in range(0, len(own), batch):
        strategy_sweep(bars, strategy, own[i : i + batch], costs).drop("params").write.mode("append").parquet(path)
    done = bars.sparkSession.read.parquet(path)
    return done.agg(F.count("*").alias("n"), F.max("sharpe").alias("best_sharpe"), F.avg("sharpe").alias("mean_sharpe"), F.max("cagr").alias("best_cagr"), F.avg("cagr").alias("mean_cagr"), F.count_if(F.col("total_return") > 0).alias("positive"))


def neighbours(results: DataFrame, metric: str = "sharpe", keys: tuple[str, ...] = ("symbol", "strategy_type")) -> DataFrame:
    """Of each configuration: the number, mean and population variance of ``metric`` over its neighbours, whose entry and exit lookbacks
    differ by 2 at most, and stability = 1 / (1 + |value - mean| / max(deviation, 0.001)), or 1 where neighbours don't vary or there are none.

    Neighbours meet by equality on shifted lookbacks, 24 for each configuration, not by comparing all pairs."""
    own = results.select(*keys, "config_id", "entry_lookback", "exit_lookback", F.col(metric).alias("value"))
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if i or j])
    around = own.withColumn("s", F.explode(shifts)).select(*keys, "config_id", (F.col("entry_lookback") + F.col("s.i")).alias("entry_lookback"), (F.col("exit_lookback") + F.col("s.j")).alias("exit_lookback"))
    others = own.select(*keys, "entry_lookback", "exit_lookback", F.col("value").alias("near"))
    met = around.join(others, [*keys, "entry_lookback", "exit_lookback"]).groupBy(*keys, "config_id").agg(F.count("*").alias("n"), F.avg("near").alias("mean"), F.var_pop("near").alias("variance"))
    found = own.join(met, [*keys, "config_id"], "left").select(*keys, "config_id", "value", F.coalesce("n", F.lit(0)).alias("n"), "mean", F.coalesce("variance", F.lit(0.0)).alias("variance"))
    off = F.abs(F.col("value") - F.col("mean")) / F.greatest(F.sqrt("variance"), F.lit(0.001))
    return found.withColumn("stability", F.when(F.col("variance") > 0, 1.0 / (1.0 + off)).otherwise(1.0))


def cost_sensitivity(signals: DataFrame, levels: list[float], qty: float = 1.0, cash: float = 100_000.0) -> DataFrame:
    """total_return by symbol and fee level, and breakeven_bps, the first level at which it isn't positive.

    Positions don't depend on costs: one simulation without fees gives the final equity and the traded value, to which fees are proportional."""
    from pyspark.sql import Window

    free = long_only(signals, Costs(cash=cash, qty=qty))
    ends = free.groupBy("symbol").agg(F.max_by("equity", "ts").alias("_end"), F.coalesce(F.sum(F.col("fill_price") * qty), F.lit(0.0)).alias("_traded"))
    fee = F.explode(F.array(*[F.lit(float(x)) for x in levels]))
    out = ends.withColumn("fee_bps", fee).select("symbol", "fee_bps", ((F.col("_end") - F.col("_traded") * F.col("fee_bps") / 10_000 - cash) / cash).alias("total_return"))
    return out.withColumn("breakeven_bps", F.min(F.when(F.col("total_return") <= 0, F.col("fee_bps"))).over(Window.partitionBy("symbol")))


def manifest(spark: SparkSession, results: DataFrame, **facts) -> DataFrame:
    """One row that tells how results were made: the facts, the number of rows and a hash of them that doesn't depend on their order."""
    kept = F.struct(*[F.lit(str(v)).alias(k) for k, v in facts.items()]) if facts else F.struct(F.lit(None).cast("string").alias("none"))
    return results.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*results.columns)).alias("data_hash")).withColumn("facts", F.to_json(kept))
