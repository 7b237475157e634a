"""Simulation of one long series over many tasks, by chunks of time (``functions.chunks``).

Whether a long-only position is open depends on all signals before.  Within a chunk it is an automaton of two states: the state is the last set or reset
before the bar, or else the chunk's start, flipped by the parity of toggles since.  So a chunk is summarised for both starts: the state it
ends in, cash flows, entries, the last entry, and the last and greatest equity.  A scan over the table of chunks gives each its start, and bars
follow within chunks.  Results equal those of ``backtest.long_only`` and ``metrics.with_returns``; everything but the scan is window functions over one exchange.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.backtest import Costs
from tidemark.operators.metrics import performance
from tidemark.schema import KEYS

#: The state of a series at the start of a chunk.
START = "_start int, _was int, _cash double, _trades long, _ts timestamp_ntz, _price double, _fees double, _equity double, _peak double"


def _windows(keys):
    order = Window.partitionBy(*keys, "_chunk").orderBy("ts")
    return order, order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)


def _with_inputs(signals: DataFrame, keys) -> DataFrame:
    """_e and _x (0 or 1), _t0 (toggles before the bar in its chunk), _f (the last set or reset before, with the toggles up to it), _i (0 at the first bar)."""
    order, so_far, before = _windows(keys)
    e, x = (F.coalesce(c, F.lit(False)).cast("int") for c in ("raw_entry", "raw_exit"))
    out = signals.withColumns({"_e": e, "_x": x}).withColumn("_t", F.sum(F.col("_e") * F.col("_x")).over(so_far))
    fixed = F.last(F.when(F.col("_e") != F.col("_x"), F.struct("_e", "_t")), ignorenulls=True).over(before)
    return out.withColumns({"_f": fixed, "_t0": F.coalesce(F.lag("_t").over(order), F.lit(0)), "_i": F.row_number().over(order) - 1}).drop("_t")


def _state(start: Column) -> Column:
    return F.when(F.col("_f").isNotNull(), (F.col("_f._e") + F.col("_t0") - F.col("_f._t")) % 2).otherwise((start + F.col("_t0")) % 2).cast("int")


def _fill(state: Column, was: Column, costs: Costs) -> tuple[Column, Column, Column]:
    """Price, fees and cash flow of the fill at a bar's open, if the state has changed."""
    price = F.when((state == 1) & (was == 0), costs.buy(F.col("open"))).when((state == 0) & (was == 1), costs.sell(F.col("open")))
    fees = costs.fees(price, costs.qty)
    return price, fees, F.coalesce(F.when(state == 1, -price * costs.qty - fees).otherwise(price * costs.qty - fees), F.lit(0.0))


def _summaries(inputs: DataFrame, costs: Costs, keys) -> DataFrame:
    """One row per chunk: its first open and ts, and for both starts what happens after its first bar's fill."""
    order, so_far, _ = _windows(keys)
    out = inputs
    for s in (0, 1):
        out = out.withColumn(f"_p{s}", _state(F.lit(s)))
        was = F.lag(f"_p{s}").over(order)
        out = out.withColumn(f"_was{s}", F.when(F.col("_i") > 0, was).otherwise(F.col(f"_p{s}")))
        price, fees, flow = _fill(F.col(f"_p{s}"), F.col(f"_was{s}"), costs)
        out = out.withColumns({f"_price{s}": price, f"_fees{s}": fees, f"_flow{s}": flow})
        out = out.withColumn(f"_eq{s}", F.sum(f"_flow{s}").over(so_far) + F.col(f"_p{s}") * costs.qty * F.col("close"))
    aggs = [F.min("ts").alias("first_ts"), F.min_by("open", "ts").alias("first_open")]
    for s in (0, 1):
        p = F.col(f"_p{s}")
        after = F.when(F.col("_e") != F.col("_x"), F.col("_e")).when(F.col("_e") == 1, 1 - p).otherwise(p)
        entry = F.when((p == 1) & (F.col(f"_was{s}") == 0), F.col("ts"))
        aggs += [F.max_by(after, "ts").alias(f"to{s}"), F.max_by(p, "ts").alias(f"state{s}"), F.sum(f"_flow{s}").alias(f"flow{s}"), F.count(entry).alias(f"entries{s}")]
        aggs += [F.max(entry).alias(f"ts{s}"), F.max_by(f"_price{s}", entry).alias(f"price{s}"), F.max_by(f"_fees{s}", entry).alias(f"fees{s}")]
        aggs += [F.max_by(f"_eq{s}", "ts").alias(f"equity{s}"), F.max(f"_eq{s}").alias(f"peak{s}")]
    return out.groupBy(*keys, "_chunk").agg(*aggs)


def _starts(chunks: pd.DataFrame, costs: Costs) -> list[tuple]:
    """START of each chunk of a series, in order."""
    start, was, cash, trades, opened, equity, peak, out = 0, 0, costs.cash, 0, (None, None, None), None, None, []
    for c in chunks.to_dict("records"):
        out.append((start, was, cash, trades, *opened, equity, peak))
        if start != was:
            price = costs.buy(c["first_open"]) if start else costs.sell(c["first_open"])
            fees = costs.fees(price, costs.qty)
            cash += (-price if start else price) * costs.qty - fees
            if start:
                trades, opened = trades + 1, (c["first_ts"], price, fees)
        of = lambda name: c[f"{name}{start}"]  # noqa: B023, E731
        equity, peak = cash + of("equity"), max(cash + of("peak"), -float("inf") if peak is None else peak)
        if not pd.isna(of("ts")):
            opened = (of("ts"), of("price"), of("fees"))
        cash, trades, was, start = cash + of("flow"), trades + of("entries"), int(of("state")), int(of("to"))
    return out


def long_only(signals: DataFrame, costs: Costs = Costs(), keys=KEYS) -> DataFrame:  # noqa: B008
    """chunked() signals with the columns of ``backtest.long_only``, and ret and drawdown."""
    kinds = dict(signals.dtypes)
    started = START.replace("timestamp_ntz", kinds["ts"])
    names = [c.split(" ")[0] for c in started.split(", ")]
    by = [*keys, "_chunk"]
    order, so_far, _ = _windows(keys)
    inputs = _with_inputs(signals, keys)

    def scan(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("_chunk")
        return pd.concat([b[by].reset_index(drop=True), pd.DataFrame(_starts(b, costs), columns=names)], axis=1)

    starts = _summaries(inputs, costs, keys).groupBy(*keys).applyInPandas(scan, ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", " + started)
    out = inputs.join(starts, by).withColumn("position_state", _state(F.col("_start")))
    out = out.withColumn("_before", F.coalesce(F.lag("position_state").over(order), F.col("_was")))
    state, was = F.col("position_state"), F.col("_before")
    price, fees, flow = _fill(state, was, costs)
    out = out.withColumns({"entry_fill": (state == 1) & (was == 0), "exit_fill": (state == 0) & (was == 1), "fill_price": price, "fill_fees": fees, "_flow": flow})
    entry = F.when(F.col("entry_fill"), F.struct(F.col("ts").alias("_ts"), F.col("fill_price").alias("_price"), F.col("fill_fees").alias("_fees")))
    opened = F.coalesce(F.last(entry, ignorenulls=True).over(so_far), F.struct("_ts", "_price", "_fees"))
    out = out.withColumns({"cash": F.col("_cash") + F.sum("_flow").over(so_far), "trade_no": F.col("_trades") + F.sum(F.col("entry_fill").cast("int")).over(so_far), "_o": F.when(F.col("exit_fill"), opened)})
    gross = (F.col("fill_price") - F.col("_o._price")) * costs.qty
    out = out.withColumns({"equity": F.col("cash") + state * costs.qty * F.col("close"), "entry_ts": F.col("_o._ts"), "entry_price": F.col("_o._price"), "gross_pnl": gross, "net_pnl": gross - F.col("fill_fees") - F.col("_o._fees")})
    last, peak = F.coalesce(F.lag("equity").over(order), F.col("_equity")), F.greatest(F.max("equity").over(so_far), F.col("_peak"))
    out = out.withColumns({"_last": last, "_top": peak})
    ret = F.when(F.abs("_last") > 1e-10, (F.col("equity") - F.col("_last")) / F.col("_last")).when(F.col("_last").isNotNull(), 0.0)
    down = F.when(F.col("_top") > 0, (F.col("_top") - F.col("equity")) / F.col("_top")).otherwise(0.0)
    out = out.withColumns({"ret": ret, "drawdown": down})
    return out.drop("_e", "_x", "_f", "_t0", "_i", "_before", "_flow", "_o", "_last", "_top", *names)


def metrics(simulated: DataFrame, costs: Costs = Costs(), keys=KEYS) -> DataFrame:  # noqa: B008
    """As ``metrics.metrics``, of long_only(): partial sums by task, none of which needs a whole series."""
    return performance(simulated, costs, keys)
