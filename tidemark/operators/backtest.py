"""Simulation of signals: fills at the next bar's open, costs, cash and equity.

``long_only`` is closed-form: a position is an automaton of two states whose inputs are set, reset and toggle, so its state is the
last set or reset before the bar, flipped by the parity of the toggles since.  Everything is windows over one key, hence one exchange and one
sort, and it runs in the JVM.  Shorts, sized positions and pyramids depend on prices along the path, and are carried along the series.

Inputs: ``keys``, ts, open, close, raw_entry, raw_exit (and raw_entry_short, raw_exit_short); a null signal is false.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.recurrence import along
from tidemark.schema import KEYS, before, series, so_far


@dataclass(frozen=True)
class Costs:
    cash: float = 100_000.0
    qty: float = 1.0
    fee_bps: float = 0.0
    slip_bps: float = 0.0

    def __post_init__(self):
        if self.cash <= 0 or self.qty <= 0:
            raise ValueError("cash and quantity must be positive")

    def buy(self, price):
        return price * (1.0 + self.slip_bps / 10_000)

    def sell(self, price):
        return price * (1.0 - self.slip_bps / 10_000)

    def fees(self, price, qty):
        return price * qty * (self.fee_bps / 10_000)


def positions(signals: DataFrame, keys=KEYS) -> DataFrame:
    """``signals`` with position_state (1 or 0 after the fill at the open), entry_fill, exit_fill."""
    e, x = F.coalesce("raw_entry", F.lit(False)), F.coalesce("raw_exit", F.lit(False))
    out = signals.withColumns({"_e": e.cast("int"), "_x": x.cast("int")})
    out = out.withColumn("_t", F.sum(F.col("_e") * F.col("_x")).over(so_far(keys)))
    fixed = F.last(F.when(F.col("_e") != F.col("_x"), F.struct("_e", "_t")), ignorenulls=True).over(before(keys))
    state = (F.coalesce(fixed["_e"], F.lit(0)) + F.coalesce(F.lag("_t").over(series(keys)), F.lit(0)) - F.coalesce(fixed["_t"], F.lit(0))) % 2
    out = out.withColumn("position_state", state.cast("int")).drop("_e", "_x", "_t")
    was = F.lag("position_state", 1, 0).over(series(keys))
    return out.withColumns({"entry_fill": (F.col("position_state") == 1) & (was == 0), "exit_fill": (F.col("position_state") == 0) & (was == 1)})


def long_only(signals: DataFrame, costs: Costs = Costs(), keys=KEYS) -> DataFrame:  # noqa: B008
    """positions() with fill_price, fill_fees, cash, equity, trade_no and, at exits, entry_price, gross_pnl, net_pnl."""
    out = positions(signals, keys)
    price = F.when(F.col("entry_fill"), costs.buy(F.col("open"))).when(F.col("exit_fill"), costs.sell(F.col("open")))
    out = out.withColumn("fill_price", price)
    out = out.withColumn("fill_fees", costs.fees(F.col("fill_price"), costs.qty))
    flow = F.when(F.col("entry_fill"), -F.col("fill_price") * costs.qty - F.col("fill_fees")).when(F.col("exit_fill"), F.col("fill_price") * costs.qty - F.col("fill_fees")).otherwise(0.0)
    opened = F.last(F.when(F.col("entry_fill"), F.struct("ts", "fill_price", "fill_fees")), ignorenulls=True).over(so_far(keys))
    out = out.withColumns({"cash": costs.cash + F.sum(flow).over(so_far(keys)), "trade_no": F.sum(F.col("entry_fill").cast("int")).over(so_far(keys)), "_opened": F.when(F.col("exit_fill"), opened)})
    gross = (F.col("fill_price") - F.col("_opened.fill_price")) * costs.qty
    return out.withColumns(
        {
            "equity": F.col("cash") + F.col("position_state") * costs.qty * F.col("close"),
            "entry_ts": F.col("_opened.ts"),
            "entry_price": F.col("_opened.fill_price"),
            "gross_pnl": gross,
            "net_pnl": gross - F.col("fill_fees") - F.col("_opened.fill_fees"),
        }
    ).drop("_opened")


def trades(simulated: DataFrame, keys=KEYS) -> DataFrame:
    """One row per closed trade."""
    return simulated.where("exit_fill").select(*keys, "trade_no", "entry_ts", F.col("ts").alias("exit_ts"), "entry_price", F.col("fill_price").alias("exit_price"), "gross_pnl", "net_pnl")


def fills(simulated: DataFrame, keys=KEYS) -> DataFrame:
    return simulated.where("entry_fill or exit_fill").select(*keys, "ts", F.when(F.col("entry_fill"), "buy").otherwise("sell").alias("side"), "fill_price", "fill_fees")


def paired(fill_rows: DataFrame, keys=KEYS) -> DataFrame:
    """Trades from a table of fills (keys, ts, side, fill_price, fill_fees): each sell with the latest buy before it."""
    opened = F.last(F.when(F.col("side") == "buy", F.struct("ts", "fill_price", "fill_fees")), ignorenulls=True).over(so_far(keys))
    out = fill_rows.withColumn("_o", opened).where("side = 'sell' and _o is not null")
    return out.select(*keys, F.col("_o.ts").alias("entry_ts"), F.col("ts").alias("exit_ts"), F.col("_o.fill_price").alias("entry_price"), F.col("fill_price").alias("exit_price"))


class _Path:
    """Three states with fixed or sized quantities; ``mode`` masks signals."""

    def __init__(self, costs: Costs, mode: str):
        self.costs, self.mode = costs, mode
        self.cash, self.qty, self.pending, self.entry = costs.cash, 0.0, None, None

    def step(self, opened, close, entry, leave, entry_short, leave_short, size):
        c, price, fees, net, side = self.costs, None, None, None, None
        if self.pending:
            side, qty = self.pending
            price = c.buy(opened) if side in ("entry", "exit_short") else c.sell(opened)
            signed = {"entry": qty, "exit": -self.qty, "entry_short": -qty, "exit_short": -self.qty}[side]
            fees = c.fees(price, abs(signed))
            self.cash -= price * signed + fees
            if side.startswith("entry"):
                self.entry, self.qty = (price, fees), signed
            else:
                net, self.qty = (price - self.entry[0]) * self.qty - fees - self.entry[1], 0.0
        self.pending = None
        longs, shorts = self.mode != "short_only", self.mode != "long_only"
        if self.qty == 0:
            if longs and entry and size is not None:
                self.pending = "entry", size
            elif shorts and entry_short and size is not None:
                self.pending = "entry_short", size
        elif self.qty > 0 and leave:
            self.pending = "exit", 0
        elif self.qty < 0 and leave_short:
            self.pending = "exit_short", 0
        state = (self.qty > 0) - (self.qty < 0)
        return state, side, price, fees, net, self.cash, self.qty, self.cash + self.qty * close


def along_path(signals: DataFrame, costs: Costs = Costs(), mode: str = "long_short", size: str | None = None, keys=KEYS) -> DataFrame:  # noqa: B008
    """position_state (-1, 0, 1), fill_side, fill_price, fill_fees, net_pnl (at exits), cash, position_qty, equity.

    ``size`` names a column of quantities, taken at the bar of the signal; an entry without one is skipped."""
    if mode not in ("long_only", "short_only", "long_short"):
        raise ValueError(mode)
    names = ["raw_entry", "raw_exit", "raw_entry_short", "raw_exit_short"]
    have = signals.withColumns({n: F.coalesce(n, F.lit(False)) if n in signals.columns else F.lit(False) for n in names} | {"_size": F.col(size) if size else F.lit(costs.qty)})
    ddl = "position_state int, fill_side string, fill_price double, fill_fees double, net_pnl double, cash double, position_qty double, equity double"
    return along(have, list(keys), ["ts"], {"path": (lambda: _Path(costs, mode), ["open", "close", *names, "_size"], ddl)}).drop("_size")


def volatility_size(target: float, atr: Column, most: float = 1e9, least: float = 1.0) -> Column:
    """target / (ATR x price), between ``least`` and ``most``; null where ATR or price isn't positive."""
    return F.when((atr > 0) & (F.col("close") > 0), F.least(F.greatest(target / (atr * F.col("close")), F.lit(least)), F.lit(most)))


def target_from_risk(account: float, percent: float) -> float:
    return account * percent / 100.0


def turtle_size(account: float, atr: Column, most: float = 1e9, least: float = 1.0) -> Column:
    """The preset of one percent of the account at risk; ``atr`` is Wilder's."""
    return volatility_size(target_from_risk(account, 1.0), atr, most, least)


class _Pyramid:
    """Adds a unit each time close is ``k`` entry ATRs above the last fill, up to ``units``; all leave together."""

    def __init__(self, costs: Costs, units: int, k: float):
        self.costs, self.units, self.k = costs, units, k
        self.cash, self.entries, self.pending, self.atr, self.last_atr = costs.cash, [], None, None, None

    def step(self, opened, close, entry, leave, atr):
        c, fill, price, net, average, count = self.costs, None, None, None, None, None
        if self.pending in ("entry", "add"):
            fill, price = self.pending, c.buy(opened)
            fees = c.fees(price, c.qty)
            if fill == "entry":
                self.atr = 4.0 if self.last_atr is None else self.last_atr
            self.entries.append((price, fees))
            self.cash -= price * c.qty + fees
        elif self.pending == "exit":
            fill, price = "exit", c.sell(opened)
            qty = c.qty * len(self.entries)
            fees = c.fees(price, qty)
            average, count = sum(p for p, _ in self.entries) / len(self.entries), len(self.entries)
            net = (price - average) * qty - fees - sum(f for _, f in self.entries)
            self.cash += price * qty - fees
            self.entries = []
        self.pending, self.last_atr = None, atr
        if not self.entries:
            self.pending = "entry" if entry else None
        elif leave:
            self.pending = "exit"
        elif len(self.entries) < self.units and close >= self.entries[-1][0] + self.k * self.atr:
            self.pending = "add"
        held = len(self.entries)
        return held, fill, price, count, average, net, self.cash, self.cash + held * c.qty * close


def pyramid(signals: DataFrame, atr: str, costs: Costs = Costs(), units: int = 4, k: float = 0.5, keys=KEYS) -> DataFrame:  # noqa: B008
    """units, fill, fill_price, exit_units and avg_entry_price (at exits), net_pnl, cash, equity; ``atr`` names Wilder's ATR."""
    ddl = "units int, fill string, fill_price double, exit_units int, avg_entry_price double, net_pnl double, cash double, equity double"
    have = signals.withColumns({n: F.coalesce(n, F.lit(False)) for n in ("raw_entry", "raw_exit")})
    return along(have, list(keys), ["ts"], {"pyramid": (lambda: _Pyramid(costs, units, k), ["open", "close", "raw_entry", "raw_exit", atr], ddl)})
