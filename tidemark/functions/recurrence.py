"""Recurrences along a series: values that depend on the value at the bar before.

``along`` deals rows by series, sorts each partition, and passes through the sorted rows batch by batch, carrying each series' state from
one Arrow batch to the next.  So a series of any length takes bounded memory, and no series is gathered as a group.  Steppers are small
state machines: ``step(row)`` gets a bar as a tuple of the input columns and gives a tuple of the output columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

Value = float | None


def along(df: DataFrame, keys: list[str], order: list[str], steppers: dict[str, tuple[Callable[[], object], list[str], str]]) -> DataFrame:
    """``df`` with columns added by steppers.

    ``steppers``: by name, (maker of a stepper, its input columns, its output columns as DDL).
    """
    kinds = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)
    added = ", ".join(ddl for _, _, ddl in steppers.values())
    outputs = {name: [f.strip().split(" ")[0] for f in ddl.split(",")] for name, (_, _, ddl) in steppers.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machines = None, {}
        for b in batches:
            found = {c: [] for cols in outputs.values() for c in cols}
            inputs = {n: list(zip(*(b[c].astype(object).where(b[c].notna(), None) for c in cols), strict=True)) for n, (_, cols, _) in steppers.items()}
            for i, now in enumerate(zip(*(b[k] for k in keys), strict=True)):
                if now != key:
                    key, machines = now, {n: make() for n, (make, _, _) in steppers.items()}
                for n, m in machines.items():
                    for c, v in zip(outputs[n], m.step(*inputs[n][i]), strict=True):
                        found[c].append(v)
            yield b.assign(**found)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{kinds}, {added}")


@dataclass
class Ema:
    """Exponential mean with factor 2/(n+1), seeded by the simple mean of the first ``n`` values; nulls before the seed don't count."""

    n: int
    seen: int = 0
    total: float = 0.0
    value: Value = None

    def factor(self) -> float:
        return 2.0 / (self.n + 1)

    def next(self, x: Value) -> Value:
        if x is None or self.n <= 0:
            return self.value
        if self.value is None:
            self.seen, self.total = self.seen + 1, self.total + x
            if self.seen == self.n:
                self.value = self.total / self.n
        else:
            k = self.factor()
            self.value = x * k + self.value * (1 - k)
        return self.value

    def step(self, x: Value) -> tuple[Value]:
        return (self.next(x),)


@dataclass
class Wilder(Ema):
    """Wilder's smoothing: factor 1/n, the same seed."""

    def factor(self) -> float:
        return 1.0 / self.n


@dataclass
class EmaAdjusted:
    """The weighted mean of all values so far with weights (1-k)**age; null before ``n`` values."""

    n: int
    k: float
    seen: int = 0
    above: float = 0.0
    below: float = 0.0

    def step(self, x: Value) -> tuple[Value]:
        if x is not None:
            self.seen, self.above, self.below = self.seen + 1, self.above * (1 - self.k) + x, self.below * (1 - self.k) + 1
        return (self.above / self.below if self.seen >= self.n and self.below else None,)


class AdjustedMean(EmaAdjusted):
    def next(self, x: Value) -> Value:
        return self.step(x)[0]


class Macd:
    """line, signal, histogram; null until all exist."""

    def __init__(self, fast: int, slow: int, signal: int):
        self.fast, self.slow, self.signal = Ema(fast), Ema(slow), Ema(signal)

    def step(self, x: Value) -> tuple[Value, Value, Value]:
        a, b = self.fast.next(x), self.slow.next(x)
        line = None if a is None or b is None else a - b
        s = self.signal.next(line)
        return (None, None, None) if line is None or s is None else (line, s, line - s)


class Rsi:
    """Wilder's relative strength over changes; 100 without losses."""

    def __init__(self, n: int):
        self.up, self.down, self.last = Wilder(n), Wilder(n), None

    def step(self, x: float) -> tuple[Value]:
        last, self.last = self.last, x
        if last is None:
            return (None,)
        up, down = self.up.next(max(x - last, 0.0)), self.down.next(max(last - x, 0.0))
        if up is None:
            return (None,)
        return (100.0 if down == 0 else 100.0 - 100.0 / (1.0 + up / down),)


class Dmi:
    """plus_di, minus_di, adx (null until all exist)."""

    def __init__(self, n: int):
        self.plus, self.minus, self.range, self.adx, self.last = Wilder(n), Wilder(n), Wilder(n), Wilder(n), None

    def step(self, high: float, low: float, close: float) -> tuple[Value, Value, Value]:
        last, self.last = self.last, (high, low, close)
        up, down, tr = 0.0, 0.0, high - low
        if last:
            up, down = high - last[0], last[1] - low
            up, down = (up if up > down and up > 0 else 0.0), (down if down > up and down > 0 else 0.0)
            tr = max(high - low, abs(high - last[2]), abs(low - last[2]))
        p, m, a = self.plus.next(up), self.minus.next(down), self.range.next(tr)
        if a is None:
            return None, None, None
        p, m = (100.0 * p / a, 100.0 * m / a) if a else (0.0, 0.0)
        adx = self.adx.next(100.0 * abs(p - m) / (p + m) if p + m else 0.0)
        return p, m, adx


class DmiAdjusted(Dmi):
    """Dmi by weighted means of all values so far with weights (1 - 1/n)**age, instead of Wilder's."""

    def __init__(self, n: int):
        self.plus, self.minus, self.range, self.adx = (AdjustedMean(n, 1.0 / n) for _ in range(4))
        self.last = None


class HeikinAshi:
    """ha_open, ha_high, ha_low, ha_close."""

    def __init__(self):
        self.last = None

    def step(self, o: float, h: float, lo: float, c: float) -> tuple[float, float, float, float]:
        close = (o + h + lo + c) / 4.0
        opened = (o + c) / 2.0 if self.last is None else (self.last[0] + self.last[1]) / 2.0
        self.last = opened, close
        return opened, max(h, opened, close), min(lo, opened, close), close


class HeikinAshiAdjusted:
    """HeikinAshi whose open is the weighted mean of all closes before, with weights halved at each bar; the first is the middle of the body."""

    def __init__(self):
        self.mean = AdjustedMean(1, 0.5)

    def step(self, o: float, h: float, lo: float, c: float) -> tuple[float, float, float, float]:
        close = (o + h + lo + c) / 4.0
        opened = (o + c) / 2.0 if not self.mean.seen else self.mean.above / self.mean.below
        self.mean.next(close)
        return opened, max(h, opened, close), min(lo, opened, close), close


class Supertrend:
    """st_up, st_value from atr (null during warm-up).

    ``classic`` narrows the bands towards the price, as the indicator is usually defined.  Otherwise the bands move the other way: the upper one
    is kept unless the new one is higher or the last close was above it, and the lower one likewise.
    """

    def __init__(self, k: float, classic: bool = False):
        self.k, self.classic = k, classic
        self.upper = self.lower = self.close = None
        self.up = True

    def step(self, high: float, low: float, close: float, atr: Value) -> tuple[bool | None, Value]:
        if atr is None:
            return None, None
        upper, lower = (high + low) / 2.0 + self.k * atr, (high + low) / 2.0 - self.k * atr
        if self.upper is not None:
            over, under = self.close > self.upper, self.close < self.lower
            if self.classic:
                upper, lower = (upper if upper < self.upper or over else self.upper), (lower if lower > self.lower or under else self.lower)
            else:
                upper, lower = (upper if upper > self.upper or over else self.upper), (lower if lower < self.lower or under else self.lower)
            if self.up and close < lower:
                self.up = False
            elif not self.up and close > upper:
                self.up = True
        self.upper, self.lower, self.close = upper, lower, close
        return self.up, lower if self.up else upper


class ParabolicSar:
    """sar, sar_up after a warm-up of five bars; the trend turns on closes."""

    WARM_UP = 5

    def __init__(self, start: float = 0.02, step: float = 0.02, most: float = 0.2):
        self.start, self.add, self.most = start, step, most
        self.bars: list[tuple[float, float, float]] = []
        self.sar: Value = None
        self.up, self.extreme, self.factor = True, 0.0, start

    def step(self, high: float, low: float, close: float) -> tuple[Value, bool | None]:
        self.bars = [*self.bars[-(self.WARM_UP - 1) :], (high, low, close)]
        if self.sar is None:
            if len(self.bars) < self.WARM_UP:
                return None, None
            highs, lows, closes = zip(*self.bars, strict=True)
            self.up = closes[-1] >= closes[0]
            self.sar, self.extreme = (min(lows), max(highs)) if self.up else (max(highs), min(lows))
            return self.sar, self.up
        sar = self.sar + self.factor * (self.extreme - self.sar)
        two = self.bars[-3:-1]
        sar = min(sar, *(b[1] for b in two)) if self.up else max(sar, *(b[0] for b in two))
        if (close < sar) if self.up else (close > sar):
            self.up, sar, self.factor = not self.up, self.extreme, self.start
            self.extreme = high if self.up else low
        elif (high > self.extreme) if self.up else (low < self.extreme):
            self.extreme, self.factor = (high if self.up else low), min(self.factor + self.add, self.most)
        self.sar = sar
        return self.sar, self.up


class Darvas:
    """box_top, box_bottom, box_complete; null without a box.

    A new high may become the top; ``n`` lower highs confirm it, and the lowest low since is the bottom; ``n`` lows above the low before
    them, without a new lowest low between, complete the box.  A complete box stays until a high goes over its top.
    """

    def __init__(self, n: int = 3):
        self.n, self.complete, self.bottom = n, False, None
        self.top = self.floor = self.last_low = None
        self.count = 0

    def _begin(self, high: float, low: float) -> None:
        self.top, self.floor, self.bottom, self.count, self.complete = high, low, None, 0, False

    def step(self, high: float, low: float) -> tuple[Value, Value, bool | None]:
        if self.complete:
            if high > self.top:
                self._begin(high, low)
                self.last_low = low
        elif self.bottom is None:
            if self.top is None or high >= self.top:
                self._begin(high, low)
            else:
                self.count, self.floor = self.count + 1, min(self.floor, low)
                if self.count >= self.n:
                    self.bottom, self.count, self.last_low = self.floor, 0, low
        else:
            if low > self.last_low:
                self.count += 1
                self.complete = self.count >= self.n
            elif low < self.bottom:
                self.bottom, self.count = low, 0
            self.last_low = low
        return (None, None, None) if self.bottom is None else (self.top, self.bottom, self.complete)


# --- DataFrame forms ---

CLOSE, HLC, OHLC = ["close"], ["high", "low", "close"], ["open", "high", "low", "close"]


def ema(n: int, name: str = "ema", column: str = "close"):
    return lambda: Ema(n), [column], f"{name} double"


def wilder(n: int, column: str, name: str):
    return lambda: Wilder(n), [column], f"{name} double"


def ema_adjusted(n: int, name: str = "ema_adjusted", column: str = "close"):
    return lambda: EmaAdjusted(n, 2.0 / (n + 1)), [column], f"{name} double"


def wilder_adjusted(n: int, column: str, name: str):
    return lambda: EmaAdjusted(n, 1.0 / n), [column], f"{name} double"


def dmi_adjusted(n: int = 14, prefix: str = "adjusted_"):
    return lambda: DmiAdjusted(n), HLC, f"{prefix}plus_di double, {prefix}minus_di double, {prefix}adx double"


def heikin_ashi_adjusted(prefix: str = "adjusted_"):
    return HeikinAshiAdjusted, OHLC, ", ".join(f"{prefix}ha_{c} double" for c in ("open", "high", "low", "close"))


def macd(fast: int = 12, slow: int = 26, signal: int = 9, prefix: str = "macd"):
    return lambda: Macd(fast, slow, signal), CLOSE, f"{prefix} double, {prefix}_signal double, {prefix}_hist double"


def rsi(n: int = 14, name: str = "rsi"):
    return lambda: Rsi(n), CLOSE, f"{name} double"


def dmi(n: int = 14):
    return lambda: Dmi(n), HLC, "plus_di double, minus_di double, adx double"


def heikin_ashi():
    return HeikinAshi, OHLC, "ha_open double, ha_high double, ha_low double, ha_close double"


def supertrend(k: float = 3.0, atr: str = "atr", classic: bool = False, prefix: str = "st"):
    return lambda: Supertrend(k, classic), [*HLC, atr], f"{prefix}_up boolean, {prefix}_value double"


def parabolic_sar(start: float = 0.02, step: float = 0.02, most: float = 0.2):
    return lambda: ParabolicSar(start, step, most), HLC, "sar double, sar_up boolean"


def darvas(n: int = 3):
    return lambda: Darvas(n), ["high", "low"], "box_top double, box_bottom double, box_complete boolean"
