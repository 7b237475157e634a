"""Signals of many configurations of a strategy at once, bar by bar, with the state of all of them in vectors.

A machine is made from a list of configurations; ``step`` takes one bar and gives two boolean vectors, entry and exit.  ``warm`` is the number of bars
before the first signal.  Comparisons with a value that isn't there yet (NaN) are false.
"""

from __future__ import annotations

import numpy as np


class History:
    """The last ``longest`` + 1 bars, newest first."""

    def __init__(self, longest: int):
        self.n, self.seen = longest + 2, 0
        self.open, self.high, self.low, self.close, self.volume, self.range = (np.full(self.n, np.nan) for _ in range(6))

    def push(self, opened: float, high: float, low: float, close: float, volume: float) -> None:
        last = self.close[0]
        span = high - low if not self.seen else max(high - low, abs(high - last), abs(low - last))
        for ring, x in ((self.open, opened), (self.high, high), (self.low, low), (self.close, close), (self.volume, volume), (self.range, span)):
            ring[1:] = ring[:-1].copy()
            ring[0] = x
        self.seen += 1


class Each:
    """A statistic of trailing windows for each configuration, computed once for each different length."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.at = np.unique(lengths, return_inverse=True)

    def mean(self, ring: np.ndarray) -> np.ndarray:
        # summed from the oldest on, as windows do
        return np.array([np.cumsum(ring[:n][::-1])[-1] / n for n in self.lengths])[self.at]

    def deviation(self, ring: np.ndarray) -> np.ndarray:
        return np.array([ring[:n].std() for n in self.lengths])[self.at]


def crossed(was: np.ndarray, now: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """Went over, went under."""
    return (was <= level) & (now > level), (was >= level) & (now < level)


class Smoothed:
    """Exponential means seeded by the simple mean of the first ``n`` values; ``wilder`` takes 1/n for 2/(n+1)."""

    def __init__(self, n: np.ndarray, wilder: bool = False):
        self.n, self.k = n, 1.0 / n if wilder else 2.0 / (n + 1)
        self.seen, self.total, self.value = np.zeros(len(n)), np.zeros(len(n)), np.full(len(n), np.nan)

    def next(self, x: np.ndarray | float) -> np.ndarray:
        x = np.broadcast_to(np.asarray(x, float), self.value.shape)
        there, growing = ~np.isnan(x), np.isnan(self.value)
        self.seen += there & growing
        self.total = np.where(there & growing, self.total + x, self.total)
        seeded = there & growing & (self.seen == self.n)
        self.value = np.where(there & ~growing, x * self.k + self.value * (1 - self.k), np.where(seeded, self.total / self.n, self.value))
        return self.value


class Machine:
    """``defaults`` names the parameters that the machine knows."""

    defaults: dict = {}

    def __init__(self, configs: list[dict]):
        for name, value in self.defaults.items():
            setattr(self, name, np.array([c.get(name, value) for c in configs]))
        self.size = len(configs)
        self.begin()

    def begin(self) -> None:
        """Set up the state and ``warm``."""

    def longest(self) -> int:
        return int(np.max(self.warm)) + 1

    def step(self, h: History) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError


class Donchian(Machine):
    defaults = {"entry": 20, "exit": 10}

    def begin(self):
        self.warm = np.maximum(self.entry, self.exit)

    def step(self, h):
        top, low = np.maximum.accumulate(h.high[1:]), np.minimum.accumulate(h.low[1:])
        return h.close[0] > top[self.entry - 1], h.close[0] < low[self.exit - 1]


class TurtleOne(Donchian):
    def begin(self):
        self.entry, self.exit = np.full(self.size, 20), np.full(self.size, 10)
        super().begin()

    defaults = {}


class TurtleTwo(TurtleOne):
    def begin(self):
        self.entry, self.exit = np.full(self.size, 55), np.full(self.size, 20)
        Donchian.begin(self)


class MaCross(Machine):
    defaults = {"fast": 10, "slow": 50, "kind": "sma"}

    def begin(self):
        self.warm, self.simple = self.slow, self.kind == "sma"
        self.means = Each(self.fast), Each(self.slow)
        self.smooth = Smoothed(self.fast.astype(float)), Smoothed(self.slow.astype(float))
        self.above, self.known = np.zeros(self.size, bool), np.zeros(self.size, bool)

    def step(self, h):
        fast, slow = (np.where(self.simple, e.mean(h.close), s.next(h.close[0])) for e, s in zip(self.means, self.smooth, strict=True))
        above, known = fast > slow, ~np.isnan(fast) & ~np.isnan(slow)
        both = known & self.known
        out = above & ~self.above & both, ~above & self.above & both
        self.above, self.known = above, known
        return out


class Tsmom(Machine):
    defaults = {"lookback": 252}

    def begin(self):
        self.warm = self.lookback

    def step(self, h):
        past = h.close[self.lookback]
        return h.close[0] > past, h.close[0] < past


class Levels(Machine):
    """An oscillator that is bought when it goes over ``over`` and left when it goes under ``under``."""

    def begin(self):
        self.was = np.full(self.size, np.nan)

    def value(self, h) -> np.ndarray:
        raise NotImplementedError

    def step(self, h):
        now = self.value(h)
        out = crossed(self.was, now, self.over)[0], crossed(self.was, now, self.under)[1]
        self.was = now
        return out


class Roc(Levels):
    defaults = {"n": 12}

    def begin(self):
        super().begin()
        self.warm, self.over, self.under = self.n + 1, 0.0, 0.0

    def value(self, h):
        past = h.close[self.n]
        return np.where(past != 0, 100.0 * (h.close[0] - past) / np.where(past == 0, 1.0, past), np.nan)


class WilliamsR(Levels):
    defaults = {"n": 14, "oversold": -80.0, "overbought": -20.0}

    def begin(self):
        super().begin()
        self.warm, self.over, self.under = self.n + 1, self.oversold, self.overbought

    def value(self, h):
        top, low = np.maximum.accumulate(h.high)[self.n - 1], np.minimum.accumulate(h.low)[self.n - 1]
        return np.where(top == low, -50.0, -100.0 * (top - h.close[0]) / np.where(top == low, 1.0, top - low))


class Rsi(Levels):
    defaults = {"n": 14, "oversold": 30.0, "overbought": 70.0}

    def begin(self):
        super().begin()
        self.warm, self.over, self.under = self.n + 1, self.oversold, self.overbought
        self.up, self.down = Smoothed(self.n.astype(float), True), Smoothed(self.n.astype(float), True)

    def value(self, h):
        change = h.close[0] - h.close[1]
        if np.isnan(change):
            return np.full(self.size, np.nan)
        up, down = self.up.next(max(change, 0.0)), self.down.next(max(-change, 0.0))
        return np.where(np.isnan(up), np.nan, np.where(down == 0, 100.0, 100.0 - 100.0 / (1.0 + up / np.where(down == 0, 1.0, down))))


class Macd(Levels):
    defaults = {"fast": 12, "slow": 26, "signal": 9, "mode": "signal"}

    def begin(self):
        super().begin()
        self.warm, self.over, self.under = self.slow + self.signal, 0.0, 0.0
        self.smooth = [Smoothed(x.astype(float)) for x in (self.fast, self.slow, self.signal)]

    def value(self, h):
        line = self.smooth[0].next(h.close[0]) - self.smooth[1].next(h.close[0])
        gap = line - self.smooth[2].next(line)
        return np.where(np.isnan(gap), np.nan, np.where(self.mode == "zero", line, gap))


class Aroon(Levels):
    defaults = {"n": 25}

    def begin(self):
        super().begin()
        self.warm, self.over, self.under = self.n, 0.0, 0.0

    def value(self, h):
        def ago(ring, accumulate, beyond):
            best = accumulate(np.nan_to_num(ring, nan=-np.inf if beyond is np.greater else np.inf))
            new = np.append(True, beyond(best[1:], best[:-1]))
            return np.maximum.accumulate(np.where(new, np.arange(len(ring)), 0))[self.n - 1]

        found = 100.0 * (ago(h.low, np.minimum.accumulate, np.less) - ago(h.high, np.maximum.accumulate, np.greater)) / self.n
        return np.where(h.seen >= self.n, found, np.nan)


class Supertrend(Machine):
    defaults = {"atr": 10, "k": 3.0, "classic": False}

    def begin(self):
        self.warm, self.mean = self.atr, Each(self.atr)
        self.upper, self.lower, self.up = np.full(self.size, np.nan), np.full(self.size, np.nan), np.ones(self.size, bool)

    def trend(self, h) -> tuple[np.ndarray, np.ndarray]:
        """Turned up, turned down."""
        atr, middle, last, close = self.mean.mean(h.range), (h.high[0] + h.low[0]) / 2.0, h.close[1], h.close[0]
        upper, lower = middle + self.k * atr, middle - self.k * atr
        known = ~np.isnan(self.upper)
        over, under = last > self.upper, last < self.lower
        keep_upper = known & ~(np.where(self.classic, upper < self.upper, upper > self.upper) | over)
        keep_lower = known & ~(np.where(self.classic, lower > self.lower, lower < self.lower) | under)
        upper, lower = np.where(keep_upper, self.upper, upper), np.where(keep_lower, self.lower, lower)
        was = self.up
        self.up = np.where(known, np.where(was, ~(close < lower), close > upper), was)
        self.upper, self.lower = upper, lower
        return self.up & ~was, ~self.up & was

    def step(self, h):
        return self.trend(h)


class SupertrendCooldown(Supertrend):
    defaults = Supertrend.defaults | {"cooldown": 5}


class SupertrendVolume(Supertrend):
    defaults = Supertrend.defaults | {"volume": 20, "pct": 1.0}

    def begin(self):
        super().begin()
        self.warm, self.volumes = np.maximum(self.atr, self.volume), Each(self.volume)

    def step(self, h):
        up, down = self.trend(h)
        return up & (h.volume[0] >= self.pct * self.volumes.mean(h.volume)), down


class SupertrendConfirmed(Supertrend):
    defaults = Supertrend.defaults | {"confirm": 3}

    def begin(self):
        super().begin()
        self.warm, self.run = self.atr + self.confirm, np.zeros(self.size, int)

    def step(self, h):
        self.trend(h)
        known = ~np.isnan(self.upper)
        self.run = np.where(known & self.up, self.run + 1, 0)
        return self.run == self.confirm, known & ~self.up


class SupertrendAsymmetric(Machine):
    defaults = {"atr": 10, "entry_k": 2.0, "exit_k": 3.0, "classic": False}

    def __init__(self, configs):
        super().__init__(configs)
        self.sides = [Supertrend([{"atr": c.get("atr", 10), "k": c.get(k, d), "classic": c.get("classic", False)} for c in configs]) for k, d in (("entry_k", 2.0), ("exit_k", 3.0))]

    def begin(self):
        self.warm = self.atr

    def step(self, h):
        enter, leave = (s.trend(h) for s in self.sides)
        return enter[0], leave[1]


class Keltner(Machine):
    defaults = {"ema": 20, "atr": 10, "k": 2.0}

    def begin(self):
        self.warm, self.ranges, self.center = np.maximum(self.ema, self.atr), Each(self.atr), Smoothed(self.ema.astype(float))

    def step(self, h):
        middle, reach, close = self.center.next(h.close[0]), self.k * self.ranges.mean(h.range), h.close[0]
        return close > middle + reach, (close < middle - reach) | (close < middle)


class Starc(Machine):
    defaults = {"sma": 20, "atr": 15, "k": 2.0}

    def begin(self):
        self.warm, self.ranges, self.center = np.maximum(self.sma, self.atr), Each(self.atr), Each(self.sma)

    def step(self, h):
        middle, reach, close = self.center.mean(h.close), self.k * self.ranges.mean(h.range), h.close[0]
        return close > middle + reach, close < middle - reach


class BollingerSqueeze(Machine):
    defaults = {"n": 20, "k": 2.0, "squeeze": 0.1}

    def begin(self):
        self.warm, self.each, self.tight = self.n, Each(self.n), np.zeros(self.size, bool)

    def step(self, h):
        middle, reach, close = self.each.mean(h.close), self.k * self.each.deviation(h.close), h.close[0]
        tight = np.where(middle > 0, 2 * reach / np.where(middle > 0, middle, 1.0), np.where(np.isnan(middle), np.nan, 0.0)) < self.squeeze
        out = (tight | self.tight) & (close > middle + reach), close < middle
        self.tight = tight
        return out


class High(Machine):
    defaults = {"n": 252, "entry_pct": 0.95, "exit_pct": 0.9}

    def begin(self):
        self.warm = self.n

    def proximity(self, h):
        top = np.maximum.accumulate(h.close)[self.n - 1]
        return np.where(top > 0, h.close[0] / np.where(top > 0, top, 1.0), np.where(np.isnan(top), np.nan, 0.0))

    def step(self, h):
        near = self.proximity(h)
        return near >= self.entry_pct, near < self.exit_pct


class HighMomentum(High):
    defaults = High.defaults | {"momentum": 20, "least": 0.0}

    def begin(self):
        self.warm = np.maximum(self.n, self.momentum)

    def step(self, h):
        near, past = self.proximity(h), h.close[self.momentum]
        change = np.where(past != 0, 100.0 * (h.close[0] - past) / np.where(past == 0, 1.0, past), np.nan)
        return (near >= self.entry_pct) & (change >= self.least), near < self.exit_pct


class HighTrailing(High):
    defaults = {"n": 252, "entry_pct": 0.95, "trail": 0.1}

    def begin(self):
        super().begin()
        self.top, self.far = np.full(self.size, np.nan), np.ones(self.size, bool)

    def step(self, h):
        near, close = self.proximity(h), h.close[0]
        far = ~(near >= self.entry_pct)
        self.top = np.where(far, self.top, np.where(self.far, close, np.fmax(self.top, close)))
        self.far = far
        return near >= self.entry_pct, close < (1.0 - self.trail) * self.top


class DmiAdx(Machine):
    defaults = {"di": 14, "adx": 14, "threshold": 25.0}

    def begin(self):
        self.warm = self.di + self.adx
        self.plus, self.minus, self.range, self.strength = (Smoothed(self.di.astype(float), True) for _ in range(4))

    def step(self, h):
        up, down = h.high[0] - h.high[1], h.low[1] - h.low[0]
        up, down = (up if up > down and up > 0 else 0.0), (down if down > up and down > 0 else 0.0)
        plus, minus, span = self.plus.next(up), self.minus.next(down), self.range.next(h.range[0])
        moving = span != 0
        plus, minus = (np.where(moving, 100.0 * x / np.where(moving, span, 1.0), 0.0) for x in (plus, minus))
        both = plus + minus
        index = np.where(both != 0, 100.0 * np.abs(plus - minus) / np.where(both != 0, both, 1.0), 0.0)
        strength = self.strength.next(np.where(np.isnan(span), np.nan, index))
        return (plus > minus) & (strength > self.threshold), (plus <= minus) | (strength < self.threshold)


class LarryWilliams(Machine):
    defaults = {"k": 0.5, "stop": 2.0, "atr": 14}

    def begin(self):
        self.warm, self.ranges = self.atr, Each(self.atr)

    def step(self, h):
        before = h.high[1] - h.low[1]
        return h.close[0] > h.open[0] + self.k * (0.0 if np.isnan(before) else before), h.close[0] < np.nanmax(h.high[:5]) - self.stop * self.ranges.mean(h.range)


class HeikinAshi(Machine):
    defaults = {"confirm": 3}

    def begin(self):
        self.warm, self.last, self.bears = self.confirm + 1, None, 0

    def step(self, h):
        close = (h.open[0] + h.high[0] + h.low[0] + h.close[0]) / 4.0
        opened = (h.open[0] + h.close[0]) / 2.0 if self.last is None else (self.last[0] + self.last[1]) / 2.0
        self.last, bears, bear = (opened, close), self.bears, close < opened
        self.bears = bears + 1 if bear else 0
        return (close > opened) & (bears >= self.confirm), np.full(self.size, bear)


MACHINES: dict[str, type[Machine]] = {
    "donchian": Donchian, "turtle_s1": TurtleOne, "turtle_s2": TurtleTwo, "ma_cross": MaCross, "tsmom": Tsmom, "roc": Roc, "williams_r": WilliamsR, "rsi": Rsi, "macd": Macd, "aroon": Aroon,
    "supertrend": Supertrend, "supertrend_cooldown": SupertrendCooldown, "supertrend_volume": SupertrendVolume, "supertrend_confirmed": SupertrendConfirmed, "supertrend_asymmetric": SupertrendAsymmetric,
    "keltner": Keltner, "starc": Starc, "bollinger_squeeze": BollingerSqueeze, "high_52w": High, "high_52w_momentum": HighMomentum, "high_52w_trailing": HighTrailing, "dmi_adx": DmiAdx, "larry_williams": LarryWilliams, "heikin_ashi": HeikinAshi,
}


def handles(strategy: str, config: dict) -> bool:
    return strategy in MACHINES and set(config) <= set(MACHINES[strategy].defaults)
