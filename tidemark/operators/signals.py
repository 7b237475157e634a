"""Strategies: functions from bars to boolean columns raw_entry and raw_exit (and raw_entry_short, raw_exit_short).

A null comparison is no signal.  Every signal is masked until the strategy's warm-up, as a number of bars.  ``STRATEGIES`` has them by name, with
their default parameters as keyword arguments.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.functions import recurrence as rec
from tidemark.schema import KEYS, bar_number, series, so_far

STRATEGIES: dict[str, Callable[..., DataFrame]] = {}


def strategy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    STRATEGIES[f.__name__] = f
    return f


def _c(name: str) -> Column:
    return F.col(name)


def _was(column: str, keys, n: int = 1) -> Column:
    return F.lag(column, n).over(series(keys))


def _emit(df: DataFrame, warm_up: int, entry: Column, leave: Column, keys, short: tuple[Column, Column] | None = None) -> DataFrame:
    found = {"raw_entry": entry, "raw_exit": leave} | ({"raw_entry_short": short[0], "raw_exit_short": short[1]} if short else {})
    ready = _c("_ready")
    return df.withColumn("_ready", bar_number(keys) >= warm_up).withColumns({k: F.coalesce(v & ready, F.lit(False)) for k, v in found.items()}).drop("_ready")


def _crosses(a: str, b: Column | float, keys, up: bool) -> Column:
    """a goes over (under) b: it is beyond b now and wasn't a bar ago."""
    was = _was(a, keys)
    return ((was <= b) & (_c(a) > b)) if up else ((was >= b) & (_c(a) < b))


def _run_length(df: DataFrame, flag: str, name: str, keys) -> DataFrame:
    """Length of the run of true values that ends at the bar."""
    broken = F.last(F.when(~F.coalesce(flag, F.lit(False)), _c("_i")), ignorenulls=True).over(so_far(keys))
    return df.withColumn("_i", bar_number(keys)).withColumn(name, (_c("_i") - F.coalesce(broken, F.lit(-1))).cast("int")).drop("_i")


def _rec(df: DataFrame, keys, **steppers) -> DataFrame:
    return rec.along(df, list(keys), ["ts"], steppers)


@strategy
def donchian(bars, entry: int = 20, exit: int = 10, keys=KEYS):
    top, low = ind.donchian(entry, keys)
    top2, low2 = ind.donchian(exit, keys)
    df = bars.withColumns({"dc_entry_upper": top, "dc_entry_lower": low, "dc_exit_upper": top2, "dc_exit_lower": low2})
    close = _c("close")
    return _emit(df, max(entry, exit), close > _c("dc_entry_upper"), close < _c("dc_exit_lower"), keys, (close < _c("dc_entry_lower"), close > _c("dc_exit_upper")))


@strategy
def ma_cross(bars, fast: int = 10, slow: int = 50, kind: str = "sma", keys=KEYS):
    if kind == "sma":
        df = bars.withColumns({"ma_fast": ind.sma(fast, keys=keys), "ma_slow": ind.sma(slow, keys=keys)})
    else:
        df = _rec(bars, keys, fast=rec.ema(fast, "ma_fast"), slow=rec.ema(slow, "ma_slow"))
    df = df.withColumn("_above", _c("ma_fast") > _c("ma_slow"))
    was = _was("_above", keys)
    up, down = _c("_above") & ~was, ~_c("_above") & was
    return _emit(df, slow, up, down, keys, (down, up)).drop("_above")


@strategy
def tsmom(bars, lookback: int = 252, keys=KEYS):
    df = bars.withColumn("past_close", F.lag("close", lookback).over(series(keys)))
    up, down = _c("close") > _c("past_close"), _c("close") < _c("past_close")
    return _emit(df, lookback, up, down, keys, (down, up))


@strategy
def hold(bars, keys=KEYS):
    """The baseline that never trades."""
    return bars.withColumns({"raw_entry": F.lit(False), "raw_exit": F.lit(False)})


@strategy
def keltner(bars, ema: int = 20, atr: int = 10, k: float = 2.0, keys=KEYS):
    df = ind.with_true_range(bars, keys).withColumn("_atr", ind.atr(atr, keys))
    df = _rec(df, keys, ema=rec.ema(ema, "kc_center")).withColumns({"kc_upper": _c("kc_center") + k * _c("_atr"), "kc_lower": _c("kc_center") - k * _c("_atr")})
    close = _c("close")
    return _emit(df, max(ema, atr), close > _c("kc_upper"), (close < _c("kc_lower")) | (close < _c("kc_center")), keys, (close < _c("kc_lower"), (close > _c("kc_upper")) | (close > _c("kc_center")))).drop("_atr")


@strategy
def starc(bars, sma: int = 20, atr: int = 15, k: float = 2.0, keys=KEYS):
    mid, up, low = ind.starc(sma, atr, k, keys)
    df = ind.with_true_range(bars, keys).withColumns({"starc_mid": mid, "starc_upper": up, "starc_lower": low})
    close = _c("close")
    return _emit(df, max(sma, atr), close > _c("starc_upper"), close < _c("starc_lower"), keys, (close < _c("starc_lower"), close > _c("starc_upper")))


def _with_supertrend(bars, atr: int, k: float, classic: bool, keys, prefix: str = "st"):
    df = ind.with_true_range(bars, keys).withColumn("atr", ind.atr(atr, keys))
    return _rec(df, keys, **{prefix: rec.supertrend(k, "atr", classic, prefix)})


def _flips(column: str, keys) -> tuple[Column, Column]:
    was = _was(column, keys)
    return _c(column) & ~was, ~_c(column) & was


@strategy
def supertrend(bars, atr: int = 10, k: float = 3.0, classic: bool = False, keys=KEYS):
    return _emit(_with_supertrend(bars, atr, k, classic, keys), atr, *_flips("st_up", keys), keys)


@strategy
def supertrend_volume(bars, atr: int = 10, k: float = 3.0, volume: int = 20, pct: float = 1.0, classic: bool = False, keys=KEYS):
    df = _with_supertrend(bars, atr, k, classic, keys).withColumn("volume_sma", ind.sma(volume, "volume", keys))
    up, down = _flips("st_up", keys)
    return _emit(df, max(atr, volume), up & (_c("volume") >= pct * _c("volume_sma")), down, keys)


@strategy
def supertrend_confirmed(bars, atr: int = 10, k: float = 3.0, confirm: int = 3, classic: bool = False, keys=KEYS):
    df = _run_length(_with_supertrend(bars, atr, k, classic, keys), "st_up", "st_run", keys)
    return _emit(df, atr + confirm, _c("st_run") == confirm, ~_c("st_up"), keys)


@strategy
def supertrend_asymmetric(bars, atr: int = 10, entry_k: float = 2.0, exit_k: float = 3.0, classic: bool = False, keys=KEYS):
    df = ind.with_true_range(bars, keys).withColumn("atr", ind.atr(atr, keys))
    df = _rec(df, keys, a=rec.supertrend(entry_k, "atr", classic, "st_in"), b=rec.supertrend(exit_k, "atr", classic, "st_out"))
    return _emit(df, atr, _flips("st_in_up", keys)[0], _flips("st_out_up", keys)[1], keys)


@strategy
def supertrend_cooldown(bars, atr: int = 10, k: float = 3.0, cooldown: int = 5, classic: bool = False, keys=KEYS):
    """As supertrend: the cooldown that the name promises has no effect in the system this follows."""
    return supertrend(bars, atr, k, classic, keys)


@strategy
def dmi_adx(bars, di: int = 14, adx: int = 14, threshold: float = 25.0, keys=KEYS):
    """``adx`` counts for the warm-up only."""
    df = _rec(bars, keys, dmi=rec.dmi(di))
    up, down = _c("plus_di") > _c("minus_di"), _c("plus_di") <= _c("minus_di")
    weak, strong = _c("adx") < threshold, _c("adx") > threshold
    return _emit(df, di + adx, up & strong, down | weak, keys, ((_c("minus_di") > _c("plus_di")) & strong, (_c("minus_di") <= _c("plus_di")) | weak))


@strategy
def aroon(bars, n: int = 25, keys=KEYS):
    up, down = ind.aroon(n, keys)
    df = ind.with_bar_number(bars, keys).withColumns({"aroon_up": up, "aroon_down": down}).drop("_bar")
    df = df.withColumn("_osc", _c("aroon_up") - _c("aroon_down"))
    over, under = _crosses("_osc", 0.0, keys, True), _crosses("_osc", 0.0, keys, False)
    return _emit(df, n, over, under, keys, (under, over)).drop("_osc")


@strategy
def bollinger_squeeze(bars, n: int = 20, k: float = 2.0, squeeze: float = 0.1, keys=KEYS):
    mid, up, low, width = ind.bollinger(n, k, keys)
    df = bars.withColumns({"bb_middle": mid, "bb_upper": up, "bb_lower": low, "bb_bandwidth": width}).withColumn("_tight", _c("bb_bandwidth") < squeeze)
    tight = _c("_tight") | F.coalesce(_was("_tight", keys), F.lit(False))
    return _emit(df, n, tight & (_c("close") > _c("bb_upper")), _c("close") < _c("bb_middle"), keys).drop("_tight")


@strategy
def high_52w(bars, n: int = 252, entry_pct: float = 0.95, exit_pct: float = 0.9, column: str = "close", keys=KEYS):
    df = bars.withColumn("proximity", ind.high_proximity(n, column, keys))
    return _emit(df, n, _c("proximity") >= entry_pct, _c("proximity") < exit_pct, keys)


@strategy
def high_52w_momentum(bars, n: int = 252, entry_pct: float = 0.95, exit_pct: float = 0.9, momentum: int = 20, least: float = 0.0, keys=KEYS):
    df = bars.withColumns({"proximity": ind.high_proximity(n, keys=keys), "roc": ind.roc(momentum, keys)})
    return _emit(df, max(n, momentum), (_c("proximity") >= entry_pct) & (_c("roc") >= least), _c("proximity") < exit_pct, keys)


@strategy
def high_52w_trailing(bars, n: int = 252, entry_pct: float = 0.95, trail: float = 0.1, keys=KEYS):
    """Leaves when close is ``trail`` under the highest close since proximity was last below the entry level."""
    df = bars.withColumn("proximity", ind.high_proximity(n, keys=keys)).withColumn("_far", F.coalesce(_c("proximity") < entry_pct, F.lit(True)))
    df = df.withColumn("_island", F.sum(_c("_far").cast("int")).over(so_far(keys)))
    df = df.withColumn("_top", F.max(F.when(~_c("_far"), _c("close"))).over(so_far((*keys, "_island"))))
    # within a far bar the last island's top still counts
    df = df.withColumn("_top", F.coalesce(_c("_top"), F.last("_top", ignorenulls=True).over(so_far(keys))))
    return _emit(df, n, _c("proximity") >= entry_pct, _c("close") < (1.0 - trail) * _c("_top"), keys).drop("_far", "_island", "_top")


@strategy
def darvas(bars, n: int = 3, keys=KEYS):
    df = _rec(bars, keys, box=rec.darvas(n))
    df = df.withColumns({"_t": F.when(_c("box_complete"), _c("box_top")), "_b": F.when(_c("box_complete"), _c("box_bottom"))})
    close = _c("close")
    over = (close > _c("_t")), (close > _was("_t", keys))
    under = (close < _c("_b")), (close < _was("_b", keys))
    either = lambda two: F.coalesce(two[0], F.lit(False)) | F.coalesce(two[1], F.lit(False))
    return _emit(df, 2 * n, either(over), either(under), keys).drop("_t", "_b")


@strategy
def larry_williams(bars, k: float = 0.5, stop: float = 2.0, atr: int = 14, keys=KEYS):
    up, _ = ind.breakout_levels(k, keys)
    df = ind.with_true_range(bars, keys).withColumns({"lw_upper": up, "_atr": ind.atr(atr, keys), "_top": F.max("high").over(series(keys).rowsBetween(-4, 0))})
    return _emit(df, atr, _c("close") > _c("lw_upper"), _c("close") < _c("_top") - stop * _c("_atr"), keys).drop("_atr", "_top")


@strategy
def heikin_ashi(bars, confirm: int = 3, keys=KEYS):
    df = _rec(bars, keys, ha=rec.heikin_ashi()).withColumns({"_bull": _c("ha_close") > _c("ha_open"), "_bear": _c("ha_close") < _c("ha_open")})
    df = _run_length(_run_length(df, "_bear", "_bears", keys), "_bull", "_bulls", keys)
    return _emit(df, confirm + 1, _c("_bull") & (_was("_bears", keys) >= confirm), _c("_bear"), keys, (_c("_bear") & (_was("_bulls", keys) >= confirm), _c("_bull"))).drop("_bull", "_bear", "_bears", "_bulls")


@strategy
def psar(bars, start: float = 0.02, step: float = 0.02, most: float = 0.2, keys=KEYS):
    df = _rec(bars, keys, sar=rec.parabolic_sar(start, step, most)).withColumn("_i", bar_number(keys))
    up, down = _flips("sar_up", keys)
    first = (_c("_i") == 5) & _c("sar_up")
    return _emit(df, 5, F.coalesce(up, F.lit(False)) | first, down, keys, (down, up)).drop("_i")


@strategy
def psar_filtered(bars, start: float = 0.02, step: float = 0.02, most: float = 0.2, trend: int = 50, keys=KEYS):
    df = _rec(bars, keys, sar=rec.parabolic_sar(start, step, most)).withColumn("trend_sma", ind.sma(trend, keys=keys))
    up, down = _flips("sar_up", keys)
    return _emit(df, trend, up & (_c("close") > _c("trend_sma")), down, keys)


@strategy
def psar_delayed(bars, start: float = 0.02, step: float = 0.02, most: float = 0.2, delay: int = 2, keys=KEYS):
    df = _rec(bars, keys, sar=rec.parabolic_sar(start, step, most))
    df = _run_length(df.withColumn("_flip", _flips("sar_up", keys)[0]), "sar_up", "_run", keys)
    return _emit(df, 5 + delay, _was("_flip", keys, delay) & (_c("_run") >= delay + 1), _flips("sar_up", keys)[1], keys).drop("_flip", "_run")


@strategy
def opening_range(bars, n: int = 5, period: str = "rolling", keys=KEYS):
    if period == "rolling":
        top, low = ind.opening_range(n, keys)
        df = bars.withColumns({"or_high": top, "or_low": low, "or_complete": top.isNotNull()})
    else:
        df = ind.calendar_range(bars, n, period, keys)
    close, done = _c("close"), _c("or_complete")
    return _emit(df, n, done & (close > _c("or_high")), done & (close < _c("or_low")), keys, (done & (close < _c("or_low")), done & (close > _c("or_high"))))


@strategy
def rsi(bars, n: int = 14, oversold: float = 30.0, overbought: float = 70.0, keys=KEYS):
    df = _rec(bars, keys, rsi=rec.rsi(n))
    return _emit(df, n + 1, _crosses("rsi", oversold, keys, True), _crosses("rsi", overbought, keys, False), keys)


@strategy
def macd(bars, fast: int = 12, slow: int = 26, signal: int = 9, mode: str = "signal", keys=KEYS):
    """``mode``: signal (line over its signal), zero (line over 0) or histogram (histogram over 0)."""
    df = _rec(bars, keys, macd=rec.macd(fast, slow, signal))
    column = {"signal": "macd_hist", "zero": "macd", "histogram": "macd_hist"}[mode]
    return _emit(df, slow + signal, _crosses(column, 0.0, keys, True), _crosses(column, 0.0, keys, False), keys)


@strategy
def stochastic(bars, k: int = 14, smooth: int = 3, d: int = 3, oversold: float = 20.0, overbought: float = 80.0, keys=KEYS):
    df = ind.stochastic(bars, k, smooth, d, keys).withColumn("_gap", _c("stoch_k") - _c("stoch_d"))
    low, high = (_c("stoch_k") < oversold) & (_c("stoch_d") < oversold), (_c("stoch_k") > overbought) & (_c("stoch_d") > overbought)
    return _emit(df, k + smooth + d, _crosses("_gap", 0.0, keys, True) & low, _crosses("_gap", 0.0, keys, False) & high, keys).drop("_gap")


@strategy
def williams_r(bars, n: int = 14, oversold: float = -80.0, overbought: float = -20.0, keys=KEYS):
    df = bars.withColumn("williams_r", ind.williams_r(n, keys))
    return _emit(df, n + 1, _crosses("williams_r", oversold, keys, True), _crosses("williams_r", overbought, keys, False), keys)


@strategy
def cci(bars, n: int = 20, entry: float = -100.0, exit: float = 100.0, keys=KEYS):
    df = ind.cci(bars, n, "cci", keys)
    return _emit(df, n + 1, _crosses("cci", entry, keys, True), _crosses("cci", exit, keys, False), keys)


@strategy
def roc(bars, n: int = 12, keys=KEYS):
    df = bars.withColumn("roc", ind.roc(n, keys))
    return _emit(df, n + 1, _crosses("roc", 0.0, keys, True), _crosses("roc", 0.0, keys, False), keys)


@strategy
def rsi_bollinger(bars, n: int = 14, oversold: float = 30.0, exit: float = 60.0, bands: int = 20, k: float = 2.0, keys=KEYS):
    mid, up, low, _ = ind.bollinger(bands, k, keys)
    df = _rec(bars.withColumns({"bb_middle": mid, "bb_upper": up, "bb_lower": low}), keys, rsi=rec.rsi(n))
    return _emit(df, max(n + 1, bands), (_c("rsi") < oversold) & (_c("close") <= _c("bb_lower")), (_c("close") > _c("bb_middle")) | (_c("rsi") > exit), keys)


@strategy
def macd_adx(bars, fast: int = 12, slow: int = 26, signal: int = 9, adx: int = 14, threshold: float = 25.0, keys=KEYS):
    df = _rec(bars, keys, macd=rec.macd(fast, slow, signal), dmi=rec.dmi(adx))
    return _emit(df, max(slow + signal, 2 * adx), _crosses("macd_hist", 0.0, keys, True) & (_c("adx") > threshold), _crosses("macd_hist", 0.0, keys, False), keys)


@strategy
def confluence(bars, n: int = 14, oversold: float = 30.0, overbought: float = 70.0, k: int = 14, smooth: int = 3, d: int = 3, keys=KEYS):
    df = _rec(ind.stochastic(bars, k, smooth, d, keys), keys, rsi=rec.rsi(n)).withColumn("_gap", _c("stoch_k") - _c("stoch_d"))
    leave = F.coalesce(_crosses("rsi", overbought, keys, False), F.lit(False)) | F.coalesce(_crosses("_gap", 0.0, keys, False), F.lit(False))
    return _emit(df, max(n + 1, k + smooth + d), _crosses("rsi", oversold, keys, True) & (_c("_gap") > 0), leave, keys).drop("_gap")


@strategy
def ichimoku(bars, tenkan: int = 9, kijun: int = 26, senkou: int = 52, keys=KEYS):
    df = ind.ichimoku(bars, tenkan, kijun, senkou, keys).withColumn("_gap", _c("tenkan") - _c("kijun"))
    leave = (_c("cloud") == "below") | F.coalesce(_crosses("_gap", 0.0, keys, False), F.lit(False))
    return _emit(df, senkou + kijun, (_c("cloud") == "above") & _crosses("_gap", 0.0, keys, True), leave, keys).drop("_gap")


# --- votes ---


def side_by_side(bars: DataFrame, children: list[tuple[str, dict]], keys=KEYS) -> DataFrame:
    """``bars`` with child_<i>_entry and child_<i>_exit of each strategy; nothing is joined."""
    df = bars
    for i, (name, params) in enumerate(children):
        held = [f"child_{j}_{side}" for j in range(i) for side in ("entry", "exit")]
        own = STRATEGIES[name](df, **params, keys=keys)
        df = own.select(*bars.columns, *held, F.col("raw_entry").alias(f"child_{i}_entry"), F.col("raw_exit").alias(f"child_{i}_exit"))
    return df


def combine(bars: DataFrame, children: list[tuple[str, dict]], vote: str = "majority", weights: list[int] | None = None, keys=KEYS) -> DataFrame:
    """Signals of several strategies on one position.  majority: over half; weighted: over half of the weights, as whole numbers;
    unanimous: any exit first, then all entries."""
    df, n = side_by_side(bars, children, keys), len(children)
    weights = [1] * n if vote != "weighted" else weights
    total = sum(weights)
    count = lambda side: reduce(lambda a, b: a + b, [F.col(f"child_{i}_{side}").cast("int") * w for i, w in enumerate(weights)])
    if vote == "unanimous":
        leave = count("exit") > 0
        entry = (count("entry") == n) & ~leave
    else:
        entry, leave = count("entry") > total // 2, count("exit") > total // 2
    return df.withColumns({"raw_entry": entry, "raw_exit": leave})


def multi_horizon(base: str, horizons: list[int]) -> list[tuple[str, dict]]:
    """Children of an ensemble of one kind of strategy at several horizons."""
    made = {"donchian": lambda h: {"entry": h, "exit": h // 2}, "ma_cross": lambda h: {"fast": max(h // 4, 1), "slow": h}, "tsmom": lambda h: {"lookback": h}}[base]
    return [(base, made(h)) for h in horizons]


@strategy
def ensemble(bars, base: str = "donchian", horizons: tuple[int, ...] = (20, 50, 100), vote: str = "majority", keys=KEYS):
    """One kind of strategy at several horizons, which are also the weights of a weighted vote."""
    return combine(bars, multi_horizon(base, list(horizons)), vote, list(horizons), keys)


#: Turtle presets.
TURTLE = {"s1": {"entry": 20, "exit": 10}, "s2": {"entry": 55, "exit": 20}}


@strategy
def turtle_s1(bars, keys=KEYS):
    return donchian(bars, **TURTLE["s1"], keys=keys)


@strategy
def turtle_s2(bars, keys=KEYS):
    return donchian(bars, **TURTLE["s2"], keys=keys)
