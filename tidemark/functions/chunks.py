"""One series over many tasks: values along a series by a scan over chunks of time.

``chunked`` cuts each series into stretches of time of about so many bars and deals bars by series and stretch, so a single symbol with all rows
uses all cores.  A value that depends on all bars before is then made in three steps: a summary of each chunk, which doesn't know what came before; a
scan over the small table of chunks, which gives each its start; and the values within each chunk from that start.

``previous`` does so for the bar before, in window functions; ``smoothed`` for exponential means.  Past its seed a mean moves by an affine map,
y -> a y + b, and the maps of a chunk compose to one; the seed's simple mean may begin in one chunk and end in another.  EMA, Wilder's smoothing, RSI, MACD,
DMI and Heikin-Ashi are made of these, equal to the steppers of ``recurrence`` but for the order of additions.  Each step reads its input twice, from
one exchange.

Timestamps of a series differ; bars without a key or a timestamp take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import KEYS

#: Bars of the densest series in a chunk.
ROWS = 65_536
#: Bars that one product of matrices carries on.
STRETCH = 128


def _seconds(df: DataFrame) -> Column:
    """Seconds since 1970, rising with ts in every time zone."""
    if dict(df.dtypes)["ts"] == "timestamp":
        return F.unix_seconds("ts")
    return F.unix_date(F.to_date("ts")).cast("long") * 86_400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")


def chunk_seconds(df: DataFrame, keys=KEYS, rows: int = ROWS) -> int:
    """The width of chunks in which the densest series has about ``rows`` bars: one pass over the keys and timestamps."""
    each = df.select(*keys, _seconds(df).alias("_at")).groupBy(*keys).agg(F.count("*").alias("n"), (F.max("_at") - F.min("_at") + 1).alias("span"))
    width = each.agg(F.min(F.col("span") * rows / F.col("n"))).first()[0]
    return max(1, int(width or 1))


def chunked(df: DataFrame, keys=KEYS, rows: int = ROWS, seconds: int | None = None) -> DataFrame:
    """``df`` with _chunk, dealt by series and chunk: what follows over both keys moves nothing more."""
    width = seconds or chunk_seconds(df, keys, rows)
    known = df.where(" and ".join(f"`{k}` is not null" for k in (*keys, "ts")))
    return known.withColumn("_chunk", F.floor(_seconds(df) / F.lit(width))).repartition(*keys, "_chunk")


def _inside(keys) -> Window:
    return Window.partitionBy(*keys, "_chunk").orderBy("ts")


def previous(df: DataFrame, columns: list[str], name: str = "previous", keys=KEYS) -> DataFrame:
    """chunked() bars with a struct of ``columns`` of the bar before; null at a series' first bar."""
    value = F.struct(*columns)
    ends = df.groupBy(*keys, "_chunk").agg(F.max_by(value, "ts").alias("_end"))
    start = ends.select(*keys, "_chunk", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_start"))
    both = df.withColumn("_lag", F.lag(value).over(_inside(keys))).join(start, [*keys, "_chunk"])
    return both.select(*df.columns, F.coalesce("_lag", "_start").alias(name))


# --- exponential means ---


@dataclass(frozen=True)
class Smoothing:
    """An exponential mean of ``column`` with ``factor``, seeded by the simple mean of its first ``n`` values."""

    name: str
    column: str
    n: int
    factor: float


def carried(x: np.ndarray, factor: float, start: float) -> np.ndarray:
    """y[i] = factor x[i] + (1 - factor) y[i-1], from y[-1] = start: products of STRETCH values at a time."""
    if not len(x):
        return np.zeros(0)
    size, keep = min(STRETCH, len(x)), 1.0 - factor
    age = np.arange(size)[:, None] - np.arange(size)[None, :]
    weights = np.where(age >= 0, factor * keep ** np.maximum(age, 0), 0.0)
    padded = np.zeros(-(-len(x) // size) * size)
    padded[: len(x)] = x
    out = padded.reshape(-1, size) @ weights.T
    powers = keep ** np.arange(1, size + 1)
    for row in out:
        row += powers * start
        start = row[-1]
    return out.ravel()[: len(x)]


def _parts(x: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The values that aren't null, and their places."""
    values = x.to_numpy(np.float64, na_value=np.nan)
    at = np.flatnonzero(~np.isnan(values))
    return values[at], at


def _summary(s: Smoothing, x: pd.Series) -> tuple[int, float, list[float]]:
    """The number of values, the mean they'd give from 0, and the first values, which may belong to the seed."""
    values, _ = _parts(x)
    return len(values), float(carried(values, s.factor, 0.0)[-1]) if len(values) else 0.0, values[: s.n].tolist()


def _starts(s: Smoothing, chunks: list[tuple[int, float, list[float]]]) -> list[tuple[int, float, float]]:
    """Of each chunk of a series in order: the number of values before it, the sum of those for the seed, and the mean, NaN before the seed."""
    before, seed, y, keep, out = 0, 0.0, np.nan, 1.0 - s.factor, []
    for count, alone, first in chunks:
        out.append((before, seed, y))
        missing = s.n - before
        if missing <= 0:
            y = keep**count * y + alone
        elif count < missing:
            seed += sum(first)
        else:
            rest = keep ** (count - missing)
            y = rest * (seed + sum(first[:missing])) / s.n + alone - rest * float(carried(np.array(first[:missing]), s.factor, 0.0)[-1])
        before += count
    return out


def _values(s: Smoothing, x: pd.Series, before: int, seed: float, start: float) -> np.ndarray:
    """The mean at each bar, from a start of _starts()."""
    values, at = _parts(x)
    out, first, missing = np.full(len(x), np.nan), start, max(0, s.n - int(before))
    if 0 < missing <= len(values):
        first = (seed + values[:missing].sum()) / s.n
        out[at[missing - 1]] = first
    if missing <= len(values):
        out[at[missing:]] = carried(values[missing:], s.factor, first)
    return pd.Series(out).ffill().fillna(start).to_numpy()


def smoothed(df: DataFrame, means: list[Smoothing], keys=KEYS) -> DataFrame:
    """chunked() bars with a column for each of ``means``; null before its seed, and as before where its column is null."""
    by, kinds = [*keys, "_chunk"], dict(df.dtypes)
    numbers, names = range(len(means)), [m.name for m in means]
    columns = list(dict.fromkeys(m.column for m in means))
    kept = [c for c in df.columns if c not in names]
    lent = [c for c in columns if c not in kept]

    def summary(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("ts")
        return pd.DataFrame([[*b[by].iloc[0], *[v for m in means for v in _summary(m, b[m.column])]]], columns=[*by, *[f"_{p}{i}" for i in numbers for p in "nbf"]])

    def scan(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("_chunk")
        out = b[by].copy()
        for i, m in enumerate(means):
            out[f"_n{i}"], out[f"_d{i}"], out[f"_y{i}"] = zip(*_starts(m, list(zip(b[f"_n{i}"], b[f"_b{i}"], b[f"_f{i}"], strict=True))), strict=True)
        return out

    def values(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("ts")
        return b[kept].assign(**{m.name: _values(m, b[m.column], *(b[f"_{p}{i}"].iloc[0] for p in "ndy")) for i, m in enumerate(means)})

    keyed = ", ".join(f"`{k}` {kinds[k]}" for k in by)
    slim = df.select(*by, "ts", *[F.col(c).cast("double").alias(c) for c in columns])
    known = slim.groupBy(*by).applyInPandas(summary, keyed + "".join(f", _n{i} long, _b{i} double, _f{i} array<double>" for i in numbers))
    starts = known.groupBy(*keys).applyInPandas(scan, keyed + "".join(f", _n{i} long, _d{i} double, _y{i} double" for i in numbers))
    both = df.join(starts, by).select(*kept, *lent, *[f"_{p}{i}" for i in numbers for p in "ndy"])
    return both.groupBy(*by).applyInPandas(values, ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{n}` double" for n in names]))


def ema(df: DataFrame, n: int, name: str = "ema", column: str = "close", keys=KEYS) -> DataFrame:
    return smoothed(df, [Smoothing(name, column, n, 2.0 / (n + 1))], keys)


def wilder(df: DataFrame, n: int, column: str, name: str, keys=KEYS) -> DataFrame:
    return smoothed(df, [Smoothing(name, column, n, 1.0 / n)], keys)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, prefix: str = "macd", keys=KEYS) -> DataFrame:
    """line, signal and histogram; null until all exist."""
    out = smoothed(df, [Smoothing("_f", "close", fast, 2.0 / (fast + 1)), Smoothing("_s", "close", slow, 2.0 / (slow + 1))], keys)
    out = out.withColumn("_line", F.col("_f") - F.col("_s")).drop("_f", "_s")
    out = smoothed(out, [Smoothing("_signal", "_line", signal, 2.0 / (signal + 1))], keys)
    there = F.col("_signal").isNotNull()
    return out.withColumns({prefix: F.when(there, F.col("_line")), f"{prefix}_signal": F.col("_signal"), f"{prefix}_hist": F.col("_line") - F.col("_signal")}).drop("_line", "_signal")


def rsi(df: DataFrame, n: int = 14, name: str = "rsi", keys=KEYS) -> DataFrame:
    """Relative strength over changes; 100 without losses."""
    change = F.col("close") - F.col("_p.close")
    out = previous(df, ["close"], "_p", keys).withColumns({"_u": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "_d": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))}).drop("_p")
    out = smoothed(out, [Smoothing("_up", "_u", n, 1.0 / n), Smoothing("_down", "_d", n, 1.0 / n)], keys)
    value = F.when(F.col("_down") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col("_up") / F.col("_down")))
    return out.withColumn(name, F.when(F.col("_up").isNotNull(), value)).drop("_u", "_d", "_up", "_down")


def dmi(df: DataFrame, n: int = 14, keys=KEYS) -> DataFrame:
    """plus_di, minus_di, adx."""
    up, down = F.col("high") - F.col("_p.high"), F.col("_p.low") - F.col("low")
    span = F.col("high") - F.col("low")
    moves = {
        "_u": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_d": F.when((down > up) & (down > 0), down).otherwise(0.0),
        "_r": F.greatest(span, F.abs(F.col("high") - F.col("_p.close")), F.abs(F.col("low") - F.col("_p.close"))),
    }
    out = previous(df, ["high", "low", "close"], "_p", keys).withColumns(moves).drop("_p")
    out = smoothed(out, [Smoothing(f"_s{c}", c, n, 1.0 / n) for c in moves], keys)
    share = lambda c: F.when(F.col("_s_r") == 0, 0.0).otherwise(100.0 * F.col(c) / F.col("_s_r"))
    out = out.withColumns({"plus_di": share("_s_u"), "minus_di": share("_s_d")}).drop(*moves, *[f"_s{c}" for c in moves])
    total = F.col("plus_di") + F.col("minus_di")
    out = out.withColumn("_dx", F.when(total == 0, 0.0).otherwise(100.0 * F.abs(F.col("plus_di") - F.col("minus_di")) / total))
    return smoothed(out, [Smoothing("adx", "_dx", n, 1.0 / n)], keys).drop("_dx")


def heikin_ashi(df: DataFrame, keys=KEYS) -> DataFrame:
    """ha_open, ha_high, ha_low, ha_close: the open is a mean with factor 1/2 of the closes before, from the middle of the first body."""
    out = df.withColumn("ha_close", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4.0)
    out = previous(out, ["ha_close"], "_p", keys).withColumn("_x", F.coalesce("_p.ha_close", (F.col("open") + F.col("close")) / 2.0)).drop("_p")
    out = smoothed(out, [Smoothing("ha_open", "_x", 1, 0.5)], keys).drop("_x")
    return out.withColumns({"ha_high": F.greatest("high", "ha_open", "ha_close"), "ha_low": F.least("low", "ha_open", "ha_close")})
