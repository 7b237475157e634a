"""Outputs in the shape of queries: signal scans, candles, curves, artifacts, mini-grammars."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.signals import side_by_side
from tidemark.schema import KEYS, before, series, so_far


def history(signals: DataFrame, keys=KEYS) -> DataFrame:
    """position that follows signals at once: any entry opens, any exit closes, and transition where it changes."""
    last = F.last(F.when(F.coalesce("raw_entry", F.lit(False)), F.lit(1)).when(F.coalesce("raw_exit", F.lit(False)), F.lit(0)), ignorenulls=True)
    out = signals.withColumn("position", F.coalesce(last.over(so_far(keys)), F.lit(0)))
    return out.withColumn("transition", F.col("position") - F.coalesce(last.over(before(keys)), F.lit(0)))


def latest(signals: DataFrame, fresh: int = 5, keys=KEYS) -> DataFrame:
    """Per series: signal (entry or exit if the last change is under ``fresh`` bars old, else hold), position, bars since, last close."""
    h = history(signals, keys).withColumn("_i", F.row_number().over(series(keys)))
    out = h.groupBy(*keys).agg(F.max("_i").alias("_n"), F.max(F.when(F.col("transition") != 0, F.col("_i"))).alias("_at"), F.max_by("position", "_i").alias("position"), F.max_by("close", "_i").alias("close"), F.max("ts").alias("ts"))
    ago = F.col("_n") - F.col("_at")
    limit = fresh or 9999
    signal = F.when(ago < limit, F.when(F.col("position") == 1, "entry").otherwise("exit")).otherwise("hold")
    return out.select(*keys, "ts", "close", "position", ago.alias("bars_since"), signal.alias("signal"))


def scan(bars: DataFrame, strategies: list[tuple[str, dict]], fresh: int = 5, least: int = 1, actionable_only: bool = False, slow: tuple[str, ...] = ("supertrend", "high_52w")) -> DataFrame:
    """Latest signals of strategies on all symbols.  Entries and exits stay if at least ``least`` strategies agree on the symbol, one of
    them slow; holds follow unless only what asks for action is wanted."""
    each = [F.struct(F.lit(name).alias("strategy"), F.col(f"child_{i}_entry").alias("raw_entry"), F.col(f"child_{i}_exit").alias("raw_exit")) for i, (name, _) in enumerate(strategies)]
    rows = side_by_side(bars, strategies).select("symbol", "ts", "close", F.explode(F.array(*each)).alias("s")).select("symbol", "ts", "close", "s.*")
    out = latest(rows, fresh, ("symbol", "strategy"))
    w = Window.partitionBy("symbol", "signal")
    out = out.withColumns({"confirmations": F.count("*").over(w), "_slow": F.max(F.col("strategy").isin(*slow).cast("int")).over(w)})
    keep = (F.col("signal") != "hold") & (F.col("confirmations") >= least) & (F.col("_slow") == 1)
    keep = keep if actionable_only else keep | (F.col("signal") == "hold")
    return out.where(keep).drop("_slow").orderBy("symbol", F.col("signal") == "hold", "strategy")


def candles(bars: DataFrame, symbol: str) -> DataFrame:
    return bars.where(F.col("symbol") == symbol).select("ts", "open", "high", "low", "close", "volume").orderBy("ts")


def artifact(signals: DataFrame, name: str, params: dict, columns: list[str], keys=KEYS) -> DataFrame:
    """One JSON document per bar with the indicators, signal and position, for parity tests elsewhere."""
    h = history(signals, keys)
    signal = F.when(F.col("raw_entry"), "entry").when(F.col("raw_exit"), "exit").otherwise("hold")
    doc = F.struct(F.lit(name).alias("strategy"), F.create_map(*[F.lit(x) for k, v in params.items() for x in (k, str(v))]).alias("params"), "ts", "open", "high", "low", "close", F.struct(*columns).alias("indicators"), signal.alias("signal"), F.col("position"))
    return h.select(*keys, "ts", F.to_json(doc).alias("artifact"))


def parse_strategy(text: str) -> tuple[str, list[float]]:
    """``name:p1,p2`` to the name and its numbers; what isn't a number is left out."""
    name, _, rest = text.partition(":")
    return name.strip().lower(), [float(x) for x in rest.split(",") if re.fullmatch(r"\s*-?\d+(\.\d+)?\s*", x)]


# The strategies that the grammar knows, by each of their names, and the defaults of their parameters in order.
GRAMMAR: dict[str, tuple[tuple[str, ...], dict]] = {
    "donchian": (("donchian",), {"entry": 55, "exit": 20}),
    "high_52w": (("52wk_high", "52wkhigh", "fiftytwoweek"), {"n": 252, "entry_pct": 0.95, "exit_pct": 0.90}),
    "supertrend": (("supertrend",), {"atr": 10, "k": 3.0}),
    "psar": (("psar", "parabolic_sar"), {"start": 0.02, "step": 0.02, "most": 0.2}),
    "ma_cross": (("ma_cross", "macross", "ma_crossover"), {"fast": 50, "slow": 200, "kind": "sma"}),
    "tsmom": (("tsmom",), {"lookback": 252}),
    "aroon": (("aroon",), {"n": 25}),
    "larry_williams": (("larry", "larry_williams", "larrywilliams"), {"k": 2.0, "stop": 1.5, "atr": 14}),
    "keltner": (("keltner",), {"ema": 20, "atr": 10, "k": 2.0}),
    "heikin_ashi": (("heikin_ashi", "heikinashi"), {"confirm": 3}),
    "dmi_adx": (("dmi", "dmi_adx"), {"di": 14, "adx": 14, "threshold": 25.0}),
}


def strategy_of(text: str) -> tuple[str, dict]:
    """``name:p1,p2`` to a strategy and its parameters; what is missing or can't be read takes its default, an unknown name raises."""
    name, _, rest = text.partition(":")
    found = next((s for s, (names, _) in GRAMMAR.items() if name.strip().lower() in names), None)
    if found is None:
        raise ValueError(f"unknown strategy {name}")
    params = dict(GRAMMAR[found][1])
    for (key, default), given in zip(params.items(), [x.strip() for x in rest.split(",")] if rest else [], strict=False):
        if isinstance(default, str):
            params[key] = "ema" if given.lower() == "ema" else default
        elif re.fullmatch(r"-?\d+" if isinstance(default, int) else r"-?\d+(\.\d+)?", given):
            params[key] = type(default)(given)
    return found, params


def parse_grid(text: str) -> dict[str, list[int]]:
    """``entry:5..300:1;exit:1,2`` to lists of values."""
    out = {}
    for part in filter(None, text.split(";")):
        name, _, values = part.partition(":")
        if m := re.fullmatch(r"(\d+)\.\.(\d+)(?::(\d+))?", values.strip()):
            step = int(m[3] or 1)
            if step < 1:
                raise ValueError(f"step of {name}")
            out[name.strip()] = list(range(int(m[1]), int(m[2]) + 1, step))
        else:
            out[name.strip()] = [int(v) for v in values.split(",")]
    return out


def markdown(results: DataFrame, n: int = 10) -> str:
    """The ``n`` best by Sharpe and by CAGR as Markdown tables."""
    out = []
    for metric in ("sharpe", "cagr"):
        rows = results.orderBy(F.desc(metric), "config_id").limit(n).select("symbol", "config_id", "sharpe", "cagr", "max_drawdown", "num_trades").collect()
        out += [f"## Best by {metric}", "| symbol | config | sharpe | cagr | drawdown | trades |", "|-|-|-|-|-|-|"]
        out += [f"| {r[0]} | {r[1]} | {r[2]:.3f} | {r[3]:.3f} | {r[4]:.3f} | {r[5]} |" for r in rows]
    return "\n".join(out)


def export_csv(results: DataFrame, path: str, digits: int = 6) -> None:
    shown = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in results.dtypes if not t.startswith(("map", "array", "struct"))]
    results.select(*shown).write.mode("overwrite").csv(path, header=True)
