"""Parameter grids of the strategies, as tables of fixed values, and the constraints that configurations must meet."""

from __future__ import annotations

import itertools
from collections.abc import Callable

Values = dict[str, list]

# Parameters of each strategy at the depths quick, standard and comprehensive.
QUICK: dict[str, Values] = {
    "donchian": {"entry": [20, 55], "exit": [10, 20]},
    "turtle_s1": {},
    "turtle_s2": {},
    "ma_cross": {"fast": [20, 50], "slow": [50, 200], "kind": ["sma"]},
    "tsmom": {"lookback": [63, 252]},
    "keltner": {"ema": [20], "atr": [10], "k": [2.0]},
    "starc": {"sma": [20], "atr": [15], "k": [2.0]},
    "supertrend": {"atr": [10], "k": [3.0]},
    "supertrend_volume": {"atr": [10], "k": [3.0], "volume": [20], "pct": [1.2]},
    "supertrend_confirmed": {"atr": [10], "k": [3.0], "confirm": [2]},
    "supertrend_asymmetric": {"atr": [10], "entry_k": [2.5], "exit_k": [3.5]},
    "supertrend_cooldown": {"atr": [10], "k": [3.0], "cooldown": [10]},
    "dmi_adx": {"di": [14], "adx": [14], "threshold": [25.0]},
    "aroon": {"n": [25]},
    "bollinger_squeeze": {"n": [20], "k": [2.0], "squeeze": [0.04]},
    "high_52w": {"n": [252], "entry_pct": [0.95], "exit_pct": [0.90]},
    "high_52w_momentum": {"n": [252], "entry_pct": [0.95], "exit_pct": [0.90], "momentum": [10], "least": [0.0]},
    "high_52w_trailing": {"n": [252], "entry_pct": [0.95], "trail": [0.10]},
    "darvas": {"n": [3]},
    "larry_williams": {"k": [0.5], "stop": [2.0]},
    "heikin_ashi": {"confirm": [1]},
    "psar": {"start": [0.02], "step": [0.02], "most": [0.20]},
    "psar_filtered": {"start": [0.02], "step": [0.02], "most": [0.20], "trend": [50]},
    "psar_delayed": {"start": [0.02], "step": [0.02], "most": [0.20], "delay": [1]},
    "opening_range": {"n": [5], "period": ["week"]},
    "ensemble": {"base": ["donchian"], "horizons": [(20, 50, 100)], "vote": ["majority"]},
}
STANDARD: dict[str, Values] = {
    "donchian": {"entry": [10, 20, 30, 40, 55], "exit": [5, 10, 15, 20]},
    "turtle_s1": {},
    "turtle_s2": {},
    "ma_cross": {"fast": [10, 20, 50], "slow": [50, 100, 200], "kind": ["sma", "ema"]},
    "tsmom": {"lookback": [21, 63, 126, 252]},
    "keltner": {"ema": [10, 20, 30], "atr": [10, 14, 20], "k": [1.5, 2.0, 2.5]},
    "starc": {"sma": [15, 20, 25], "atr": [10, 15, 20], "k": [1.5, 2.0, 2.5]},
    "supertrend": {"atr": [7, 10, 14], "k": [2.0, 3.0, 4.0]},
    "supertrend_volume": {"atr": [10, 14], "k": [2.5, 3.0], "volume": [20], "pct": [1.2, 1.5]},
    "supertrend_confirmed": {"atr": [10, 14], "k": [2.5, 3.0], "confirm": [2, 3]},
    "supertrend_asymmetric": {"atr": [10, 14], "entry_k": [2.0, 2.5], "exit_k": [3.0, 3.5]},
    "supertrend_cooldown": {"atr": [10, 14], "k": [2.5, 3.0], "cooldown": [5, 10, 20]},
    "dmi_adx": {"di": [10, 14, 20, 25], "adx": [10, 14, 20], "threshold": [20.0, 25.0, 30.0]},
    "aroon": {"n": [14, 20, 25, 30, 50]},
    "bollinger_squeeze": {"n": [15, 20, 25], "k": [1.5, 2.0, 2.5], "squeeze": [0.03, 0.04, 0.05]},
    "high_52w": {"n": [126, 189, 252], "entry_pct": [0.95, 0.98, 1.0], "exit_pct": [0.85, 0.90]},
    "high_52w_momentum": {"n": [189, 252], "entry_pct": [0.95, 0.98], "exit_pct": [0.85, 0.90], "momentum": [10, 20], "least": [0.0, 0.02]},
    "high_52w_trailing": {"n": [189, 252], "entry_pct": [0.95, 0.98], "trail": [0.05, 0.10, 0.15]},
    "darvas": {"n": [2, 3, 4]},
    "larry_williams": {"k": [0.3, 0.5, 0.7], "stop": [1.5, 2.0, 2.5]},
    "heikin_ashi": {"confirm": [1, 2, 3]},
    "psar": {"start": [0.01, 0.02, 0.03], "step": [0.02], "most": [0.15, 0.20, 0.25]},
    "psar_filtered": {"start": [0.02, 0.03], "step": [0.02], "most": [0.20], "trend": [50, 200]},
    "psar_delayed": {"start": [0.02, 0.03], "step": [0.02], "most": [0.20], "delay": [1, 2, 3]},
    "opening_range": {"n": [3, 5, 10], "period": ["week", "rolling"]},
    "ensemble": {"base": ["donchian", "ma_cross"], "horizons": [(20, 50, 100), (10, 21, 63)], "vote": ["majority", "weighted"]},
}
COMPREHENSIVE: dict[str, Values] = {
    "donchian": {"entry": [10, 15, 20, 30, 40, 55, 80, 100], "exit": [5, 10, 15, 20, 25, 40]},
    "turtle_s1": {},
    "turtle_s2": {},
    "ma_cross": {"fast": [5, 9, 10, 20, 50], "slow": [20, 21, 50, 100, 200], "kind": ["sma", "ema"]},
    "tsmom": {"lookback": [21, 42, 63, 126, 189, 252]},
    "keltner": {"ema": [10, 15, 20, 30, 50], "atr": [7, 10, 14, 20], "k": [1.0, 1.5, 2.0, 2.5, 3.0]},
    "starc": {"sma": [10, 15, 20, 25, 30], "atr": [7, 10, 15, 20], "k": [1.0, 1.5, 2.0, 2.5, 3.0]},
    "supertrend": {"atr": [5, 7, 10, 14, 20], "k": [1.5, 2.0, 2.5, 3.0, 4.0]},
    "supertrend_volume": {"atr": [7, 10, 14], "k": [2.0, 2.5, 3.0], "volume": [10, 20], "pct": [1.0, 1.2, 1.5]},
    "supertrend_confirmed": {"atr": [7, 10, 14], "k": [2.0, 2.5, 3.0], "confirm": [2, 3, 5]},
    "supertrend_asymmetric": {"atr": [7, 10, 14], "entry_k": [2.0, 2.5, 3.0], "exit_k": [3.0, 3.5, 4.0]},
    "supertrend_cooldown": {"atr": [7, 10, 14], "k": [2.0, 2.5, 3.0], "cooldown": [5, 10, 15, 20]},
    "dmi_adx": {"di": [7, 10, 14, 20, 25, 30], "adx": [7, 10, 14, 20, 25], "threshold": [15.0, 20.0, 25.0, 30.0, 35.0]},
    "aroon": {"n": [10, 14, 20, 25, 30, 40, 50, 70]},
    "bollinger_squeeze": {"n": [10, 15, 20, 25, 30], "k": [1.5, 2.0, 2.5, 3.0], "squeeze": [0.02, 0.03, 0.04, 0.05, 0.06]},
    "high_52w": {"n": [63, 126, 189, 252], "entry_pct": [0.90, 0.95, 0.98, 1.0], "exit_pct": [0.80, 0.85, 0.90]},
    "high_52w_momentum": {"n": [126, 189, 252], "entry_pct": [0.95, 0.98, 1.0], "exit_pct": [0.80, 0.85, 0.90], "momentum": [10, 20], "least": [0.0, 0.02, 0.05]},
    "high_52w_trailing": {"n": [126, 189, 252], "entry_pct": [0.95, 0.98, 1.0], "trail": [0.05, 0.08, 0.10, 0.15]},
    "darvas": {"n": [2, 3, 4, 5]},
    "larry_williams": {"k": [0.2, 0.3, 0.5, 0.7, 1.0], "stop": [1.0, 1.5, 2.0, 2.5, 3.0]},
    "heikin_ashi": {"confirm": [1, 2, 3, 4]},
    "psar": {"start": [0.01, 0.015, 0.02, 0.025, 0.03], "step": [0.01, 0.02, 0.03], "most": [0.10, 0.15, 0.20, 0.25, 0.30]},
    "psar_filtered": {"start": [0.01, 0.02, 0.03], "step": [0.02], "most": [0.15, 0.20, 0.25], "trend": [50, 100, 200]},
    "psar_delayed": {"start": [0.01, 0.02, 0.03], "step": [0.02], "most": [0.15, 0.20, 0.25], "delay": [1, 2, 3, 5]},
    "opening_range": {"n": [3, 5, 7, 10], "period": ["week", "month", "rolling"]},
    "ensemble": {"base": ["donchian", "ma_cross", "tsmom"], "horizons": [(20, 50, 100), (10, 21, 63), (21, 63, 252)], "vote": ["majority", "weighted", "unanimous"]},
}
# What a sweep over all strategies takes by default.
DEFAULT: dict[str, Values] = {k: STANDARD[k] for k in ("donchian", "turtle_s1", "turtle_s2", "ma_cross", "tsmom", "dmi_adx", "aroon", "bollinger_squeeze", "psar")} | {
    "opening_range": {"n": [3, 5, 10], "period": ["week", "month", "rolling"]},
    "ensemble": STANDARD["ensemble"],
}

# parameters left at their defaults are in order
_below = lambda a, b: lambda c: not {a, b} <= c.keys() or c[a] < c[b]
_reached = lambda c: not {"start", "most"} <= c.keys() or c["most"] >= c["start"]
#: Constraints that configurations must meet, by strategy.
VALID: dict[str, Callable[[dict], bool]] = {
    "donchian": _below("exit", "entry"),
    "ma_cross": _below("fast", "slow"),
    "macd": _below("fast", "slow"),
    "high_52w": _below("exit_pct", "entry_pct"),
    "high_52w_momentum": _below("exit_pct", "entry_pct"),
    "psar": _reached,
    "psar_filtered": _reached,
    "psar_delayed": _reached,
}


def grid(**ranges) -> list[dict]:
    """All combinations of the named values."""
    return [dict(zip(ranges, c, strict=True)) for c in itertools.product(*ranges.values())]


def valid(strategy: str, configs: list[dict]) -> list[dict]:
    return [c for c in configs if VALID.get(strategy, lambda c: True)(c)]


def configurations(values: dict[str, Values]) -> dict[str, list[dict]]:
    """The valid configurations of each strategy of a table of values."""
    return {s: valid(s, grid(**v)) for s, v in values.items()}


#: Grids by depth.
DEPTHS = {"quick": configurations(QUICK), "standard": configurations(STANDARD), "comprehensive": configurations(COMPREHENSIVE)}
