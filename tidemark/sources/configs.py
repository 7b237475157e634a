"""Configurations of sweeps: symbols, dates, costs and grids from one document."""

from __future__ import annotations

from dataclasses import dataclass, field

from tidemark.operators.backtest import Costs
from tidemark.operators.grids import STANDARD, grid, valid

# Names of the lists of parameters in documents, by strategy, in the order of this engine's parameters.
LISTS: dict[str, tuple[str, dict[str, str]]] = {
    "donchian": ("donchian", {"entry_lookbacks": "entry", "exit_lookbacks": "exit"}),
    "ma_crossover": ("ma_cross", {"fast_periods": "fast", "slow_periods": "slow", "ma_types": "kind"}),
    "tsmom": ("tsmom", {"lookbacks": "lookback"}),
    "supertrend": ("supertrend", {"atr_periods": "atr", "multipliers": "k"}),
    "keltner": ("keltner", {"ema_periods": "ema", "atr_periods": "atr", "multipliers": "k"}),
    "starc": ("starc", {"sma_periods": "sma", "atr_periods": "atr", "multipliers": "k"}),
    "bollinger_squeeze": ("bollinger_squeeze", {"periods": "n", "std_mults": "k", "squeeze_thresholds": "squeeze"}),
    "aroon": ("aroon", {"periods": "n"}),
    "dmi_adx": ("dmi_adx", {"di_periods": "di", "adx_periods": "adx", "adx_thresholds": "threshold"}),
    "fifty_two_week_high": ("high_52w", {"periods": "n", "entry_pcts": "entry_pct", "exit_pcts": "exit_pct"}),
    "parabolic_sar": ("psar", {"af_starts": "start", "af_steps": "step", "af_maxs": "most"}),
    "heikin_ashi": ("heikin_ashi", {"confirmation_bars": "confirm"}),
    "darvas_box": ("darvas", {"box_confirmation_bars": "n"}),
    "larry_williams": ("larry_williams", {"range_multipliers": "k", "atr_stop_mults": "stop"}),
}


@dataclass
class SweepConfig:
    symbols: list[str] = field(default_factory=list)
    timeframe: str = "1d"
    start: str | None = None
    end: str | None = None
    costs: Costs = Costs(qty=100.0, fee_bps=10.0)
    grids: dict[str, list[dict]] = field(default_factory=dict)
    output: str = "parquet"

    @property
    def total(self) -> int:
        return sum(map(len, self.grids.values()))


def sweep_config(document: dict) -> SweepConfig:
    """From a parsed document (YAML or JSON) with ``data``, ``symbols``, ``backtest``, ``strategies`` and ``output``; unknown and disabled strategies are
    left out, and lists that aren't given are those of the standard depth."""
    data, test, symbols = document.get("data") or {}, document.get("backtest") or {}, document.get("symbols") or []
    grids = {}
    for name, given in (document.get("strategies") or {}).items():
        given = given or {}
        if name not in LISTS or not given.get("enabled", True):
            continue
        strategy, lists = LISTS[name]
        values = {p: [str(v).lower() if p == "kind" else v for v in given[k]] if k in given else STANDARD[strategy][p] for k, p in lists.items()}
        grids[strategy] = valid(strategy, grid(**values))
    day = lambda k: str(data[k]) if data.get(k) else None
    costs = Costs(cash=float(test.get("initial_cash", 100_000.0)), qty=float(test.get("qty_per_trade", 100.0)), fee_bps=float(test.get("fees_bps", 10.0)), slip_bps=float(test.get("slippage_bps", 0.0)))
    return SweepConfig(list(symbols if isinstance(symbols, list) else symbols.get("list", [])), data.get("timeframe", "1d"), day("start_date"), day("end_date"), costs, grids, (document.get("output") or {}).get("format", "parquet"))
