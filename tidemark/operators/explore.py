"""Exploration of parameter spaces: bounds, samples, cells, coverage, schedules, and the index of tested configurations.

Samples are tables of configurations, small by design, made on the driver from a seed; visits, coverage and the index of tests are tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (parameter, least, most, step) by strategy.
BOUNDS: dict[str, list[tuple[str, float, float, float]]] = {
    "donchian": [("entry", 5, 500, 5), ("exit", 2, 200, 5)],
    "ma_cross": [("fast", 3, 200, 1), ("slow", 10, 1000, 5)],
    "tsmom": [("lookback", 5, 750, 5)],
    "supertrend": [("atr", 3, 100, 1), ("k", 0.5, 10, 0.1)],
    "high_52w": [("n", 20, 1000, 5), ("entry_pct", 0.5, 1, 0.01), ("exit_pct", 0.3, 0.99, 0.01)],
    "psar": [("start", 0.005, 0.2, 0.005), ("step", 0.005, 0.2, 0.005), ("most", 0.1, 1, 0.01)],
    "larry_williams": [("k", 0.3, 8, 0.1), ("stop", 0.3, 8, 0.1)],
    "starc": [("sma", 3, 200, 1), ("atr", 3, 100, 1), ("k", 0.3, 8, 0.1)],
    "keltner": [("ema", 3, 200, 1), ("atr", 3, 100, 1), ("k", 0.3, 8, 0.1)],
    "dmi_adx": [("di", 3, 100, 1), ("adx", 3, 100, 1), ("threshold", 5, 70, 1)],
    "aroon": [("n", 3, 200, 1)],
    "bollinger_squeeze": [("n", 3, 200, 1), ("k", 0.5, 6, 0.1), ("squeeze", 0.005, 0.8, 0.01)],
    "darvas": [("n", 1, 30, 1)],
    "heikin_ashi": [("confirm", 1, 20, 1)],
    "high_52w_momentum": [("n", 10, 300, 5), ("entry_pct", 0.8, 1, 0.01), ("exit_pct", 0.5, 0.95, 0.01)],
    "psar_filtered": [("start", 0.005, 0.1, 0.005), ("step", 0.005, 0.1, 0.005), ("most", 0.1, 0.5, 0.01)],
}
for _variant, _base in (("supertrend_volume", "supertrend"), ("supertrend_confirmed", "supertrend"), ("supertrend_cooldown", "supertrend"), ("psar_delayed", "psar_filtered")):
    BOUNDS[_variant] = BOUNDS[_base]
CELL = 0.02


def normal(value: Column | float, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((value if isinstance(value, Column) else F.lit(value)) - lo) / (hi - lo)))


def latin_hypercube(strategy: str, n: int, seed: int = 42, whole: bool = True) -> list[dict[str, float]]:
    """``n`` configurations with one sample in each of n strata of every dimension, on the steps, within the bounds."""
    rng = np.random.default_rng(seed)
    columns = []
    for _, lo, hi, step in BOUNDS[strategy]:
        x = lo + (rng.permutation(n) + rng.random(n)) / n * (hi - lo)
        x = np.clip(lo + np.round((x - lo) / step) * step, lo, hi)
        columns.append(x)
    names = [(p, step) for p, _, _, step in BOUNDS[strategy]]
    made = [{p: float(c[i]) for (p, _), c in zip(names, columns, strict=True)} for i in range(n)]
    return [{p: int(round(v)) if whole and dict(names)[p] >= 1 else v for p, v in c.items()} for c in made]


def sample_table(spark: SparkSession, strategy: str, n: int, seed: int = 42) -> DataFrame:
    rows = [(strategy, i, {k: float(v) for k, v in c.items()}) for i, c in enumerate(latin_hypercube(strategy, n, seed))]
    return spark.createDataFrame(rows, "strategy_type string, sample int, params map<string,double>")


def cell_of(strategy: str, params: str = "params", size: float = CELL) -> Column:
    """Mixed-radix number of the cell of a configuration in the unit cube; the first parameter is the least digit."""
    per, out = math.ceil(1 / size), F.lit(0).cast("long")
    for name, lo, hi, _ in reversed(BOUNDS[strategy]):
        at = F.least(F.floor(normal(F.col(params)[name], lo, hi) / size), F.lit(per - 1))
        out = out * per + at
    return out


def visits(tested: DataFrame, strategy: str) -> DataFrame:
    """(cell, visits) of a table of tested configurations."""
    return tested.where(F.col("strategy_type") == strategy).groupBy(cell_of(strategy).alias("cell")).agg(F.count("*").alias("visits"))


def coverage_ratio(visited: DataFrame, strategy: str, size: float = CELL) -> DataFrame:
    return visited.agg((F.count("*") / float(math.ceil(1 / size) ** len(BOUNDS[strategy]))).alias("coverage"))


def least_visited(visited: DataFrame, candidates: DataFrame, n: int = 1, seed: int = 42) -> DataFrame:
    """The ``n`` candidate cells with the fewest visits; of cells with as many, those whose hash with the seed is least, so that no corner is favoured."""
    return candidates.join(visited, "cell", "left").fillna(0, ["visits"]).orderBy("visits", F.xxhash64("cell", F.lit(seed)), "cell").limit(n)


# Of all cells a tenth is drawn, between these bounds.
LEAST_DRAWS, MOST_DRAWS = 1_000, 10_000


def next_cells(visited: DataFrame, strategy: str, n: int = 1, size: float = CELL, seed: int = 42) -> DataFrame:
    """(cell, visits): random least-visited cells of a strategy's cube, of a random tenth of all cells."""
    total = math.ceil(1 / size) ** len(BOUNDS[strategy])
    draws = min(max(total // 10, LEAST_DRAWS), MOST_DRAWS, total)
    return least_visited(visited, random_cells(visited.sparkSession, strategy, draws, size, seed), n, seed)


def random_cells(spark: SparkSession, strategy: str, n: int, size: float = CELL, seed: int = 42) -> DataFrame:
    """``n`` draws of cells of a strategy's cube, for least_visited()."""
    cell = F.lit(0).cast("long")
    per = math.ceil(1 / size)
    for i in range(len(BOUNDS[strategy])):
        cell = cell * per + F.pmod(F.xxhash64("id", F.lit(f"{seed}:{i}")), F.lit(per))
    return spark.range(n).select(cell.alias("cell")).distinct()


def center_of(strategy: str, cell: Column, size: float = CELL) -> Column:
    """The parameters in the middle of a cell, as a map."""
    per, out = math.ceil(1 / size), []
    for i, (name, lo, hi, _) in enumerate(BOUNDS[strategy]):
        digit = F.floor(cell / F.lit(per**i).cast("long")) % per
        out += [F.lit(name), lo + (digit + 0.5) * size * (hi - lo)]
    return F.create_map(*out)


def winners(history: DataFrame, strategy: str, most: int = 500) -> DataFrame:
    """The latest ``most`` tested configurations with a positive mean Sharpe: a top-k."""
    return history.where((F.col("strategy_type") == strategy) & (F.col("avg_sharpe") > 0)).orderBy(F.desc("tested_at"), F.desc("avg_sharpe"), "config_id").limit(most)


def untested(candidates: DataFrame, history: DataFrame, days: int = 180) -> DataFrame:
    """Candidates (config_hash, tested_start, tested_end) without a test of the same hash over about the same range: start and end differ by more than
    ``days`` together from those of every test.

    In the coordinates (start + end, start - end) the ranges within ``days`` are a square.  Tests are dealt to cells of its width and to the eight around
    them, so a candidate meets its own cell by an equi-join, however many ranges a hash has.  A null hash or date matches nothing."""
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    u, v = (lambda s, e: day(s) + day(e)), (lambda s, e: day(s) - day(e))
    cell = lambda x: F.floor(x / (days + 1))
    h = history.select(F.col("config_hash").alias("_h"), u("tested_start", "tested_end").alias("_u"), v("tested_start", "tested_end").alias("_v")).distinct()
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    h = h.withColumn("_c", F.explode(F.array(*[F.struct((cell(F.col("_u")) + i).alias("u"), (cell(F.col("_v")) + j).alias("v")) for i, j in around])))
    own_u, own_v = u("tested_start", "tested_end"), v("tested_start", "tested_end")
    same = (F.col("config_hash") == F.col("_h")) & (cell(own_u) == F.col("_c.u")) & (cell(own_v) == F.col("_c.v"))
    return candidates.join(h, same & (F.abs(own_u - F.col("_u")) <= days) & (F.abs(own_v - F.col("_v")) <= days), "left_anti")


# Shares of (local jitter, pure random, cover) by how much is covered, in the warm-up, and with many jumps.
RATIOS = ((0.3, (0.15, 0.45, 0.40)), (0.6, (0.20, 0.45, 0.35)), (math.inf, (0.25, 0.40, 0.35)))
WARM_UP_SHARES = (("cover", 0.50), ("random", 0.40), ("local", 0.10))
JUMPY_SHARES = (("random", 0.70), ("cover", 0.20), ("local", 0.10))
# Cells that count as full coverage, whatever the number of parameters; the jump probability from which winners are never exploited.
REFERENCE_CELLS = 1000
JUMPY = 0.8


@dataclass(frozen=True)
class Schedule:
    """Fixed values of the defaults: those of the system followed."""

    warm_up: int = 50
    exploit: float = 0.25
    decay: float = 0.9
    interval: int = 100
    floor: float = 0.05
    random_every: int = 5
    jump: float = 0.15

    def exploit_probability(self, iteration: int) -> float:
        """0 in the warm-up, then a geometric decay down to the floor."""
        if iteration < self.warm_up:
            return 0.0
        if not self.interval:
            return self.exploit
        return max(self.exploit * self.decay ** ((iteration - self.warm_up) // self.interval), self.floor)

    def shares(self, iteration: int, coverage: float = 0.0, winners: bool = False) -> tuple[tuple[str, float], ...]:
        """(mode, probability): exploit a winner, jitter locally, random, or cover the least visited cells."""
        if self.jump >= JUMPY:
            return JUMPY_SHARES
        if iteration < self.warm_up:
            return WARM_UP_SHARES
        if self.random_every and iteration and iteration % self.random_every == 0:
            return (("random", 1.0),)
        exploit = self.exploit_probability(iteration) if winners else 0.0
        local, random, cover = next(r for most, r in RATIOS if coverage < most)
        return ("local", (1 - exploit) * local), ("exploit", exploit), ("random", (1 - exploit) * random), ("cover", (1 - exploit) * cover)

    def mode(self, iteration: int, coverage: float = 0.0, winners: bool = False, seed: int = 0) -> str:
        """A mode by a draw that depends on the seed and iteration alone."""
        shares, draw = self.shares(iteration, coverage, winners), np.random.default_rng((seed, iteration)).random()
        for name, share in shares:
            if draw < share:
                return name
            draw -= share
        return shares[-1][0]


def effective_coverage(visited: DataFrame) -> DataFrame:
    """coverage: visited cells as a share of REFERENCE_CELLS, at most 1."""
    return visited.agg(F.least(F.count("*") / float(REFERENCE_CELLS), F.lit(1.0)).alias("coverage"))


def combo_size(iteration: int, largest: int = 4, warm_up: int = 0) -> int:
    """Strategies of a combination: 4 each 20th iteration, 3 each 6th, 2 each other even one, else 1, as in the warm-up; ``largest`` leaves out larger ones."""
    if iteration == 0 or iteration < warm_up or largest < 2:
        return 1
    return 4 if iteration % 20 == 0 and largest >= 4 else 3 if iteration % 6 == 0 and largest >= 3 else 2 if iteration % 2 == 0 else 1


def random_combos(strategies: dict[str, list[dict]], size: int, n: int, seed: int = 42) -> list[list[tuple[str, dict]]]:
    rng = np.random.default_rng(seed)
    names = sorted(strategies)
    return [[(s, strategies[s][int(rng.integers(len(strategies[s])))]) for s in sorted(rng.choice(names, size, replace=False).tolist())] for _ in range(n)]


def jittered(strategy: str, config: dict[str, float], pct: float = 0.1, jump: float = 0.05, seed: int = 42) -> dict[str, float]:
    """Each parameter moved by up to ``pct``, or with probability ``jump`` drawn anew within its bounds."""
    rng, out = np.random.default_rng(seed), dict(config)
    for p, lo, hi, step in BOUNDS[strategy]:
        v = rng.uniform(lo, hi) if rng.random() < jump else config[p] * (1 + rng.uniform(-pct, pct))
        v = min(hi, max(lo, lo + round((v - lo) / step) * step))
        out[p] = int(round(v)) if step >= 1 else v
    return out


def cells(strategy: str, size: float = CELL) -> float:
    return math.prod([math.ceil(1 / size)] * len(BOUNDS[strategy]))
