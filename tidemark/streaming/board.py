"""A live leaderboard over a stream of results, and live visit counts.

State by strategy holds the best ``k`` configurations with their best values.  A configuration's best only rises, so whatever left the board can come back only with a
result that is good enough by itself: the board over a stream equals the board over all its rows, in any order, with repeats.  Each task
first keeps the best k by strategy of the rows it has, so that a strategy with most of the rows sends few.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BOARD = "strategy_type string, version long, rank int, config_id string, value double"
STATE = "configs array<string>, vals array<double>, version long"


def _best(held: dict[str, float], k: int) -> list[tuple[str, float]]:
    return sorted(held.items(), key=lambda x: (-x[1], x[0]))[:k]


def _offered(held: dict[str, float], frame: pd.DataFrame) -> None:
    for c, v in zip(frame["config_id"], frame["value"], strict=True):
        if c is not None and not pd.isna(v) and v > held.get(c, float("-inf")):
            held[c] = v


def live_board(results: DataFrame, metric: str = "sharpe", k: int = 10) -> DataFrame:
    """BOARD, in update mode: whenever a strategy gets results, its whole board with a higher version.  ``results`` has strategy_type, config_id and
    the metric; rows with a null in any of these don't count.  Equal values are ordered by configuration."""

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict[str, float]] = {}
        for b in batches:
            for strategy, own in b.groupby("strategy_type"):
                mine = held.setdefault(strategy, {})
                _offered(mine, own)
                held[strategy] = dict(_best(mine, k))
        for strategy, own in held.items():
            yield pd.DataFrame([(strategy, c, v) for c, v in own.items()], columns=["strategy_type", "config_id", "value"])

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        configs, values, version = state.get if state.exists else ([], [], 0)
        held = dict(zip(configs, values, strict=True))
        for b in frames:
            _offered(held, b)
        top = _best(held, k)
        state.update(([c for c, _ in top], [v for _, v in top], version + 1))
        yield pd.DataFrame([(key[0], version + 1, i, c, v) for i, (c, v) in enumerate(top, 1)], columns=["strategy_type", "version", "rank", "config_id", "value"])

    slim = results.select("strategy_type", "config_id", F.col(metric).cast("double").alias("value")).where("strategy_type is not null")
    thinned = slim.mapInPandas(thin, "strategy_type string, config_id string, value double")
    return thinned.groupBy("strategy_type").applyInPandasWithState(update, BOARD, STATE, "update", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame) -> DataFrame:
    """The newest board of each strategy, of a table of updates."""
    newest = F.max("version").over(Window.partitionBy("strategy_type"))
    return updates.withColumn("_v", newest).where("version = _v").drop("_v")


def live_visits(tested: DataFrame, strategy: str) -> DataFrame:
    """(cell, visits) of a stream of tested configurations, in update or complete mode."""
    from tidemark.operators.explore import visits

    return visits(tested, strategy)
