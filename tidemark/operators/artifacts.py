"""Artifact documents: one JSON file per series and configuration, with all of its parity vectors, in the order of time.

A document is written as lines: a head up to the opening of the list, a line per bar, a foot.  Lines are dealt by document and sorted, and Spark's text writer
streams each document into a file of its own, so a document may be larger than a task's memory; nothing is collected.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import signals as sig
from tidemark.operators.backtest import Costs, positions
from tidemark.schema import KEYS

SCHEMA_VERSION = "1.0.0"


@dataclass(frozen=True)
class Document:
    """What the documents of one configuration share.  ``values``: by indicator id, columns of the signals by the names of its values."""

    strategy_id: str
    config_id: str
    parameters: dict
    indicators: list[dict]
    entry: dict
    exit: dict
    values: dict[str, dict[str, str]] = field(default_factory=dict)


def donchian(bars: DataFrame, entry: int, exit: int, keys=KEYS) -> tuple[DataFrame, Document]:
    """Signals with the columns of both channels, and their document."""
    out = sig.donchian(bars, entry, exit)
    (up, low), (up2, low2) = ind.donchian(entry, keys), ind.donchian(exit, keys)
    out = out.withColumns({"_entry_upper": up, "_entry_lower": low, "_exit_upper": up2, "_exit_lower": low2})
    one = lambda name, n, expr: {"id": name, "type": "donchian", "params": {"lookback": n}, "pine_expr": expr}
    document = Document(
        "donchian_breakout", f"donchian_{entry}_{exit}", {"entry_lookback": entry, "exit_lookback": exit},
        [one("donchian_entry", entry, f"ta.highest(high[1], {entry})"), one("donchian_exit", exit, f"ta.lowest(low[1], {exit})")],
        {"condition": "close > donchian_entry.upper", "pine_condition": f"close > ta.highest(high[1], {entry})", "position_required": "flat"},
        {"condition": "close < donchian_exit.lower", "pine_condition": f"close < ta.lowest(low[1], {exit})", "position_required": "long"},
        {"donchian_entry": {"upper": "_entry_upper", "lower": "_entry_lower"}, "donchian_exit": {"upper": "_exit_upper", "lower": "_exit_lower"}},
    )
    return out, document


def _members(*columns: Column) -> Column:
    """The members of a JSON object, without its braces."""
    text = F.to_json(F.struct(*columns))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _iso(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def lines(signals: DataFrame, document: Document, costs: Costs = Costs(), keys=KEYS) -> DataFrame:  # noqa: B008
    """(document, at, line): ``at`` orders the lines of a document.  A bar's signal is enter_long or exit_long where the position changes, which
    position_after shows at once; values that are null are left out."""
    e, x = F.coalesce("raw_entry", F.lit(False)), F.coalesce("raw_exit", F.lit(False))
    state = F.col("position_state")
    after = F.when(e & x, 1 - state).when(e, 1).when(x, 0).otherwise(state)
    out = positions(signals, keys).withColumn("_after", after)
    name = F.concat_ws("_", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(document.config_id)).alias("document")
    move = F.when((F.col("_after") == 1) & (state == 0), "enter_long").when((F.col("_after") == 0) & (state == 1), "exit_long")
    found = {i: F.struct(*[F.col(c).alias(n) for n, c in of.items()]) for i, of in document.values.items()}
    shown = F.struct(*[F.when(F.coalesce(*[c.isNotNull() for c in [v[n] for n in document.values[i]]], F.lit(False)), v).alias(i) for i, v in found.items()])
    bar = F.to_json(F.struct(_iso("ts").alias("ts"), F.struct("open", "high", "low", "close", "volume").alias("ohlcv"), shown.alias("indicators"), move.alias("signal"), F.when(F.col("_after") == 1, "long").otherwise("flat").alias("position_after")))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("ts"))
    bars = out.select(name, number.cast("long").alias("at"), F.concat(F.when(number > 1, ",").otherwise(""), bar).alias("line"))
    head = {"schema_version": SCHEMA_VERSION, "strategy_id": document.strategy_id, "indicators": document.indicators, "rules": {"entry": document.entry, "exit": document.exit}, "fill_model": "NextOpen", "cost_model": {"fees_bps_per_side": costs.fee_bps, "slippage_bps": costs.slip_bps}, "parameters": document.parameters, "metadata": {"config_id": document.config_id}}
    own = signals.groupBy(*keys).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.first("timeframe").alias("timeframe"), F.count("*").alias("_n"))
    about = _members(F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("symbol"), F.col("timeframe"), F.struct(_iso("_first").alias("start"), _iso("_last").alias("end")).alias("data_range"))
    start = F.concat(F.lit(json.dumps(head)[:-1] + ","), about, F.lit(',"parity_vectors":{"description":"Indicators, signals and positions of every bar","vectors":['))
    ends = own.select(name, F.explode(F.array(F.struct(F.lit(0).cast("long").alias("at"), start.alias("line")), F.struct((F.col("_n") + 1).alias("at"), F.lit("]}}").alias("line")))).alias("l"))
    return bars.unionByName(ends.select("document", "l.at", "l.line"))


def write(document_lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A file under {path}/document=... for each document of lines(), of one or several configurations."""
    dealt = document_lines.repartition("document").sortWithinPartitions("document", "at")
    dealt.select("document", "line").write.mode(mode).option("maxRecordsPerFile", 0).partitionBy("document").text(path)
