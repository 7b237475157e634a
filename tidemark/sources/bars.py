"""Scans, sinks and derived tables of bars."""

from __future__ import annotations

import datetime as dt
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import BAR


class NoData(ValueError):
    """A symbol or range without bars."""


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """Bars of one or more files; typed and empty if there are none.  Order by ts where it matters: a scan has none."""
    return spark.read.schema(BAR).parquet(*paths) if paths else spark.createDataFrame([], BAR)


def scan_store(spark: SparkSession, base: str, timeframe: str = "1d", symbols: list[str] | None = None, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Bars of a store partitioned by symbol and year; both ends of the range are included.  Partitions that can't match aren't listed
    into the scan, and the bounds on ts reach the reader."""
    out = spark.read.option("basePath", f"{base}/{timeframe}").parquet(f"{base}/{timeframe}")
    if symbols is not None:
        out = out.where(F.col("symbol").isin(symbols))
    if start:
        out = out.where((F.col("year") >= start.year) & (F.col("ts") >= F.lit(dt.datetime.combine(start, dt.time()))))
    if end:
        out = out.where((F.col("year") <= end.year) & (F.col("ts") <= F.lit(dt.datetime.combine(end, dt.time(23, 59, 59)))))
    return out


def scan_symbol(spark: SparkSession, base: str, symbol: str, timeframe: str = "1d", start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """As scan_store for one symbol; raises NoData where nothing matches."""
    out = scan_store(spark, base, timeframe, [symbol], start, end)
    if out.isEmpty():
        raise NoData(f"no bars of {symbol} at {timeframe}")
    return out


def write_store(bars: DataFrame, base: str, timeframe: str = "1d", mode: str = "append") -> None:
    """The layout {base}/{timeframe}/symbol=S/year=Y.  Rows are dealt by those keys and a salt, so that a large symbol has several writers."""
    out = bars.withColumn("year", F.year("ts"))
    out.repartition("symbol", "year", F.pmod(F.dayofyear("ts"), F.lit(4))).sortWithinPartitions("symbol", "year", "ts").write.mode(mode).partitionBy("symbol", "year").parquet(f"{base}/{timeframe}")


def date_range(bars: DataFrame) -> DataFrame:
    """(symbol, first, last) of each symbol that has bars."""
    return bars.groupBy("symbol").agg(F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"))


def available_symbols(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct()


def by_year(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", F.year("ts").alias("year")).agg(F.count("*").alias("bars"), F.min("ts").alias("first"), F.max("ts").alias("last"))


# --- vendor files ---

VENDOR_CSV = T.StructType([T.StructField(n, T.StringType()) for n in ("Date", "Open", "High", "Low", "Close", "Adj Close", "Volume")])


def adjusted(raw: DataFrame) -> DataFrame:
    """Scale open, high and low by adj_close / close (1 where close is 0); close becomes adj_close."""
    factor = F.when(F.col("close") == 0, 1.0).otherwise(F.try_divide("adj_close", "close"))
    return raw.select("ts", *[(F.col(c) * factor).alias(c) for c in ("open", "high", "low")], F.col("adj_close").alias("close"), "volume", "symbol", "timeframe")


def read_vendor_csv(spark: SparkSession, path: str, symbol: str, timeframe: str = "1d") -> DataFrame:
    """Date, Open, High, Low, Close, Adj Close, Volume; rows with a ``null`` are dropped, other text in a number is an error."""
    raw = spark.read.csv(path, header=True, schema=VENDOR_CSV, nullValue="null", enforceSchema=False)
    return vendor_bars(raw.withColumn("symbol", F.lit(symbol)), timeframe)


def vendor_bars(raw: DataFrame, timeframe: str = "1d") -> DataFrame:
    """Adjusted bars of VENDOR_CSV rows with their symbol."""
    number = lambda c: F.col(f"`{c}`").cast("double")
    out = raw.dropna().select(F.to_timestamp("Date").alias("ts"), number("Open").alias("open"), number("High").alias("high"), number("Low").alias("low"), number("Close").alias("close"), number("Adj Close").alias("adj_close"), number("Volume").alias("volume"), "symbol", F.lit(timeframe).alias("timeframe"))
    return adjusted(out)


CHART = "chart struct<result: array<struct<timestamp: array<bigint>, indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>>, adjclose: array<struct<adjclose: array<double>>>>>>, error: struct<code: string, description: string>>"


def read_vendor_chart(spark: SparkSession, path: str, symbol: str, timeframe: str = "1d") -> DataFrame:
    """Nested JSON of parallel arrays.  Bars with time 0 or a null price are left out; a null volume is 0; an error object raises."""
    raw = spark.read.schema(CHART).json(path, multiLine=True)
    if row := raw.where("chart.error is not null").select("chart.error.*").first():
        raise NoData(f"{row['code']}: {row['description']}")
    result = raw.select(F.explode("chart.result").alias("r")).select(F.col("r.timestamp").alias("t"), F.col("r.indicators.quote")[0].alias("q"), F.col("r.indicators.adjclose")[0]["adjclose"].alias("a"))
    zipped = F.arrays_zip("t", "q.open", "q.high", "q.low", "q.close", "a", "q.volume")
    rows = result.select(F.explode(zipped).alias("z")).toDF("z")
    names = ("t", "open", "high", "low", "close", "adj_close", "volume")
    fields = rows.schema["z"].dataType.fieldNames()
    rows = rows.select(*[F.col("z")[f].alias(n) for f, n in zip(fields, names, strict=True)])
    out = rows.where((F.col("t") != 0) & F.col("t").isNotNull()).dropna(subset=["open", "high", "low", "close", "adj_close"])
    return adjusted(out.select(F.timestamp_seconds("t").alias("ts"), "open", "high", "low", "close", "adj_close", F.coalesce("volume", F.lit(0.0)).alias("volume"), F.lit(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe")))


def parse_tickers(text: str) -> list[str]:
    """A comma-separated list, or lines with # comments; upper case."""
    lines = [line.split("#")[0] for line in text.splitlines()]
    return [t.strip().upper() for line in lines for t in line.split(",") if t.strip()]


def read_universe(spark: SparkSession, toml: str) -> DataFrame:
    """(symbol, sector_id, sector_name, ordinal) of the sectors in a TOML text with [[sectors]] of id, name and tickers."""
    found = [(t.upper(), s["id"], s["name"], i) for i, s in enumerate(tomllib.loads(toml)["sectors"]) for t in s["tickers"]]
    return spark.createDataFrame(found, "symbol string, sector_id string, sector_name string, ordinal int")


def sector_lookup(universe: DataFrame) -> DataFrame:
    """(symbol, sector): the later sector wins where a symbol has two."""
    return universe.groupBy("symbol").agg(F.max_by("sector_name", "ordinal").alias("sector"))


def with_sector(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Left join on symbol; ``Unknown`` where there is no sector.  The planner broadcasts the lookup if it is small."""
    return df.join(lookup, "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))


# --- bars derived from the driver's tables ---


def _folded(rows: DataFrame, price: str, order: list[str], keys: list[str], timeframe: str) -> DataFrame:
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume")
    ).withColumn("timeframe", F.lit(timeframe))


def bars_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values; the event type is the symbol."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("ts").alias("at"), "event_id", "value")
    return _folded(e, "value", ["at", "event_id"], ["symbol", "ts"], "1h")


def bars_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of order prices by nation, with the region as sector."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    c = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")
    o = read("orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"), F.date_trunc("week", "o_orderdate").cast("timestamp_ntz").alias("ts"), "o_totalprice", "o_orderdate", "o_orderkey")
    return _folded(o, "o_totalprice", ["o_orderdate", "o_orderkey"], ["symbol", "sector", "ts"], "1w")


def bars_one(spark: SparkSession, sf_dir: str, minutes: int = 10) -> DataFrame:
    """One series of all event values."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select(F.lit("ALL").alias("symbol"), F.window("ts", f"{minutes} minutes")["start"].cast("timestamp_ntz").alias("ts"), F.col("ts").alias("at"), "event_id", "value")
    return _folded(e, "value", ["at", "event_id"], ["symbol", "ts"], f"{minutes}m")
