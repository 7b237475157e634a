"""Repeatable ingest of vendor files into a store.

A ledger beside the store has a row for each file taken in: symbol, SHA-256 of the content, number of bars and their range.  Files whose symbol and
content are in the ledger are left out by an anti-join.  Bars of the others replace those of the same symbol and timestamp, and only the (symbol, year)
partitions that they touch are written anew, by dynamic partition overwrite: all others keep their files byte for byte.  The store is
written before the ledger, so an ingest that was broken off is done again with the same result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import BAR
from tidemark.sources.bars import VENDOR_CSV, vendor_bars

LEDGER = "symbol string, file string, sha256 string, bars long, first timestamp, last timestamp, ingested_at timestamp"


def ledger(spark: SparkSession, base: str, timeframe: str = "1d") -> DataFrame:
    """What has been taken in; empty before the first ingest."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{base}/_ledger/{timeframe}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _stored(spark: SparkSession, base: str, timeframe: str) -> DataFrame:
    schema = T.StructType([*BAR, T.StructField("year", T.IntegerType())])
    try:
        return spark.read.schema(schema).parquet(f"{base}/{timeframe}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _symbol(path):
    return F.upper(F.url_decode(F.regexp_extract(path, r"([^/]+)\.csv$", 1)))


def pending(spark: SparkSession, folder: str, base: str, timeframe: str = "1d") -> DataFrame:
    """(symbol, file, sha256) of the files {symbol}.csv in ``folder`` whose content hasn't been taken in for that symbol."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    found = files.select(_symbol(F.col("path")).alias("symbol"), F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))
    # the latest entry of a symbol counts: a file that goes back to an older content is taken in again
    known = ledger(spark, base, timeframe).groupBy("symbol").agg(F.max_by("sha256", F.struct("ingested_at", "sha256")).alias("sha256"))
    return found.join(known, ["symbol", "sha256"], "left_anti").select("symbol", "file", "sha256")


def ingest_csv(spark: SparkSession, folder: str, base: str, timeframe: str = "1d") -> DataFrame:
    """Take in the vendor files {symbol}.csv of ``folder`` that are new or changed; returns their rows of the ledger.  Of bars of one file with equal timestamps
    the one with the greatest values stays.  Reading a file takes its whole content into a task's memory once, to hash it."""
    new = pending(spark, folder, base, timeframe).persist()
    files = [r.file for r in new.select("file").collect()]  # names, as the listing has them
    if not files:
        new.unpersist()
        return spark.createDataFrame([], LEDGER)
    raw = spark.read.csv(files, header=True, schema=VENDOR_CSV, nullValue="null", enforceSchema=False)
    bars = vendor_bars(raw.withColumn("symbol", _symbol(raw.metadataColumn("_metadata")["file_path"])), timeframe)
    values = ("close", "open", "high", "low", "volume")
    bars = bars.groupBy("symbol", "ts").agg(F.max(F.struct(*values)).alias("v")).select("ts", *[f"v.{c}" for c in values], "symbol", F.lit(timeframe).alias("timeframe"), F.year("ts").alias("year")).persist()
    entries = bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    entries = new.join(entries, "symbol", "left").select("symbol", "file", "sha256", F.coalesce("bars", F.lit(0)).cast("long").alias("bars"), "first", "last", F.current_timestamp().alias("ingested_at"))
    done = spark.createDataFrame(entries.collect(), LEDGER)  # before anything is written: what is read from the ledger changes with it
    touched = bars.select("symbol", "year").distinct()
    kept = _stored(spark, base, timeframe).join(touched, ["symbol", "year"], "left_semi").join(bars.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
    out = kept.select(*bars.columns).unionByName(bars).repartition("symbol", "year").sortWithinPartitions("symbol", "year", "ts")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "year").parquet(f"{base}/{timeframe}")
    done.coalesce(1).write.mode("append").parquet(f"{base}/_ledger/{timeframe}")  # a row a file
    for df in (new, bars):
        df.unpersist()
    return done
