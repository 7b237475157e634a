"""Sinks and scans of results: tables, histories, snapshots, quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "tested_at timestamp, iteration int, strategy_type string, config_id string, config_hash long, params map<string,double>, symbol_count int, avg_sharpe double, min_sharpe double, max_sharpe double, hit_rate double, avg_cagr double, avg_max_drawdown double, tested_start date, tested_end date"
VERSION = 2


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, or CSV where the path ends in .csv."""
    if path.endswith(".csv"):
        plain = [F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*plain).write.mode(mode).csv(path, header=True)
    else:
        df.write.mode(mode).parquet(path)


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def append_history(tested: DataFrame, folder: str) -> None:
    """Append tested configurations, one JSON line each; files are added, none is rewritten."""
    tested.write.mode("append").json(folder)


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """All lines that name a configuration; malformed ones don't."""
    return spark.read.schema(HISTORY).json(folder).where("config_hash is not null and config_id is not null")


def tested_index(history: DataFrame) -> DataFrame:
    """(config_hash, ranges): the different ranges that each configuration was tested over."""
    return history.select("config_hash", F.struct("tested_start", "tested_end").alias("r")).distinct().groupBy("config_hash").agg(F.array_sort(F.collect_list("r")).alias("ranges"))


def save_snapshot(df: DataFrame, path: str) -> None:
    """A table with the version of its layout."""
    df.withColumn("_version", F.lit(VERSION)).write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Empty if the layout is older."""
    return spark.read.parquet(path).where(F.col("_version") >= VERSION).drop("_version")


def save_run(results: DataFrame, manifest: DataFrame, folder: str) -> None:
    """A run's folder: results as Parquet, and its manifest as one JSON document."""
    results.write.mode("overwrite").parquet(f"{folder}/results")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def load_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/results"), spark.read.json(f"{folder}/manifest")


def read_scan(spark: SparkSession, path: str) -> DataFrame:
    """Scan results from a JSON document or an array of them."""
    return spark.read.option("multiLine", True).json(path)


def write_quality_report(report: DataFrame, symbol: str, path: str) -> None:
    report.withColumn("symbol", F.lit(symbol)).coalesce(1).write.mode("overwrite").json(path)
