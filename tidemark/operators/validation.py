"""Walk-forward and cross-validation over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.metrics import sharpe, with_returns
from tidemark.schema import KEYS, bar_number


class TooShort(ValueError):
    pass


def walk_forward_folds(spark: SparkSession, bars: int, inside: int = 252, gap: int = 5, outside: int = 63, step: int = 63, least: int = 1) -> DataFrame:
    """(fold, is_start, is_end, oos_start, oos_end), ends exclusive; only complete folds."""
    n = max(0, (bars - inside - gap - outside) // step + 1) if bars >= inside + gap + outside else 0
    if n < least:
        raise TooShort(f"{n} folds of {bars} bars; {least} wanted")
    at = F.col("id") * step
    return spark.range(n).select(F.col("id").alias("fold"), at.alias("is_start"), (at + inside).alias("is_end"), (at + inside + gap).alias("oos_start"), (at + inside + gap + outside).alias("oos_end"))


def cv_splits(spark: SparkSession, bars: int, splits: int = 5, gap: int = 0, most_train: int | None = None) -> DataFrame:
    """Equal test blocks at the end; training is all before, less the gap, or its last ``most_train`` bars."""
    block = bars // (splits + 1)
    if not block:
        raise TooShort(f"{splits} splits of {bars} bars")
    start = bars - (splits - F.col("id")) * block
    train_end = F.greatest(start - gap, F.lit(0))
    return spark.range(splits).select(F.col("id").alias("fold"), (F.greatest(train_end - most_train, F.lit(0)) if most_train else F.lit(0)).alias("train_start"), train_end.alias("train_end"), start.alias("test_start"), (start + block).alias("test_end"))


def fold_results(curve: DataFrame, inside: int = 252, gap: int = 5, outside: int = 63, step: int = 63, keys=KEYS) -> DataFrame:
    """Per series and complete fold: in-sample and out-of-sample Sharpe, and return out of sample.

    The folds of a bar follow from its number, so bars are exploded into their folds rather than joined to ranges."""
    r = with_returns(curve, keys).withColumn("_i", bar_number(keys))
    from pyspark.sql import Window

    r = r.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    size = inside + gap + outside
    last = F.floor((F.col("_n") - size) / step)
    lo, hi = F.greatest(F.lit(0), F.ceil((F.col("_i") - size + 1) / step)), F.least(F.floor(F.col("_i") / step), last)
    folds = F.when((F.col("_n") >= size) & (lo <= hi), F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = r.select(*keys, "ts", "ret", "equity", "_i", F.explode(folds).alias("fold"))
    at = F.col("_i") - F.col("fold") * step
    rows = rows.withColumns({"_in": F.when((at > 0) & (at < inside), F.col("ret")), "_out": F.when(at > inside + gap, F.col("ret")), "_e": F.when(at >= inside + gap, F.col("equity"))})
    out = rows.groupBy(*keys, "fold").agg(sharpe("_in").alias("is_sharpe"), sharpe("_out").alias("oos_sharpe"), F.min_by("_e", F.when(F.col("_e").isNotNull(), F.col("ts"))).alias("_a"), F.max_by("_e", F.when(F.col("_e").isNotNull(), F.col("ts"))).alias("_b"))
    out = out.withColumn("oos_return", F.when(F.abs("_a") > 1e-10, F.col("_b") / F.col("_a") - 1.0).otherwise(0.0)).drop("_a", "_b")
    return out.withColumn("degradation", F.when(F.abs("is_sharpe") > 1e-10, F.col("oos_sharpe") / F.col("is_sharpe")).otherwise(1.0))


def walk_forward(folds: DataFrame, keys=KEYS) -> DataFrame:
    """Per series: folds, mean and population deviation of the out-of-sample Sharpe, mean degradation, share of profitable folds, grade."""
    out = folds.groupBy(*keys).agg(F.count("*").alias("folds"), F.avg("oos_sharpe").alias("mean_oos_sharpe"), F.stddev_pop("oos_sharpe").alias("std_oos_sharpe"), F.avg("degradation").alias("mean_degradation"), F.avg((F.col("oos_return") > 0).cast("double")).alias("pct_profitable"))
    return out.withColumn("grade", grade(F.col("mean_oos_sharpe"), F.col("pct_profitable"), F.col("mean_degradation"), F.col("std_oos_sharpe")))


def grade(mean: Column, profitable: Column, degradation: Column, std: Column) -> Column:
    """A: strict tests and a mean over 0.8; B: strict tests; C: basic ones; D: positive, and over half of the folds profitable."""
    basic = (mean > 0.3) & (profitable >= 0.6) & (degradation > 0.5)
    strict = (mean > 0.5) & (profitable >= 0.75) & (degradation > 0.7) & (std < 0.5)
    return F.when(strict & (mean > 0.8), "A").when(strict, "B").when(basic, "C").when((mean > 0) & (profitable > 0.5), "D").otherwise("F")


def equity_folds(curve: DataFrame, folds: int = 3, inside: float = 0.85, least_bars: int = 42, keys=KEYS) -> DataFrame:
    """Per series and equal fold of its curve: Sharpe (sample deviation) of its first 85% and of the rest.  Folds without 20 returns
    inside and 5 outside, and series of fewer than ``least_bars`` a fold, have none."""
    from pyspark.sql import Window

    r = with_returns(curve, keys).where("ret is not null")
    w = Window.partitionBy(*keys)
    r = r.withColumns({"_i": F.row_number().over(w.orderBy("ts")) - 1, "_n": F.count("*").over(w)}).where(F.col("_n") >= folds * least_bars)
    size = F.floor(F.col("_n") / folds)
    r = r.withColumn("fold", F.least(F.floor(F.col("_i") / size), F.lit(folds - 1)))
    length = F.when(F.col("fold") == folds - 1, F.col("_n") - size * (folds - 1)).otherwise(size)
    r = r.withColumns({"_end": F.floor(length * inside), "_at": F.col("_i") - F.col("fold") * size, "_length": length}).where((F.col("_end") >= 20) & (F.col("_length") - F.col("_end") >= 5))
    r = r.withColumns({"_in": F.when(F.col("_at") < F.col("_end"), F.col("ret")), "_out": F.when(F.col("_at") >= F.col("_end"), F.col("ret"))})
    one = lambda c: F.coalesce(F.when(F.stddev_samp(c) >= 1e-10, F.avg(c) / F.stddev_samp(c) * 252**0.5), F.lit(0.0))
    return r.groupBy(*keys, "fold").agg(one("_in").alias("is_sharpe"), one("_out").alias("oos_sharpe"))


def pooled_walk_forward(folds: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Over all series' equity_folds(), by ``keys``: mean, deviation (sample), share of positive folds, degradation, one-sided p and grade;
    nothing for fewer than three folds."""
    from tidemark.operators.statistics import mean_p_values

    own = folds if keys else folds.withColumn("all", F.lit("all"))
    by = list(keys) or ["all"]
    out = own.groupBy(*by).agg(F.count("*").alias("folds"), F.avg("oos_sharpe").alias("mean_oos_sharpe"), F.stddev_samp("oos_sharpe").alias("std_oos_sharpe"), F.avg((F.col("oos_sharpe") > 0).cast("double")).alias("pct_profitable"), F.avg("is_sharpe").alias("_is")).where("folds >= 3")
    out = out.withColumn("degradation", F.when(F.abs("_is") > 1e-6, F.col("mean_oos_sharpe") / F.col("_is")).otherwise(0.0)).drop("_is")
    letter = F.lit("F")
    # Mean, degradation and profitable share that each grade must exceed.
    for name, mean, kept, positive in (("D", 0.0, 0.2, 0.5), ("C", 0.1, 0.3, 0.6), ("B", 0.3, 0.5, 0.7), ("A", 0.5, 0.7, 0.8)):
        letter = F.when((F.col("mean_oos_sharpe") > mean) & (F.col("degradation") > kept) & (F.col("pct_profitable") > positive), name).otherwise(letter)
    return out.withColumn("grade", letter).join(mean_p_values(own, by, "oos_sharpe").select(*by, "p"), by)
