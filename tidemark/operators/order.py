"""Running sums over an order of all rows, without passing them through one task.

Rows are counted by value first.  A monotone bucket of the value splits the order: sums of buckets are a small table, whose prefix sums start the
running sums within each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def p_bucket(p: Column) -> Column:
    """A bucket that rises with p, finer towards 0: 64 for each power of two down to 1e-12."""
    return F.floor(64.0 * F.log2(F.greatest(p, F.lit(1e-12))))


def with_running(values: DataFrame, keys: list[str], bucket: Column, order: str, sums: dict[str, Column] | None = None, greatest: dict[str, Column] | None = None, least_after: dict[str, Column] | None = None) -> DataFrame:
    """``values``, of one row per (keys, order), with columns named by ``sums`` and ``greatest`` over this row and all before it, and by
    ``least_after`` over this row and all after it."""
    sums, greatest, least_after = sums or {}, greatest or {}, least_after or {}
    own = values.withColumn("_b", bucket)
    w = Window.partitionBy(*keys, "_b").orderBy(order)
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    buckets = own.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_g_{n}") for n, c in greatest.items()], *[F.min(c).alias(f"_l_{n}") for n, c in least_after.items()])
    # a table of buckets
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before, after = every.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1), every.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    buckets = buckets.select(*keys, "_b", *[F.sum(f"_s_{n}").over(before).alias(f"_s_{n}") for n in sums], *[F.max(f"_g_{n}").over(before).alias(f"_g_{n}") for n in greatest], *[F.min(f"_l_{n}").over(after).alias(f"_l_{n}") for n in least_after])
    here = {n: F.sum(c).over(up) for n, c in sums.items()} | {n: F.max(c).over(up) for n, c in greatest.items()} | {n: F.min(c).over(down) for n, c in least_after.items()}
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col("_b") == F.col("_of_b")]
    renamed = buckets.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_b").alias("_of_b"), *[c for c in buckets.columns if c not in (*keys, "_b")])
    out = own.withColumns(here).join(renamed, same)
    whole = {n: F.col(n) + F.coalesce(f"_s_{n}", F.lit(0)) for n in sums} | {n: F.greatest(n, f"_g_{n}") for n in greatest} | {n: F.least(n, f"_l_{n}") for n in least_after}
    return out.withColumns(whole).select(*values.columns, *here)
