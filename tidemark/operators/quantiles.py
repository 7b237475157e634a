"""Exact quantiles of groups of any size, by selection.

A quantile is the mean of one or two values of known rank.  A sketch of each group gives an interval that should hold that rank; values below it are counted,
and values within it take the place of the group.  Each round leaves a small share of the values, so few rounds do; the rest of at most MOST values, or of
one value however often it occurs, is sorted.  A group is never held, and results don't depend on the sketch: a rank that an interval misses goes on in the part
beside it.

Groups of at most MOST values are aggregated at once by the planner's own function; the largest group's size is looked at first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a group that an aggregate may hold.
MOST = 100_000
#: The sketch's ranks are off by at most 1 / ACCURACY of the values.
ACCURACY = 2_000


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def exact(df: DataFrame, keys: list[str], quantiles: dict[str, tuple[str, float]], most: int = MOST) -> DataFrame:
    """keys and a column for each of ``quantiles``, by name (column, share): linear between the two nearest ranks of the values that aren't null; null without values."""
    out = df.select(*keys).distinct()
    for column in dict.fromkeys(c for c, _ in quantiles.values()):
        own = {n: p for n, (c, p) in quantiles.items() if c == column}
        found = _selected(df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_v")), keys, own, most)
        out = out.alias("a").join(found.alias("b"), _same("a", "b", keys), "left").select("a.*", *[f"b.{n}" for n in own])
    return out


def _selected(values: DataFrame, keys: list[str], shares: dict[str, float], most: int) -> DataFrame:
    """keys and a column for each share, of values (keys, _v)."""
    at = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in shares.items()])
    sizes = values.groupBy(*keys).agg(F.count("*").alias("left"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).withColumn("w", F.explode(at))
    rank = (F.col("left") - 1) * F.col("w.p")
    # the lower rank of each quantile, from 0 in what is left between lo and hi; the value after it is found with it
    todo = sizes.select(*keys, F.col("w.name").alias("name"), F.floor(rank).alias("rank"), (rank - F.floor(rank)).alias("part"), "left", "lo", "hi").cache()
    while not todo.where((F.col("left") > most) & (F.col("lo") < F.col("hi"))).isEmpty():
        # as large as their groups: those with one value left, or few, wait
        wide = todo.where((F.col("left") > most) & (F.col("lo") < F.col("hi")))
        inside = values.alias("v").join(wide.alias("t"), _same("v", "t", keys) & F.col("_v").between(F.col("lo"), F.col("hi"))).select(*[F.col(f"t.{k}") for k in keys], "_v", "name", "rank", "part", "left", "lo", "hi")
        by = [*keys, "name", "rank", "part", "left", "lo", "hi"]
        near = F.array(*[F.lit(i / 100) for i in range(101)])
        sketched = inside.groupBy(*by).agg(F.percentile_approx("_v", near, ACCURACY).alias("grid"))
        share = (F.col("rank") / F.col("left") * 100).cast("int")
        cut = sketched.select(*by, F.get("grid", F.greatest(share - 1, F.lit(0))).alias("a"), F.get("grid", F.least(share + 2, F.lit(100))).alias("b")).cache()
        parts = inside.alias("v").join(cut.alias("t"), _same("v", "t", keys) & (F.col("v.name") == F.col("t.name"))).select(*[F.col(f"t.{c}") for c in by], "a", "b", "_v")
        # the ends are parts of their own, so that every round leaves less
        part = F.when(F.col("_v") < F.col("a"), 0).when(F.col("_v") == F.col("a"), 1).when(F.col("_v") < F.col("b"), 2).when(F.col("_v") == F.col("b"), 3).otherwise(4)
        counted = parts.groupBy(*by, part.alias("side")).agg(F.count("*").alias("n"), F.min("_v").alias("from"), F.max("_v").alias("to"))
        sides = counted.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("side", "n", "from", "to"))).alias("s"))
        # of the at most five parts, the one with the rank
        before = lambda i: F.aggregate(F.slice("s", F.lit(1), i), F.lit(0).cast("long"), lambda t, x: t + x["n"])
        placed = sides.select("*", F.posexplode("s").alias("i", "x")).withColumn("below", before(F.col("i")))
        held = placed.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("x.n")))
        narrowed = held.select(*keys, "name", (F.col("rank") - F.col("below")).alias("rank"), "part", F.col("x.n").alias("left"), F.col("x.from").alias("lo"), F.col("x.to").alias("hi"))
        rest = todo.where((F.col("left") <= most) | (F.col("lo") >= F.col("hi")))
        new = rest.unionByName(narrowed).cache()
        new.count()
        todo.unpersist()
        cut.unpersist()
        todo = new
    few = todo.where((F.col("left") <= most) & (F.col("lo") < F.col("hi")))
    held = values.alias("v").join(few.alias("t"), _same("v", "t", keys) & F.col("_v").between(F.col("lo"), F.col("hi")))
    lists = held.groupBy(*[F.col(f"t.{k}").alias(k) for k in keys], "name").agg(F.sort_array(F.collect_list("_v")).alias("vs"))
    sorted_ = todo.alias("a").join(lists.alias("b"), _same("a", "b", keys) & (F.col("a.name") == F.col("b.name")), "left").select("a.*", "b.vs")
    own = F.coalesce(F.get("vs", F.col("rank").cast("int")), F.col("lo"))
    inner = F.when(F.col("rank") + 1 < F.col("left"), F.coalesce(F.get("vs", (F.col("rank") + 1).cast("int")), F.col("lo")))
    out = sorted_.select(*keys, "name", "part", "hi", own.alias("x"), inner.alias("y"))
    # where the next rank lies past what is left, it is the least of the values above
    past = out.where("part > 0 and y is null").select(*keys, "name", "hi")
    above = values.alias("v").join(past.alias("t"), _same("v", "t", keys) & (F.col("_v") > F.col("hi"))).groupBy(*[F.col(f"t.{k}").alias(k) for k in keys], "name").agg(F.min("_v").alias("z"))
    out = out.alias("a").join(above.alias("b"), _same("a", "b", keys) & (F.col("a.name") == F.col("b.name")), "left").select("a.*", F.coalesce("a.y", "b.z").alias("next"))
    value = F.when((F.col("part") == 0) | F.col("next").isNull(), F.col("x")).otherwise(F.col("x") * (1 - F.col("part")) + F.col("next") * F.col("part"))
    wide = [F.max(F.when(F.col("name") == n, value)).alias(n) for n in shares]
    return out.groupBy(*keys).agg(*wide)


def aggregated(df: DataFrame, keys: list[str], aggregates: list[Column], quantiles: dict[str, tuple[str, float]], most: int = MOST) -> DataFrame:
    """``df`` grouped by ``keys`` with ``aggregates`` and ``quantiles``, by name (column, share)."""
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= most:
        return df.groupBy(*keys).agg(*aggregates, *[F.percentile(c, F.lit(p)).alias(n) for n, (c, p) in quantiles.items()])
    return df.groupBy(*keys).agg(*aggregates).alias("a").join(exact(df, keys, quantiles, most).alias("b"), _same("a", "b", keys)).select("a.*", *[f"b.{n}" for n in quantiles])
