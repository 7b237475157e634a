"""Mixing sources to target weights.

Tokens are aggregated per source; targets follow the weights, and stop at ``max_repeats`` times a
source's size, the excess going to the others by weight.  That fixed point has a closed form: with the
sources in order of cap over weight, the first k are capped and the rest share what is left by weight;
running sums over the table of sources find k.  The repetition rate is target over size, and each document
is emitted floor(rate) times plus once more if its hash-seeded uniform draw is below the fraction.

Only (source, size) pairs are shuffled, pre-aggregated on the map side: a source with a third of all rows
costs one row per map task.  The rates join back as a table of sources.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; sources of size 0 have
target 0 and rate 0; draws depend on doc_id and seed alone, so repeated rows share their draw, and
so do rows with a null id; texts of any length are read whole; other columns keep their names and values, whatever they are called; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, frozen

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
SEED = "mix-1"


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A draw in [0, 1) from the first 52 bits of MD5(doc_id:seed), the same on each run."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row per source, a table of sources only."""
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int"))
    t = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * max_repeats).alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.select("*", F.sum("source_size").over(everything).alias("total"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"), F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("open_w"))
    # the level that would hold if this source and all later ones were open; the first that fits is the level
    t = t.withColumn("level", (F.lit(share) * F.col("total") - F.col("capped")) / F.col("open_w"))
    fits = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("capped", "level"))).over(everything)
    target = F.least(F.col("cap").cast("double"), F.coalesce(fits["level"] * F.col("w"), F.col("cap").cast("double")))
    return t.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = SEED, **how) -> DataFrame:
    """Each row of ``docs`` (id, source) with size, source_size, target and copies, the times that the mix takes it."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    sizes = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    # written, so that the planner knows its size and broadcasts it only below its threshold
    shares = frozen(targets(sizes, **how), "targets").withColumnRenamed("source", "_of")
    joined = own.join(shares, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (uniform(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("int")
    return joined.withColumn("copies", (F.floor(rate) + extra).cast("int"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    taken = mix(docs, **how).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("doc.*")
