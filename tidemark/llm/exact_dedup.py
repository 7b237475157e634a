"""Exact dedup by deterministic block naming.

Normalised texts are cut into fixed-size blocks.  The distinct blocks are sorted, and their places in that order are their integer
names.  Adjacent names are then paired, the distinct pairs sorted and named in the same way, level by level, until each
document has a single name.  The identity (level, name) is collision-free: a name stands for one content and no other.

Blocks are sorted by (64-bit hash, content).  Contents move once, pre-aggregated on the map side, so a text that a third
of all documents share is sent once per map task, to find hashes of several contents (there are hardly any) and rank these; what is
sorted is (hash, rank).  A sort is by ranges; the number of a row within its range and the number of the range make the name,
so names ascend over the whole table without passing through one task.

Edge cases: a null text is empty; empty texts equal one another; null ids sort after all others;
of repeated rows (same id, same text) exactly one is kept; an empty table gives an empty table; texts of any length are read whole;
other columns, whatever their names, aren't read, and drop_copies returns them as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import frozen, id_order, normalised, numbered

BLOCK_CHARS = 2048


def _ranks(items: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """(content, rank) of the contents in ``items.blocks`` whose hash has other contents too; mostly empty."""
    distinct = items.select(F.explode("blocks").alias("content")).distinct().withColumn("h", hashed(F.col("content")))
    crowded = frozen(distinct.groupBy("h").count().where("count > 1").select("h"), "crowded")
    if crowded.isEmpty():
        return crowded
    rank = F.row_number().over(Window.partitionBy("h").orderBy("content")) - 1
    return frozen(distinct.join(crowded, "h").select("content", rank.alias("r")), "ranks")


def _keyed(items: DataFrame, hashed: Callable[[Column], Column], ranks: DataFrame) -> DataFrame:
    """Replace ``blocks`` by ``keys``, their (hash, rank); where hashes collide, ranks come from a join."""
    if ranks.columns == ["h"]:
        return items.withColumn("keys", F.transform("blocks", lambda c: F.struct(hashed(c).alias("a"), F.lit(0).cast("long").alias("b")))).drop("blocks")
    each = items.select("_row", F.posexplode("blocks").alias("pos", "content")).join(ranks, "content", "left")
    each = each.select("_row", F.struct("pos", hashed(F.col("content")).alias("a"), F.coalesce("r", F.lit(0)).cast("long").alias("b")).alias("n"))
    lists = each.groupBy("_row").agg(F.array_sort(F.collect_list("n")).alias("n"))
    lists = lists.select("_row", F.transform("n", lambda n: F.struct(n["a"].alias("a"), n["b"].alias("b"))).alias("keys"))
    return items.drop("blocks").join(lists, "_row")


def _names(keys: DataFrame) -> DataFrame:
    """(a, b, name): the distinct keys in ascending order, with integers that ascend with them."""
    ordered = keys.distinct().repartitionByRange("a", F.col("b").asc_nulls_first()).sortWithinPartitions("a", F.col("b").asc_nulls_first())
    return frozen(ordered.withColumn("name", F.monotonically_increasing_id()), "names")


def _named(items: DataFrame) -> DataFrame:
    """(_row, names) from (_row, keys)."""
    each = items.select("_row", F.posexplode("keys").alias("pos", "key")).select("_row", "pos", "key.a", "key.b")
    names = _names(each.select("a", "b"))
    at = each.join(names.withColumnRenamed("a", "_a").withColumnRenamed("b", "_b"), (F.col("a") == F.col("_a")) & F.col("b").eqNullSafe(F.col("_b")))
    lists = at.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("n"))
    return frozen(lists.select("_row", F.transform("n", lambda n: n["name"]).alias("names")), "named")


def _pairs(names: Column) -> Column:
    """Adjacent names two by two; a last odd one pairs with null."""
    count = F.floor((F.size(names) - 1) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), count), lambda i: F.struct(F.get(names, i * 2).alias("a"), F.get(names, i * 2 + 1).alias("b")))


def identities(rows: DataFrame, block_chars: int = BLOCK_CHARS, hashed: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (_row, doc_id, text): (_row, doc_id, text_sha256), written, and (_row, level, name); equal (level, name) if and only if equal texts.

    ``hashed`` may be any deterministic hash, even a poor one: it only decides how much the ranks have to settle.
    """
    own = rows.select("_row", "doc_id", normalised(F.col("text")).alias("_norm"))
    blocks = F.regexp_extract_all("_norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    cut = own.select("_row", "doc_id", "_norm", F.when(F.col("_norm") == "", F.array(F.lit(""))).otherwise(blocks).alias("blocks"))
    keyed = _keyed(cut.select("_row", "doc_id", F.sha2("_norm", 256).alias("text_sha256"), "blocks"), hashed, _ranks(cut.select("blocks"), hashed))
    written = frozen(keyed, "keys")
    items, level, done = written.select("_row", "keys"), 0, []
    while True:
        named = _named(items)
        done.append(named.where(F.size("names") == 1).select("_row", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        items = named.where(F.size("names") > 1).select("_row", _pairs(F.col("names")).alias("keys"))
        if items.isEmpty():
            break
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return written.select("_row", "doc_id", "text_sha256"), out


def _dedup(rows: DataFrame, **how) -> DataFrame:
    own, named = identities(rows, **how)
    named = named.join(own, "_row")
    groups = named.groupBy("level", "name").agg(F.min(id_order(F.col("doc_id"), F.col("_row"))).alias("first"), F.count("*").alias("group_size"))
    # written, so that the join reads plain shuffles on both sides, and a partition with a large group can be split
    joined = named.join(frozen(groups, "groups"), ["level", "name"])
    return joined.select("_row", "doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("_row") == F.col("first.row")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """One row per row of ``docs``: _row, doc_id, keep_id, group_size, kept, text_sha256."""
    return _dedup(numbered(docs).select("_row", F.col("doc")[doc_id].alias("doc_id"), F.col("doc")[text].alias("text")), **how)


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = numbered(docs)
    gone = _dedup(rows.select("_row", F.col("doc")[doc_id].alias("doc_id"), F.col("doc")[text].alias("text"))).where("not kept").select("_row")
    return rows.join(frozen(gone, "gone"), "_row", "left_anti").select("doc.*")
