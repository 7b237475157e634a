"""Merkle fixity audit of WARC records.

A replica is a table of records with integer ids.  Records of 4096 consecutive ids form an archive file, in the order of ids,
and have byte offsets in it.  A leaf is the SHA-256 of a record; a node of level l covers 16**l consecutive ids, and so an ordered range
of offsets.  It hashes its children in order, each with its number, its length in bytes and its digest: lengths fix the offsets within the
node, while a longer, shorter or lost record elsewhere leaves the digest as it was.  The topmost node is the root.  Since a node is found from
an id by division, trees are built by grouping, 16 children at most in a group.

An audit compares roots, and then level by level only the children of nodes that differ: a damaged record costs 16 nodes a level.  The levels
are written, with a row per node, so descending reads what it needs by joins on (level, node).

Edge cases: records with a null id get ids from 2**52 on by their hash; records with one id, such as repeated rows, share a
leaf, the hash of their sorted hashes and counts; null urls and bodies are empty; records of any length are hashed whole; other columns, whatever
their names, aren't read; empty replicas have no root and are equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import frozen

#: Children of a node and records of an archive file, as powers of two: 16 and 4096.
FANOUT_BITS = 4
SHARD_BITS = 12
FANOUT = 1 << FANOUT_BITS
#: Where the ids of records without one begin.
UNNUMBERED = 1 << 52


def record(page_id: Column, url: Column, body: Column) -> Column:
    """A WARC resource record as a string; its length in bytes is that of its UTF-8."""
    body = F.coalesce(body, F.lit(""))
    head = [F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string")]
    return F.concat(*head, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def replica(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(page_id, record), written to the shared folder."""
    return frozen(pages.select(F.col(page_id).cast("long").alias("page_id"), record(F.col(page_id), F.col(url), F.col(body)).alias("record")), "replica")


@dataclass
class Tree:
    """Written levels, leaves first: (node, length, digest), the leaves with their place in the archive file besides."""

    levels: list[DataFrame]


def leaves(records: DataFrame) -> DataFrame:
    """(node, length, first, end, digest, shard): one leaf per id."""
    own = records.select("page_id", F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("length"))
    node = F.coalesce("page_id", UNNUMBERED + F.conv(F.substring("digest", 1, 12), 16, 10).cast("long"))
    # repeated records are counted before they meet; an id's records meet in four sums of parts of their digests, each taken with its count
    own = own.groupBy(node.alias("node"), "digest").agg(F.count("*").alias("n"), F.sum("length").alias("length"))
    own = own.withColumn("with_n", F.sha2(F.concat_ws("x", "digest", "n"), 256))
    parts = [F.bit_xor(F.conv(F.substring("with_n", at, 15), 16, 10).cast("long")) for at in (1, 16, 31, 46)]
    one = F.concat_ws(",", F.count("*"), F.sum("n"), *parts)
    digest = F.when((F.count("*") == 1) & (F.sum("n") == 1), F.min("digest")).otherwise(F.sha2(one, 256))
    own = own.groupBy("node").agg(digest.alias("digest"), F.sum("length").alias("length"))
    shard = F.shiftright("node", SHARD_BITS)
    end = F.sum("length").over(Window.partitionBy("shard").orderBy("node"))
    return own.withColumn("shard", shard).select("node", "length", (end - F.col("length")).alias("first"), end.alias("end"), "digest", "shard")


def tree(own: DataFrame, low: int | None, high: int | None) -> Tree:
    """The tree over written leaves, up to the level where the ids from ``low`` to ``high`` have one node."""
    levels = [own]
    # ids of both signs keep two topmost nodes
    while low is not None and low >> FANOUT_BITS * (len(levels) - 1) != high >> FANOUT_BITS * (len(levels) - 1) and FANOUT_BITS * len(levels) < 64:
        levels.append(frozen(_parents(levels[-1]), f"level{len(levels)}"))
    return Tree(levels)


def _parents(level: DataFrame) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("node", "length", "digest")))
    shown = F.transform(children, lambda c: F.concat_ws(":", c["node"], c["length"], c["digest"]))
    return level.groupBy(F.shiftright("node", FANOUT_BITS).alias("node")).agg(F.sum("length").alias("length"), F.sha2(F.concat_ws(",", shown), 256).alias("digest"))


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node, a, b): nodes whose digests differ, or that one side lacks; of leaves with their rows."""
    left = a.select("node", F.struct(*a.columns).alias("a"))
    right = b.select("node", F.struct(*b.columns).alias("b"))
    return left.join(right, "node", "full_outer").where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))


def descend(a: Tree, b: Tree) -> list[DataFrame]:
    """The nodes that differ, from the roots down to the leaves; of each level only children of the last one's are compared."""
    found = [frozen(_differing(a.levels[-1], b.levels[-1]), "differing")]
    for x, y in zip(a.levels[-2::-1], b.levels[-2::-1], strict=True):
        under = found[-1].select(F.col("node").alias("_up"))
        x, y = (t.withColumn("_up", F.shiftright("node", FANOUT_BITS)).join(under, "_up", "left_semi").drop("_up") for t in (x, y))
        found.append(frozen(_differing(x, y), "differing"))
    return found


def audit(records: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves of ``records``, and (page_id, first, end, status): leaves of ``records`` (page_id, record) that are changed or missing in ``other``, and those
    that only ``other`` has (added), with their offsets in their archive files."""
    sides = [frozen(leaves(x), "leaves") for x in (records, other)]
    ends = sides[0].select("node").unionByName(sides[1].select("node")).agg(F.min("node"), F.max("node")).first()
    found = descend(*(tree(x, ends[0], ends[1]) for x in sides))[-1]
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").otherwise("changed")
    return sides[0], found.select(F.col("node").alias("page_id"), F.coalesce("a.first", "b.first").alias("first"), F.coalesce("a.end", "b.end").alias("end"), status.alias("status"))


def audited(records: DataFrame, other: DataFrame) -> DataFrame:
    """Every leaf of ``records``: page_id, shard, first, end, sha256, status (ok, changed or missing)."""
    own, located = audit(records, other)
    located = located.where("status <> 'added'").select(F.col("page_id").alias("node"), "status")
    own = own.join(located, "node", "left")
    return own.select(F.col("node").alias("page_id"), "shard", F.col("first").alias("first_byte"), F.col("end").alias("end_byte"), F.col("digest").alias("sha256"), F.coalesce("status", F.lit("ok")).alias("status"))
