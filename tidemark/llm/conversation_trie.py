"""Prefix trie of conversations: every distinct sequence of first turns is a node, with counts over its subtree.

A conversation's prefixes are named by running digests, and the least conversation with a prefix owns its node.  A conversation that owns a
prefix owns all its longer ones too, so what it owns is a chain that ends with its last turn.  The depth where the chain begins is found by
binary search: in each round all open conversations probe the middle of their interval in the table of prefix minima.  Chains, each with
the place where it hangs on another one, are the tree.  Totals over subtrees go bottom-up from chain to chain; ancestors double their distance
each round, so a tree of height h takes log2(h) rounds.

Nothing gathers a conversation: rows are placed by a range sort of the whole table, running values are taken in chunks of CHUNK turns with the
totals of chunks before them, minima and counts are pre-aggregated.  The digest of the ids that end at a node reads packs of up to 256 ids in order,
as a SHA-256 must; memory stays that of one batch.

Edge cases: rows with a null conv_id take no part; a null turn comes first; equal turns are ordered by the MD5 of role and text, so repeated rows are turns
of their own; null role and text are empty; conversations without turns count as members of the root; an empty table has no nodes; long texts are
digested whole; other columns aren't read.  Prefixes are compared by their depth and 128 bits of digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, frozen, numbered, words_of

CHUNK = 1024
#: Ids in a pack: 2 to this power.
PACK_BITS = 8


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, a, b, words), written: the turns of each conversation from place 0, their digest and number of words."""
    of = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    digest = F.md5(F.concat(F.char_length(of(role)).cast("string"), F.lit(":"), of(role), of(text)))
    half = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    own = conversations.where(F.col(f"`{conv_id}`").isNotNull()).select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.size(words_of(F.col(f"`{text}`"))).cast("long").alias("words"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ordered = frozen(own.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", half(1).alias("a"), half(16).alias("b"), "words"), "ordered")
    rows = numbered(ordered).select("_row", "doc.*")
    first = rows.groupBy("conv_id").agg(F.min("_row").alias("_first"))
    out = frozen(rows.join(first, "conv_id").select("conv_id", (F.col("_row") - F.col("_first")).alias("place"), "a", "b", "words"), "turns")
    discard(ordered)
    return out


def grafted(placed: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings, made of ``placed`` turns: conversation c begins with the first h turns of c - c % ``every`` instead of its own, where
    h = crc32(c) % ``most``.  Returns (conv_id, n), written, with the number of turns of each, and (conv_id, depth, a, b, words)."""
    counts = placed.groupBy("conv_id").agg(F.count("*").alias("own"))
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    convs = counts.select("conv_id", "own", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    have = counts.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    taken = F.least("h", F.coalesce("base_own", F.lit(0)))
    convs = convs.join(have, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    convs = frozen(convs, "conversations")
    own = placed.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place >= h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h") + 1).alias("depth"), "a", "b", "words")
    lent = placed.where(F.col("place") < most).withColumnRenamed("conv_id", "base").join(convs.select("base", "conv_id", "taken"), "base").where("place < taken")
    return convs, own.unionByName(lent.select("conv_id", (F.col("place") + 1).alias("depth"), "a", "b", "words"))


def whole(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same tables for conversations as they are."""
    convs = frozen(placed.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    return convs, placed.select("conv_id", (F.col("place") + 1).alias("depth"), "a", "b", "words")


def running(rows: DataFrame, values: dict[str, tuple], backwards: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``rows`` (conv_id, depth, ...) with columns named by ``values``: (aggregate, column) over this row and those before it, or after it if ``backwards``.
    An aggregate joins the totals of chunks with those within a chunk, so it must be associative: sum or bit_xor."""
    own = rows.withColumn("_c", F.floor(F.col("depth") / chunk))
    toward = lambda c: F.col(c).desc() if backwards else F.col(c).asc()
    here = Window.partitionBy("conv_id", "_c").orderBy(toward("depth")).rowsBetween(Window.unboundedPreceding, 0)
    others = Window.partitionBy("conv_id").orderBy(toward("_c")).rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("conv_id", "_c").agg(*[f(c).alias(f"_t_{n}") for n, (f, c) in values.items()])
    before = totals.select("conv_id", "_c", *[f(F.col(f"_t_{n}")).over(others).alias(f"_b_{n}") for n, (f, _) in values.items()])
    before = before.where(F.greatest(*[F.col(f"_b_{n}").isNotNull() for n in values], F.lit(False)))
    both = own.withColumns({n: f(c).over(here) for n, (f, c) in values.items()}).join(before, ["conv_id", "_c"], "left")

    def joined(n: str, f) -> Column:
        rest = F.coalesce(F.col(f"_b_{n}"), F.lit(0).cast("long"))
        return F.col(n).bitwiseXOR(rest) if f is F.bit_xor else F.col(n) + rest

    return both.select(*rows.columns, *[joined(n, f).alias(n) for n, (f, _) in values.items()])


def prefixes(own_turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p, q, words), written: p and q name the sequence of the turns up to ``depth``."""
    term = lambda seed: F.xxhash64("a", "b", "depth", F.lit(seed))
    named = running(own_turns, {"p": (F.bit_xor, term(1)), "q": (F.bit_xor, term(2))})
    return frozen(named.select("conv_id", "depth", "p", "q", "words"), "prefixes")


def minima(own_prefixes: DataFrame) -> DataFrame:
    """(depth, p, q, owner, n_convs, words), written: a row per prefix, with the least conversation that has it."""
    return frozen(own_prefixes.groupBy("depth", "p", "q").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("words").alias("words")), "minima")


def first_owned(convs: DataFrame, own_prefixes: DataFrame, least: DataFrame, root: int) -> list[DataFrame]:
    """Parts of (conv_id, n, first, parent), written: the least depth that each conversation with turns owns, n + 1 if none, and the owner of the prefix before
    that.  The owner is known from the last probe that another conversation won."""
    start = F.lit(1).cast("long")
    todo = convs.where("n > 0").select("conv_id", "n", start.alias("lo"), (F.col("n") + 1).alias("hi"), F.lit(root).cast("long").alias("parent"))
    parts = []
    while True:
        probes = todo.withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2))
        met = probes.join(own_prefixes.select("conv_id", "depth", "p", "q"), ["conv_id", "depth"]).join(least.select("depth", "p", "q", "owner"), ["depth", "p", "q"])
        mine = F.col("owner") == F.col("conv_id")
        after = met.select("conv_id", "n", F.when(mine, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(mine, F.col("depth")).otherwise(F.col("hi")).alias("hi"), F.when(mine, F.col("parent")).otherwise(F.col("owner")).alias("parent"))
        parts.append(frozen(after, "search"))
        todo = parts[-1].where("lo < hi")
        if todo.isEmpty():
            return parts


def totals(chains: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """(conv_id, up, *sums), written: ``chains`` of the same columns, where ``up`` is the chain one hangs on or null, with sums over all
    chains below too.  After k rounds a sum covers the nearest 2^k generations, and ``up`` points 2^k generations up."""
    state = frozen(chains, "totals")
    while not state.where("up is not null").isEmpty():
        given = state.where("up is not null").groupBy("up").agg(*[F.sum(c).alias(f"_{c}") for c in sums]).withColumnRenamed("up", "conv_id")
        above = state.select(F.col("conv_id").alias("up"), F.col("up").alias("_up"))
        new = state.join(above, "up", "left").join(given, "conv_id", "left").select("conv_id", F.col("_up").alias("up"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums])
        state, old = frozen(new, "totals"), state
        discard(old)
    return state


def prefix_tree(convs: DataFrame, own_turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (conv_id, n) and (conv_id, depth, a, b, words), the nodes and the ends, both written.

    Nodes: conv_id (the owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, p, q.  A node's turn is turn ``depth`` of its owner.
    Ends: (conv_id, depth, p, q) of each conversation's last node."""
    root, count = convs.agg(F.min("conv_id"), F.count("*")).first()
    named = prefixes(own_turns)
    least = minima(named)
    zero = F.lit(0).cast("long")
    top = convs.where(F.col("conv_id") == F.lit(root)).select(zero.alias("depth"), zero.alias("p"), zero.alias("q"), F.col("conv_id").alias("owner"), F.lit(count).alias("n_convs"), zero.alias("words"))
    nodes = least.unionByName(top).select(F.col("owner").alias("conv_id"), "depth", "p", "q", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    parts = first_owned(convs, named, least, root or 0)
    found = parts[0].where("lo = hi")
    for x in parts[1:]:
        found = found.unionByName(x.where("lo = hi"))
    hung = found.where((F.col("lo") <= F.col("n")) & (F.col("conv_id") != F.lit(root))).select("conv_id", "n", F.col("lo").alias("first"), "parent")
    head = convs.where(F.col("conv_id") == F.lit(root)).select("conv_id", "n", zero.alias("first"), F.lit(None).cast("long").alias("parent"))
    chains = frozen(hung.unionByName(head), "chains")
    discard(*parts)
    # what chains carry themselves, then with all that hangs on them
    places = chains.where("parent is not null").select(F.col("parent").alias("_at"), (F.col("first") - 1).alias("_depth")).distinct()
    ends_in_leaf = chains.join(places, (F.col("conv_id") == F.col("_at")) & (F.col("n") == F.col("_depth")), "left").select("conv_id", F.col("parent").alias("up"), F.col("_at").isNull().cast("long").alias("leaves"))
    saved = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"))
    own = frozen(ends_in_leaf.join(saved, "conv_id"), "own")
    below = totals(own, ("leaves", "saved"))
    attached = chains.where("parent is not null").join(below.drop("up"), "conv_id").groupBy(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("depth"))
    attached = attached.agg(F.count("*").alias("_chains"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    ours = chains.join(own.select("conv_id", "leaves"), "conv_id")
    each = nodes.join(attached, ["conv_id", "depth"], "left").join(ours, "conv_id")
    nought = lambda c: F.coalesce(F.col(c), zero)
    last = F.col("depth") == F.col("n")
    each = each.select("conv_id", "depth", "p", "q", "n_convs", F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), (nought("_chains") + (~last).cast("long")).alias("n_children"), (nought("_leaves") + F.when(last, F.col("leaves")).otherwise(zero)).alias("_l"), (nought("_saved") + F.col("saved")).alias("_s"))
    out = running(each, {"n_leaves": (F.sum, F.col("_l")), "saved_tokens": (F.sum, F.col("_s"))}, backwards=True)
    out = frozen(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "p", "q"), "trie")
    last_prefix = convs.where("n > 0").select("conv_id", F.col("n").alias("depth")).join(named.select("conv_id", "depth", "p", "q"), ["conv_id", "depth"])
    ends = frozen(last_prefix.unionByName(convs.where("n = 0").select("conv_id", zero.alias("depth"), zero.alias("p"), zero.alias("q"))), "ends")
    discard(named, least, chains, own, below)
    return out, ends


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p, q, ends_sha256): the SHA-256 of the ascending, comma-joined ids of the conversations that end at a node."""
    node = ["depth", "p", "q"]
    packs = ends.groupBy(*node, F.shiftright("conv_id", PACK_BITS).alias("pack")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    packs = packs.select(*node, "pack", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")).repartition(*node).sortWithinPartitions(*node, "pack")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for b in batches:
            out = []
            for own, ids in zip(zip(b["depth"], b["p"], b["q"], strict=True), b["ids"], strict=True):
                if own == key:
                    digest.update(b"," + ids.encode())
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=[*node, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=[*node, "ends_sha256"])

    return packs.mapInPandas(run, "depth long, p long, q long, ends_sha256 string")
