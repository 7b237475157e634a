"""Bootstraps and permutations of keys of any size.

Values are dealt to pages, so that no key is a task.  A bootstrap draws exactly n values a round, a permutation exactly as many as its first group has; how many of a
round's draws fall to a page follows from a binary tree over the key's pages: at each node the draws split between its two halves by a binomial (with
replacement) or a hypergeometric (without).  A node's split comes from a random stream of (seed, key, node), so each page finds its own counts on its way
down from the root and results don't depend on partitions.  Pages then draw from their own values, and sums meet by round.

Moving and stationary blocks are n values exactly too: fixed lengths from n - b + 1 starts, or geometric lengths around a circle; the last block of a
round is cut.  A block's sum is the difference of two prefix sums of (x, x^2) by position.  Positions come from a scan over chunks of time; rounds draw
their blocks in groups, both ends are dealt to pages by position, looked up there and summed by round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.chunks import chunked

#: Values of a page, about.
PAGE = 16_384
#: Draws that a task makes at a time.
DRAWS = 2_000_000


def keyed(df: DataFrame, keys: list[str], column: str, *others: Column | str) -> DataFrame:
    """(_key, _x, ...): values that aren't null, and their keys as text, null keys too."""
    key = F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("{}")
    return df.where(F.col(column).isNotNull()).select(key.alias("_key"), F.col(column).cast("double").alias("_x"), *others)


def stream(seed: int, key: str, *node: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(key.encode()), *node])


def paths(pages: DataFrame) -> DataFrame:
    """(_key, page, n, path) of pages (_key, page, n): for each node from the root down, its level and number, the values below it and those of
    its left half, and 1 if the page lies right.  One row per page is looked at."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("page")
        page, n = b["page"].to_numpy(), b["n"].to_numpy()
        before = np.append(0, np.cumsum(n))
        levels = int(page.max()).bit_length()
        lookup = lambda p: before[np.searchsorted(page, p)]
        found = []
        for level in range(levels, 0, -1):
            node = page >> level
            lo, mid, hi = lookup(node << level), lookup((node << level) + (1 << level - 1)), lookup((node + 1) << level)
            found.append(np.stack([np.full(len(page), level), node, hi - lo, mid - lo, page >> level - 1 & 1]))
        whole = np.stack(found).transpose(2, 0, 1).reshape(len(page), -1) if found else np.zeros((len(page), 0), np.int64)
        return b.assign(path=list(whole.astype(np.int64)))

    return pages.groupBy("_key").applyInPandas(run, "_key string, page long, n long, path array<long>")


def counts(seed: int, key: str, path: np.ndarray, draws: np.ndarray, replaced: bool) -> np.ndarray:
    """How many of the ``draws`` of each round fall to a page."""
    for level, node, total, left, right in np.asarray(path, np.int64).reshape(-1, 5).tolist():
        rng = stream(seed, key, level, node)
        if left == 0 or left == total:
            taken = draws * (left > 0)
        elif replaced:
            taken = rng.binomial(draws, left / total)
        else:
            taken = rng.hypergeometric(left, total - left, draws)
        draws = draws - taken if right else taken
    return draws


def _sums(rng: np.random.Generator, x: np.ndarray, n: np.ndarray, draws: np.ndarray, replaced: bool) -> np.ndarray:
    """Per round the sum and sum of squares of ``draws`` of the values x, of which there are n each."""
    size = int(n.sum())
    out = np.zeros((2, len(draws)))
    each = np.repeat(x, n) if size <= 4 * PAGE else None
    for r, c in enumerate(draws.tolist()):
        if each is not None and replaced:
            v = each[rng.integers(0, size, c)]
            out[:, r] = v.sum(), v @ v
        elif each is not None:
            v = each[rng.choice(size, c, replace=False, shuffle=False)]
            out[:, r] = v.sum(), v @ v
        else:  # few values, each very often
            k = rng.multinomial(c, n / size) if replaced else rng.multivariate_hypergeometric(n, c, method="marginals")
            out[:, r] = k @ x, k @ (x * x)
    return out


def drawn(values: DataFrame, sizes: DataFrame, draws: Column, rounds: int, seed: int, replaced: bool) -> DataFrame:
    """(_key, round, s, q): per round the sum and sum of squares of ``draws`` of a key's values, from values (_key, _x) and sizes (_key, n, ...).
    Pages are dealt by the hash of a value; equal values are counted first."""
    placed = values.join(sizes.select("_key", "n", draws.cast("long").alias("_draws")), "_key")
    page = F.pmod(F.xxhash64("_x"), F.ceil(F.col("n") / PAGE))
    counted = placed.groupBy("_key", "_draws", page.alias("page"), "_x").agg(F.count("*").alias("times"))
    tree = paths(counted.groupBy("_key", "page").agg(F.sum("times").alias("n")))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("_x")
        key, page = b["_key"].iloc[0], int(b["page"].iloc[0])
        own = counts(seed, key, b["path"].iloc[0], np.full(rounds, b["_draws"].iloc[0]), replaced)
        s, q = _sums(stream(seed, key, 0, page), b["_x"].to_numpy(), b["times"].to_numpy(), own, replaced)
        return pd.DataFrame({"_key": key, "round": np.arange(rounds), "s": s, "q": q})

    joined = counted.join(tree.select("_key", "page", "path"), ["_key", "page"])
    found = joined.groupBy("_key", "page").applyInPandas(run, "_key string, round int, s double, q double")
    return found.groupBy("_key", "round").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))


# --- blocks ---


def blocks_of(rng: np.random.Generator, n: int, size: float, circular: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the blocks of one round, n values in all."""
    if circular:
        lengths, total = [], 0
        while total < n:
            more = rng.geometric(min(1.0, 1.0 / max(size, 1.0)), max(16, int((n - total) / max(size, 1.0) * 1.1)))
            lengths.append(more)
            total += int(more.sum())
        lengths = np.concatenate(lengths)
        ends = np.cumsum(lengths)
        last = int(np.searchsorted(ends, n))
        lengths = lengths[: last + 1].copy()
        lengths[-1] -= int(ends[last]) - n
        return rng.integers(0, n, len(lengths)), lengths
    b = min(max(int(size), 1), n)
    lengths = np.full(-(-n // b), b)
    lengths[-1] -= int(lengths.sum()) - n
    return rng.integers(0, n - b + 1, len(lengths)), lengths


def ends_of(starts: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions whose prefix sums (of all values before them) make up the blocks, their signs, and how often the whole series is in besides."""
    stop = starts + lengths
    return np.concatenate([starts, stop % n]), np.concatenate([np.full(len(starts), -1, np.int8), np.ones(len(stop), np.int8)]), int((stop // n).sum())


def positions(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(_key, _x, at): values with their places from 0 in the order of ts, by counts of chunks of time."""
    own = chunked(keyed(df, keys, column, "ts"), ["_key"])
    n = own.groupBy("_key", "_chunk").agg(F.count("*").alias("_n"))
    first = n.select("_key", "_chunk", F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_key", "_chunk").orderBy("ts", "_x")) - 1
    return own.withColumn("_i", place).join(first, ["_key", "_chunk"]).select("_key", "_x", (F.col("_first") + F.col("_i")).alias("at"))


def drawn_blocks(placed: DataFrame, sizes: DataFrame, size: Column, circular: bool, rounds: int, seed: int) -> DataFrame:
    """(_key, round, s, q) of resamples by blocks, from positions() and sizes (_key, n, ...)."""
    packed = placed.groupBy("_key", F.floor(F.col("at") / PAGE).alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "_x"))), lambda v: v["_x"]).alias("x"), F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_q"))
    before = Window.partitionBy("_key").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key")
    offsets = packed.select("_key", "page", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0.0)).alias(f"{c}0") for c in "sq"], *[F.sum(f"_{c}").over(whole).alias(f"{c}1") for c in "sq"])
    pages = packed.drop("_s", "_q").join(offsets, ["_key", "page"])
    # rounds draw in groups of about DRAWS blocks
    groups = F.least(F.lit(rounds), F.ceil(F.col("n") / F.greatest(size, F.lit(1.0)) * rounds / DRAWS)).cast("int")
    asked = sizes.select("_key", "n", size.cast("double").alias("size"), groups.alias("groups"))
    asked = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).repartition("_key", "group")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, n, size, groups, group in b[["_key", "n", "size", "groups", "group"]].itertuples(index=False):
                at, sign, of = [], [], []
                for r in range(group * rounds // groups, (group + 1) * rounds // groups):
                    ends, signs, laps = ends_of(*blocks_of(stream(seed, key, r), n, size, circular), n)
                    # whole laps are looked up on page 0, as positions below 0
                    at += [ends, np.full(laps, -1)]
                    sign += [signs, np.ones(laps, np.int8)]
                    of.append(np.full(len(ends) + laps, r))
                at, sign, of = np.concatenate(at), np.concatenate(sign), np.concatenate(of)
                page = np.maximum(at, 0) // PAGE
                order = np.argsort(page, kind="stable")
                cuts = np.flatnonzero(np.diff(page[order], prepend=-1))
                for own in np.split(order, cuts[1:]):
                    yield pd.DataFrame({"_key": [key], "page": [page[own[0]]], "at": [at[own].astype("<i8").tobytes()], "sign": [sign[own].tobytes()], "of": [of[own].astype("<i4").tobytes()]})

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for w in b.itertuples(index=False):
                at, sign, of = np.frombuffer(w.at, "<i8"), np.frombuffer(w.sign, np.int8), np.frombuffer(w.of, "<i4")
                x, first, place = np.asarray(w.x), of.min(), at - w.page * PAGE
                sums = []
                for v, lower, total in ((x, w.s0, w.s1), (x * x, w.q0, w.q1)):
                    prefix = lower + np.append(0.0, np.cumsum(v))
                    sums.append(np.bincount(of - first, np.where(at < 0, total, prefix[np.maximum(place, 0)]) * sign))
                yield pd.DataFrame({"_key": w._0, "round": np.arange(first, first + len(sums[0]), dtype=np.int32), "s": sums[0], "q": sums[1]})

    dealt = asked.mapInPandas(deal, "_key string, page long, at binary, sign binary, of binary")
    found = dealt.join(pages, ["_key", "page"]).select("_key", "at", "sign", "of", "page", "x", "s0", "s1", "q0", "q1").mapInPandas(look_up, "_key string, round int, s double, q double")
    return found.groupBy("_key", "round").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
