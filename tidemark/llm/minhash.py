"""MinHash banding with exact verification, shared by the joins on word shingles.

1. Each text becomes the set of its shingles of ``k`` words (64-bit hashes) and one hash per band of its MinHash signature.
2. Texts with equal shingle sets form one class; only its representative goes on, with the number of its copies.
3. Representatives are grouped by band hash.  Buckets of one member fall away, and of buckets with the same members one stays.
4. A bucket is dealt to blocks of about ``BLOCK`` members and about ``BLOCK_SHINGLES`` shingles at most; a task compares two
   blocks, so no task holds a whole large bucket, whatever the length of its texts.  Intersections of the full sets come from products of 0/1 matrices.  A pair that shares several buckets counts in the first
   of them.  Blocks of few members, the most by far, are compared many at once, by sorting.  A task returns, for each member, its number of links and one parent: a spanning forest, never the pairs.
5. The forests' edges give the components.

A pair of similarity s meets in some band with probability 1 - (1 - s**rows)**bands; ``choose_bands`` takes the most rows a band for
which that is at least the target recall at the threshold.  Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, frozen
from tidemark.llm.components import components

WORDS = 5
THRESHOLD = Fraction(4, 5)
RECALL = 0.9999
BLOCK = 512
BLOCK_SHINGLES = 1_000_000
COLUMNS = 8192
#: Blocks of up to so many members are compared together, until they hold so many shingles.
FEW = 32
TOGETHER = 200_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float = RECALL, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows a band): the most rows with which the target recall takes at most ``most_hashes`` hashes."""
    found = (1, 1)
    for rows in range(1, 17):
        miss = 1 - float(threshold) ** rows
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(miss)))
        if bands * rows <= most_hashes:
            found = bands, rows
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * GOLDEN
    return x ^ (x >> np.uint64(29))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, from the words' hashes; of all words if there are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    k, out = min(k, n), np.zeros(max(1, n - k + 1), np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : n - k + 1 + j]) * GOLDEN
        out ^= out >> np.uint64(32)
    return mixed(out + np.uint64(k))


class _Powers:
    """Powers of an odd number modulo 2**64 and their inverses, as far as the longest text so far needs."""

    base = 0xD6E8FEB86659FD93

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            run = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]))
            self.up, self.down = run(self.base), run(pow(self.base, -1, 2**64))
        return self.up, self.down


@lru_cache
def _tables() -> tuple[np.ndarray, _Powers]:
    """A random-looking number for each code point, and powers."""
    return mixed(mixed(np.arange(1, 0x110001, dtype=np.uint64) * GOLDEN)), _Powers()


def located_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the words, and the code points of the text.

    A word's hash is a polynomial in its characters' numbers, from sums over the whole text at once: terms carry the power of their place
    in the text, and the power of the word's start is divided out."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    white = np.ones(len(points) + 2, bool)
    white[1:-1] = (points == 32) | ((points >= 9) & (points <= 13))
    edges = np.nonzero(white[1:] != white[:-1])[0]
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, points
    numbers, powers = _tables()
    up, down = powers.of(len(points))
    terms = numbers[points] * up[: len(points)]
    terms[white[1:-1]] = 0
    sums = np.add.reduceat(terms, starts) * down[starts]
    return mixed(sums + (ends - starts).astype(np.uint64)), starts, ends, points


def shingles(text: str, k: int = WORDS) -> np.ndarray:
    """Sorted different shingle hashes; empty for texts without words."""
    return np.unique(rolling(located_words(text)[0], k))


class Signatures:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = r.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 2**63, bands * rows, np.uint64)

    def band_hashes(self, x: np.ndarray) -> np.ndarray:
        """One signed 64-bit hash per band, of the band's number and minima."""
        low = np.full(len(self.a), np.uint64(2**64 - 1))
        for i in range(0, len(x), 1024):
            np.minimum(low, (x[i : i + 1024, None] * self.a + self.b).min(axis=0), out=low)
        return self._banded(low[None])[0]

    def band_hashes_of(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """band_hashes() of the sets that begin at ``starts`` in ``x``, a row each."""
        low = [np.minimum.reduceat(x * a + b, starts) for a, b in zip(self.a, self.b, strict=True)]
        return self._banded(np.array(low).T)

    def _banded(self, low: np.ndarray) -> np.ndarray:
        parts = (low >> np.uint64(24)).reshape(len(low), self.bands, self.rows)
        out = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64) * GOLDEN, parts.shape[:2])
        for j in range(self.rows):
            out = mixed(out ^ parts[:, :, j])
        return np.ascontiguousarray(out).view(np.int64)


def signatures(items: DataFrame, k: int, bands: int, rows: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(_row, text, ``keep``) to (_row, set_hash, n, bands, ``keep``); texts without words have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signatures(bands, rows)
        for b in batches:
            out = []
            for text in b["text"]:
                x = shingles(text, k)
                out.append((xxhash.xxh3_128_digest(x.tobytes()), len(x), signer.band_hashes(x) if len(x) else None))
            out = pd.DataFrame(out, columns=["set_hash", "n", "bands"], index=b.index)
            yield pd.concat([b[["_row", *keep]], out], axis=1)[out["n"] > 0]

    kinds = dict(items.dtypes)
    kept = "".join(f", {c} {kinds[c]}" for c in keep)
    return items.select("_row", "text", *keep).mapInPandas(run, f"_row long{kept}, set_hash binary, n int, bands array<long>")


def _members(reps: DataFrame) -> DataFrame:
    """(_row, buckets): of each representative, the buckets that are kept, with their sizes and shingles."""
    each = reps.select("_row", "n", F.explode("bands").alias("bucket"))
    # counted before they meet: a bucket of a third of all rows sends one row per map task; most buckets have one member, so only counts are sent of all
    more = frozen(each.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "shared-buckets")
    met = frozen(each.join(more.select("bucket"), "bucket"), "met")
    sizes = met.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("_row")).alias("x"), F.bit_xor(F.xxhash64("_row", F.lit(1))).alias("y"))
    kept = frozen(sizes.groupBy("size", "weight", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size", "weight"), "buckets")
    return met.join(kept, "bucket").groupBy("_row").agg(F.collect_list(F.struct("bucket", "size", "weight")).alias("buckets"))


def similar(x: np.ndarray, owner: np.ndarray, sizes: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Boolean matrix of the sets whose Jaccard similarity is at least the threshold; x: their elements, owner: whose."""
    n = len(sizes)
    _, column, count = np.unique(x, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = column[shared], owner[shared]
    common = np.zeros((n, n), np.float32)
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for lo in range(0, int(column[-1]) + 1, COLUMNS):
            a, b = np.searchsorted(column, [lo, lo + COLUMNS])
            m = np.zeros((n, COLUMNS if b < len(column) else int(column[-1]) + 1 - lo), np.float32)
            m[owner[a:b], column[a:b] - lo] = 1
            common += m @ m.T
    p, q = threshold.numerator, threshold.denominator
    return (p + q) * common.astype(np.int64) >= p * (sizes[:, None] + sizes[None, :])


def _parents(linked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The least row that each row is connected to."""
    label = rows.copy()
    while True:
        least = np.where(linked, label[None, :], label[:, None]).min(axis=1)
        least = np.minimum(least, label)
        if (least == label).all():
            return label
        label = least


def _compare(rows, copies, sides, sets, buckets, bucket: int, across: bool, threshold: Fraction) -> pd.DataFrame:
    sizes = np.fromiter((len(s) // 8 for s in sets), np.int64, len(sets))
    x = np.frombuffer(b"".join(sets), np.uint64)
    linked = similar(x, np.repeat(np.arange(len(sets)), sizes), sizes, threshold)
    np.fill_diagonal(linked, False)
    if across:
        linked &= sides[:, None] != sides[None, :]
    # pairs that share an earlier bucket count there
    earlier = [(i, b) for i, own in enumerate(buckets) for b in own if b < bucket]
    if earlier and linked.any():
        who, which = np.array(earlier, np.int64).T
        which = np.unique(which, return_inverse=True)[1]
        m = np.zeros((len(sets), int(which.max()) + 1), np.float32)
        m[who, which] = 1
        linked &= (m @ m.T) == 0
    links = linked.sum(axis=1)
    keep = links > 0
    if not keep.any():
        return pd.DataFrame({"_row": np.zeros(0, np.int64), "parent": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "docs": np.zeros(0, np.int64)})
    docs = np.where(linked, copies[None, :], 0).sum(axis=1)
    return pd.DataFrame({"_row": rows, "parent": _parents(linked, rows), "links": links, "docs": docs})[keep]


def _compare_few(blocks: list[tuple], threshold: Fraction) -> pd.DataFrame:
    """_compare() of blocks (rows, copies, sides, sets, buckets, bucket, across) of at most FEW members, all at once: most buckets have two or three."""
    counts = np.array([len(b[0]) for b in blocks])
    block = np.repeat(np.arange(len(blocks)), counts)
    rows, copies = (np.concatenate([b[i] for b in blocks]) for i in (0, 1))
    sets = [s for b in blocks for s in b[3]]
    sizes = np.fromiter((len(s) // 8 for s in sets), np.int64, len(sets))
    x, owner = np.frombuffer(b"".join(sets), np.uint64), np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((x, block[owner]))
    x, owner = x[order], owner[order]
    # which elements of a block are equal; their owners ascend
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (block[owner[1:]] != block[owner[:-1]])
    run = np.cumsum(new)
    met = []
    for step in range(1, FEW):
        equal = run[step:] == run[:-step]
        if not equal.any():
            break
        met.append(owner[:-step][equal] * FEW + owner[step:][equal] - owner[:-step][equal])
    common = np.bincount(np.concatenate(met) if met else np.zeros(0, np.int64))
    pair = np.nonzero(common)[0]
    common = common[pair]
    a, b = pair // FEW, pair // FEW + pair % FEW
    p, q = threshold.numerator, threshold.denominator
    linked = (p + q) * common >= p * (sizes[a] + sizes[b])
    sides, across = np.concatenate([b[2] for b in blocks]), np.array([b[6] for b in blocks])[block]
    linked &= ~across[a] | (sides[a] != sides[b])
    a, b = a[linked], b[linked]
    # pairs that share an earlier bucket count there
    earlier = [{i for i in own if i < bk[5]} for bk in blocks for own in bk[4]]
    first = np.array([earlier[i].isdisjoint(earlier[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)
    a, b = a[first], b[first]
    both, other = np.concatenate([a, b]), np.concatenate([b, a])
    links, docs, label = np.bincount(both, minlength=len(rows)), np.zeros(len(rows), np.int64), rows.copy()
    np.add.at(docs, both, copies[other])
    while True:
        least = label.copy()
        np.minimum.at(least, both, label[other])
        if (least == label).all():
            break
        label = least
    return pd.DataFrame({"_row": rows, "parent": label, "links": links, "docs": docs})[links > 0]


def sets_of_texts(items: DataFrame, k: int) -> Callable[[DataFrame], DataFrame]:
    """A function that adds the shingle sets to members (_row, ...), from items (_row, text)."""

    def add(members: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(text=[shingles(t, k).tobytes() for t in b["text"]]).rename(columns={"text": "shingles"})

        # sorted and merged at every size: few candidates could be broadcast, but most inputs have too many
        own = items.join(members.hint("merge"), "_row").select("_row", "copies", "buckets", "text")
        return own.mapInPandas(run, MEMBERS)

    return add


MEMBERS = "_row long, copies long, buckets array<struct<bucket: long, size: long, weight: long>>, shingles binary"


def links(reps: DataFrame, threshold: Fraction, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(_row, parent, links, docs): for each task's members with links, their number, with copies and without, and a
    row of the same component.  ``sets`` adds the shingle sets to members."""
    members = frozen(_members(reps).join(reps.select("_row", "copies"), "_row"), "members")
    own = sets(members).select("_row", "copies", "shingles", F.transform("buckets", lambda b: b["bucket"]).alias("own"), F.explode("buckets").alias("b"))
    blocks = F.ceil(F.greatest(F.col("b.size") / BLOCK, F.col("b.weight") / BLOCK_SHINGLES)).cast("int")
    side = F.pmod(F.xxhash64("_row", "b.bucket"), blocks).cast("int")
    tasks = own.select("_row", "copies", "shingles", "own", "b.bucket", side.alias("side"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    tasks = tasks.select("*", F.least("side", "other").alias("first"), F.greatest("side", "other").alias("second")).drop("other")
    tasks = tasks.repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        key = None
        few: list[tuple] = []
        size = 0

        def done() -> Iterator[pd.DataFrame]:
            nonlocal few, size
            if len(held) > 1:
                row, copies, side, sets, own = zip(*held, strict=True)
                block = np.array(row, np.int64), np.array(copies, np.int64), np.array(side), sets, own, key[0], key[1] != key[2]
                if len(held) > FEW:
                    yield _compare(*block, threshold)
                else:
                    few.append(block)
                    size += sum(map(len, sets)) // 8
            if size > TOGETHER:
                yield _compare_few(few, threshold)
                few, size = [], 0

        for b in batches:
            for row, copies, sets, own, bucket, side, first, second in b[["_row", "copies", "shingles", "own", "bucket", "side", "first", "second"]].itertuples(index=False):
                if (bucket, first, second) != key:
                    yield from done()
                    held, key = [], (bucket, first, second)
                held.append((row, copies, side, sets, own))
        yield from done()
        if few:
            yield _compare_few(few, threshold)

    return tasks.mapInPandas(compare, "_row long, parent long, links long, docs long")


def near_duplicates(items: DataFrame, k: int = WORDS, threshold: Fraction = THRESHOLD, recall: float = RECALL, most_hashes: int = 128, keep: tuple[str, ...] = ()) -> DataFrame:
    """(_row, text, ``keep``) to (_row, ``keep``, rep, root, copies, n_links, n_linked) for all texts with words: the representative of
    the equal sets, the least representative of the component, the number of texts with that set,
    the number of other sets at or above the threshold, and the number of texts that have these."""
    bands, rows = choose_bands(float(threshold), recall, most_hashes)
    signed = frozen(signatures(items, k, bands, rows, keep), "signatures")
    return classes(signed, threshold, sets_of_texts(items, k), keep)


def classes(signed: DataFrame, threshold: Fraction, sets: Callable[[DataFrame], DataFrame], keep: tuple[str, ...] = ()) -> DataFrame:
    """near_duplicates() from written signatures (_row, ``keep``, set_hash, n, bands)."""
    reps = signed.groupBy("set_hash").agg(F.min("_row").alias("_row"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = frozen(reps, "representatives")
    found = frozen(links(reps.select("_row", "copies", "n", "bands"), threshold, sets), "links")
    roots = components(found.select(F.col("_row").alias("u"), F.col("parent").alias("v")))
    counts = found.groupBy("_row").agg(F.sum("links").alias("n_links"), F.sum("docs").alias("n_linked"))
    of_rep = reps.select("set_hash", F.col("_row").alias("rep"), "copies").join(counts.withColumnRenamed("_row", "rep"), "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    of_rep = frozen(of_rep.select("set_hash", "rep", F.coalesce("root", "rep").alias("root"), "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "classes")
    discard(reps, found)
    return signed.select("_row", *keep, "set_hash").join(of_rep, "set_hash").drop("set_hash")
