"""Hard negatives by a pivot table over all vectors.

An inner product becomes a distance when vectors get one more component: with M the largest squared length, x' = (x, sqrt(M - |x|^2)) and
q' = (q, 0) have |q' - x'|^2 = |q|^2 + M - 2 qx.  The distances of every x' to a few pivots are stored.  By the triangle inequality, the distances d of
q' and e of x' to a pivot bracket the distance of q' and x' between |d - e| and d + e, and so the score.  Runs of rows, whose brackets follow from the
ranges of their pivot distances, are passed over if they can't matter; the others' integer scores are computed, those of a block of anchors at once.

Positives come first (the best rows of an anchor's label), then negatives (rows of other labels between two shares of each positive's score), best first.
Both are searches of a stated query set against all rows, in blocks: rows are stored in blocks of one label in the order of the first pivot distance, anchors in smaller
blocks.  A shelf of blocks and the anchors that ask it go to one task by the shelf's number, the shelf first: the task holds a shelf while blocks of anchors
go by, and sends the best rows per anchor (and positive), which merge in a limited window.  Nothing is joined that the planner could broadcast: the anchors, once
for each shelf, are many times the file whose size it would look at.  Pivots are chosen from at most SAMPLE rows, farthest first; they decide how much is passed
over, never the result.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part; nor do rows whose squared length passes 2^61, as scores are
long integers.  Shorter vectors end in zeros.  A null id is no anchor and comes last among ties; of repeated ids each row counts, in
the order of rows; an anchor's own row is never its positive.  Without rows there is no result.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, frozen, numbered

SAMPLE = 1024
PIVOTS = 16
BLOCK = 2048
ANCHORS = 128
#: Blocks of a shelf at most, which a task holds.
SHELF = 128
#: Rows that are passed over or scored together.
RUN = 128
#: Stands for a null id, after all others.
NO_ID = 2**63 - 1
LARGEST = float(2**61)
#: Beyond all scores.
FAR = 2**62
#: What goes from the JVM to Python at once while shelves are searched.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BYTES = "8m"


def vectors(table: DataFrame, is_anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: float = 256.0) -> DataFrame:
    """(row, id, label, x, norm, anchor), written: the rows that take part, with integer components floor(scale * x)."""
    x = F.col("doc")[embedding]
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    scaled = F.transform(x, lambda c: F.lit(scale) * c.cast("double"))
    short = F.aggregate(scaled, F.lit(0.0), lambda a, c: a + c * c) <= LARGEST
    rows = numbered(table.withColumn("_is_anchor", F.coalesce(is_anchor, F.lit(False))))
    own = rows.where(F.col("doc")[label].isNotNull() & x.isNotNull()).where(finite).where(short)
    own = own.select(F.col("_row").alias("row"), F.coalesce(F.col("doc")[vec_id].cast("long"), F.lit(NO_ID)).alias("id"), F.col("doc")[label].cast("long").alias("label"), F.transform(scaled, lambda c: F.floor(c)).alias("x"), F.col("doc")["_is_anchor"].alias("anchor"))
    return frozen(own.withColumn("norm", F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + c * c)), "vectors")


def _padded(xs, width: int) -> np.ndarray:
    if all(len(x) == width for x in xs):
        return np.array(list(xs), np.int64).reshape(len(xs), width)
    out = np.zeros((len(xs), width), np.int64)
    for i, x in enumerate(xs):
        out[i, : len(x)] = x
    return out


def _augmented(x: np.ndarray, most: int) -> np.ndarray:
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))[:, None]])


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` of ``points``, each as far as possible from those before it."""
    chosen = [points[0]]
    near = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    while len(chosen) < count and near.max() > 0:
        chosen.append(points[int(near.argmax())])
        near = np.minimum(near, np.sqrt(((points - chosen[-1]) ** 2).sum(axis=1)))
    return np.stack(chosen)


class Space:
    """What all tasks know: the width, the largest squared length and the pivots."""

    def __init__(self, own: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE):
        self.rows, most, width = own.agg(F.count("*"), F.max("norm"), F.max(F.size("x"))).first()
        if self.rows:
            self.most, self.width = int(most), int(width)
            h, row = F.xxhash64("row"), F.col("row")
            # The last key first: a limit of whole rows would send the driver as many from each task.
            last = own.select(h.alias("h"), "row").orderBy("h", "row").limit(sample).orderBy(F.desc("h"), F.desc("row")).first()
            some = own.where((h < last.h) | (h == last.h) & (row <= last.row)).select("row", "x").toPandas().sort_values("row")
            self.pivots = farthest_first(_augmented(_padded(some["x"], self.width), self.most), pivots)
            #: Sums up to 2^24 and 2^53 are exact in floating point.
            self.kind = "<f4" if self.most <= 2**24 else "<f8" if self.most <= 2**53 else "<i8"
            #: Holds each component.
            self.stored = next(k for k, top in (("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**63)) if self.most < top * top)
            #: Covers pivot distances that are stored in four bytes.
            self.slack = 1 + 1e-6 * self.most

    def brackets(self, norm: float | np.ndarray, own: np.ndarray, least: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest scores of a query with pivot distances ``own`` and rows with distances from ``least`` to ``most`` (just ``least``, if not given)."""
        most = least if most is None else most
        near, far = np.maximum(np.maximum(least - own, own - most), 0).max(axis=-1), (most + own).min(axis=-1)
        return (norm + self.most - far * far) / 2 - self.slack, (norm + self.most - near * near) / 2 + self.slack


POINTS = "row long, id long, label long, anchor boolean, near double, x binary, d binary"
BLOCKS = "label long, rows binary, ids binary, x binary"


def pivot_table(own: DataFrame, space: Space) -> DataFrame:
    """(row, id, label, anchor, near, x, d), written: every vector with its pivot distances, the first of them also as ``near``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _padded(b["x"], space.width)
                d = _distances(_augmented(x, space.most), space.pivots)
                yield b[["row", "id", "label", "anchor"]].assign(near=d[:, 0], x=[r.tobytes() for r in x.astype(space.stored)], d=[r.tobytes() for r in d.astype("<f4")])

    return frozen(own.mapInPandas(run, POINTS), "pivots")


def blocks(points: DataFrame, size: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one label, near each other, in blocks of up to ``size``; ``extra`` columns of long integers or arrays of these are joined too.  Blocks fill as sorted rows
    go by, so no label is gathered."""
    order = ["label", "near", "row"]
    columns = ["row", "id", "x", *extra]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        label = None

        def done() -> pd.DataFrame:
            row, ids, *rest = zip(*held, strict=True)
            out = {"label": [label], "rows": [np.array(row, "<i8").tobytes()], "ids": [np.array(ids, "<i8").tobytes()]}
            joined = {c: [b"".join(v if isinstance(v, bytes) else np.array(v, "<i8").tobytes() for v in x)] for c, x in zip(columns[2:], rest, strict=True)}
            return pd.DataFrame(out | joined)

        for b in batches:
            for own, *values in b[["label", *columns]].itertuples(index=False):
                if held and (own != label or len(held) == size):
                    yield done()
                    held = []
                label = own
                held.append(values)
        if held:
            yield done()

    return points.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pack, BLOCKS + "".join(f", {c} binary" for c in extra))


class Block(NamedTuple):
    """Rows of one label, with the ranges of the pivot distances of each run of them."""

    label: int
    rows: np.ndarray
    ids: np.ndarray
    x: np.ndarray
    least: np.ndarray
    most: np.ndarray


class Best:
    """The first k rows by descending score, id and row of each slot; what is added counts when it is merged."""

    def __init__(self, k: int, low: np.ndarray):
        self.k, self.low = k, low
        #: What a row must come before to count: a score, id and row by slot.
        self.last = [low.copy(), np.full(len(low), NO_ID), np.full(len(low), NO_ID)]
        self.held = [np.zeros(0, np.int64)] * 4
        self.new: list[tuple] = []
        self.pending = 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        s, i, r = (x[slot] for x in self.last)
        fit = np.flatnonzero((score > s) | (score == s) & ((ids < i) | (ids == i) & (rows < r)))
        if len(fit):
            self.new.append((slot[fit], score[fit], ids[fit], rows[fit]))
            self.pending += len(fit)

    def merge(self) -> None:
        if not self.new:
            return
        slot, score, ids, rows = (np.concatenate(x) for x in zip(self.held, *self.new, strict=True))
        order = np.lexsort((rows, ids, -score, slot))
        slot = slot[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        counts = np.diff(np.r_[starts, len(slot)])
        keep = np.arange(len(slot)) - np.repeat(starts, counts) < self.k
        ends = starts[counts >= self.k] + self.k - 1
        for mine, x in zip(self.last, (score, ids, rows), strict=True):
            mine[slot[ends]] = x[order[ends]]
        self.held = [slot[keep], *(x[order[keep]] for x in (score, ids, rows))]
        self.new, self.pending = [], 0


def _pieces(n: int, begun: bool) -> Iterator[tuple[int, int]]:
    """A block whole; the first one in pieces that grow from a run, so the best of few rows bound what follows."""
    at = 0
    while at < n:
        end = n if begun else min(n, at + max(at, RUN))
        yield at, end
        at = end


def _ask(shelf: list[Block], space: Space, k: int, same: bool, label: int, rows: np.ndarray, x: np.ndarray, wanted: np.ndarray) -> Best:
    """The best rows on a shelf for a block of anchors: of their label (``same``) or of others, between the last two values of each five of ``wanted``; slots are (anchor, five)."""
    as_query = np.hstack([x.astype(np.float64), np.zeros((len(x), 1))])
    norms, own, q = (as_query**2).sum(axis=1), _distances(as_query, space.pivots), x.astype(space.kind)
    high, each = wanted[:, :, 4], wanted.shape[1]
    best = Best(k, wanted[:, :, 3].ravel())
    seen = merged = 0
    for block in shelf:
        if (block.label == label) != same:
            continue
        for first, end in _pieces(len(block.rows), seen > 0):
            least = best.last[0].reshape(high.shape)
            floor, top = np.where(least <= high, least, FAR).min(axis=1), np.where(least <= high, high, -FAR).max(axis=1)
            runs = slice(first // RUN, -(-end // RUN))
            low, up = space.brackets(norms[:, None], own[:, None], block.least[None, runs], block.most[None, runs])
            needed = (up >= floor[:, None]) & (low <= top[:, None])
            askers, used = np.flatnonzero(needed.any(axis=1)), needed.any(axis=0)
            if not len(askers):
                continue
            at = np.arange(first, end)[np.repeat(used, RUN)[: end - first]]
            score = q[askers] @ (block.x[first:end] if used.all() else block.x[at]).T
            floor, top = floor[askers].astype(space.kind), top[askers].astype(space.kind)
            found = np.flatnonzero(score.max(axis=1) >= floor)  # mostly few anchors, when much has been seen
            score = score[found]
            i, c = np.divmod(np.flatnonzero(((score >= floor[found, None]) & (score <= top[found, None])).ravel()), len(at))
            value, i, c = score[i, c].astype(np.int64), askers[found[i]], at[c]
            if same:
                other = block.rows[c] != rows[i]
                value, i, c = value[other], i[other], c[other]
            for j in range(each):
                fit = np.flatnonzero(value <= high[i, j])
                best.add(i[fit] * each + j, value[fit], block.ids[c[fit]], block.rows[c[fit]])
            seen += end - first
            if seen >= 2 * merged or best.pending > 8 * k * len(best.low):
                best.merge()
                merged = seen
    best.merge()
    return best


FOUND = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, row long, id long, score long"


def _search(met: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """The best k rows by anchor (``same``: of its label) or by anchor and positive (of other labels), as far as each shelf has them."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shelf = None, []
        for b in batches:
            for at in range(b.num_rows):
                value = {c: b.column(c)[at] for c in b.schema.names}
                get = lambda c, kind: np.frombuffer(value[c].as_buffer(), kind)  # noqa: B023, E731
                own, label, rows, ids = value["shelf"].as_py(), value["label"].as_py(), get("rows", "<i8"), get("ids", "<i8")
                x = get("x", space.stored).reshape(-1, space.width)
                if own != number:
                    number, shelf = own, []
                if not value["asks"].as_py():
                    d, starts = get("d", "<f4").reshape(len(rows), -1).astype(np.float64), np.arange(0, len(rows), RUN)
                    shelf.append(Block(label, rows.copy(), ids.copy(), x.astype(space.kind), np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)))
                    continue
                wanted = np.tile(np.array([-1, -1, 0, -FAR, FAR]), (len(rows), 1, 1)) if same else get("wanted", "<i8").reshape(len(rows), -1, 5)
                slot, score, found, places = _ask(shelf, space, k, same, label, rows, x, wanted).held
                if len(slot):
                    i, j = np.divmod(slot, wanted.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (rows[i], ids[i], *wanted[i, j, :3].T, places, found, score)], names)

    return met.mapInArrow(run, FOUND)


def _met(anchors: DataFrame, shelved: DataFrame) -> DataFrame:
    """The blocks of each shelf, and after them the blocks of ``anchors``, which have a row for each shelf that they ask."""
    columns = ["shelf", "asks", "label", "rows", "ids", "x", "d", "wanted"]
    put = lambda df, **more: df.withColumns({c: F.lit(v) if v is not None else F.lit(None).cast("binary") for c, v in more.items() if c not in df.columns}).select(columns)
    both = put(shelved, asks=False, wanted=None).union(put(anchors, asks=True, d=None, wanted=None))
    return both.repartition("shelf").sortWithinPartitions("shelf", "asks")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of MOST_BYTES for what runs here, unless the session sets them."""
    unset = BATCH not in spark.conf.getAll
    if unset:
        spark.conf.set(BATCH, MOST_BYTES)
    try:
        yield
    finally:
        if unset:
            spark.conf.unset(BATCH)


def mine(own: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, space: Space | None = None) -> DataFrame:
    """From vectors(), for each anchor and each of its first ``positives`` rows of the same label the first ``negatives`` rows of other labels whose scores
    lie between ``least`` and ``most`` percent of the positive's: anchor_row, anchor_id, positive_row, positive_id, positive_score, rank, negative_row, negative_id, negative_score."""
    spark = own.sparkSession
    space = space or Space(own)
    result = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, rank int, negative_row long, negative_id long, negative_score long"
    if not space.rows:
        return spark.createDataFrame([], result)
    points = pivot_table(own, space)
    stored = frozen(blocks(points, BLOCK, ("d",)), "blocks")
    asked = frozen(points.where("anchor").drop("d"), "anchors")
    discard(points)
    per = max(1, min(SHELF, space.rows // BLOCK // 64))
    shelved = numbered(stored).select(F.floor(F.col("_row") / per).alias("shelf"), "doc.*")
    last = (stored.count() - 1) // per
    first = blocks(asked, ANCHORS).join(shelved.select("label", "shelf").distinct().hint("merge"), "label")
    of_label = _search(_met(first, shelved), space, positives, same=True)
    with small_batches(spark):
        best = frozen(_first(of_label, ["anchor_row"], positives).select("anchor_row", "rank", "row", "id", "score"), "positives")
    share = lambda percent: F.col("score").cast("decimal(20,0)") * percent / 100
    bounds = F.struct("rank", "row", "id", "score", F.ceil(share(least)).cast("long").alias("low"), F.floor(share(most)).cast("long").alias("high"))
    each = best.groupBy("anchor_row").agg(F.array_sort(F.collect_list(bounds)).alias("best"))
    absent = F.struct(*[F.lit(v).cast("long").alias(n) for n, v in (("row", -1), ("id", -1), ("score", 0), ("low", 0), ("high", -1))])
    values = lambda p: F.array(*[F.coalesce(p[c], absent[c]) for c in ("row", "id", "score", "low", "high")])
    wanted = F.flatten(F.array(*[values(F.get("best", F.lit(i))) for i in range(positives)]))
    with_positives = asked.join(each.hint("merge"), F.col("row") == F.col("anchor_row")).withColumn("wanted", wanted)
    second = frozen(blocks(with_positives, ANCHORS, ("wanted",)), "asked")
    everywhere = second.withColumn("shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    others = _search(_met(everywhere, shelved), space, negatives, same=False)
    ranked = _first(others, ["anchor_row", "positive_row"], negatives)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    ranked = ranked.withColumnRenamed("row", "negative_row").withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    ranked = ranked.select("anchor_row", known("anchor_id"), "positive_row", known("positive_id"), "positive_score", "rank", "negative_row", known("negative_id"), "negative_score")
    with small_batches(spark):
        out = frozen(ranked, "negatives")
    discard(stored, asked, best, second)
    return out
