"""Substring dedup: paragraph MinHash banding, with removals clustered by components.

Paragraphs are the lines of at least ``LEAST_WORDS`` words.  Their bands are tuned for a recall of 0.999 at a Jaccard similarity of 0.8
with few hashes, since paragraphs are short and many; colliding ones are joined and verified on their full shingle sets, and the links'
components are the classes.

A repeated passage need not be a line: it may stand in the middle of one, or run over several, with words changed.  Passages are sought in
what stays when repeated paragraphs are gone.  For these each text also gives sub-paragraph windows of ``WINDOW`` words.  They begin at anchors: of
each ``SPREAD`` consecutive 3-word shingles the one with the least hash, which is a MinHash of one row for every stretch of text, and depends on the
words of the stretch alone.  So any common run of ``WINDOW + SPREAD - 1`` words, 24, has an equal window in all its copies, without exception; and
a passage of over 50 words with a similarity of 0.8 has such a run between its changes.  Equal windows only propose, and pairs of documents are what is compared: a window
is paired with its first and with its last occurrence, and windows of one pair of documents at one distance make runs.  Runs of a pair are extended word by
word to where the two texts differ, and those at most ``GAP`` words apart in both make one passage.  A passage counts if it has ``LEAST_PASSAGE`` words or more,
of which at least 0.8 are matched in order with the one partner, an edit distance of at most a fifth of its length.  Text that is shared piece by piece with several documents is
no passage.  (A document that shares a passage with another, parts of which both earlier and later documents hold too, is found by those parts.)

Places of passages in a document that overlap by half are one.  Pairs of places are links, whose components are the classes: the first place of a class, in the
order of row numbers, stays and has a row; of each pair the later place is a removal.  Of each class of paragraphs likewise the first member stays.

Edge cases: null, empty and short texts have no paragraphs and no rows; what is repeated within one document is a repeat; repeated rows
repeat one another; texts of any length are read whole; offsets are in code points, end exclusive; other columns, whatever their names, aren't read,
and without_repeats returns them as they were; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, frozen, numbered
from tidemark.llm.components import components
from tidemark.llm.minhash import MEMBERS, WORDS, Signatures, choose_bands, classes, located_words, rolling, shingles

LEAST_WORDS = 25
LEAST_PASSAGE = 40
SPREAD = 14
WINDOW = 11
GAP = 3
THRESHOLD = Fraction(4, 5)
MOST_HASHES = 32
RECALL = 0.999
SCHEMA = "doc_row long, kind string, start int, end int, class_row long, removed boolean"

#: of: the document's row; lines have start to bands (first, last: their word numbers), the windows of a document ats (word numbers, 32 bits each) and keys (64 bits).
CUT = "of long, start int, end int, first int, last int, n int, set_hash binary, bands array<long>, ats binary, keys binary"


def _slid(f: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """f over each run of ``n`` values, by doubling."""
    size = 1
    while 2 * size <= n:
        x, size = f(x[:-size], x[size:]), 2 * size
    return x if size == n else f(x[: len(x) - (n - size)], x[n - size :])


def anchors(hashes: np.ndarray, spread: int = SPREAD, window: int = WINDOW) -> np.ndarray:
    """Numbers of the words at which windows begin: those whose 3-word shingle has the least hash of some run of ``spread``."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    h = rolling(hashes, 3)
    spread = min(spread, len(h))
    least = np.concatenate([np.zeros(spread - 1, np.uint64), _slid(np.minimum, h, spread), np.zeros(spread - 1, np.uint64)])
    at = np.nonzero(_slid(np.maximum, least, spread) == h)[0]
    return at[at + window <= len(hashes)]


def windows_of(texts: list[np.ndarray], spread: int = SPREAD, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchors() and window_keys() of several texts' words, one after another, and how many windows each text has."""
    n = np.array([len(x) for x in texts])
    begin, words = np.cumsum(n) - n, np.concatenate(texts)
    h = rolling(words, 3)
    # a zero takes the place of shingles over two texts: no run of shingles that it stands in has an anchor
    h = np.append(h, np.zeros(len(words) - len(h), np.uint64))
    for i in (1, 2):
        h[(begin + n - i)[n >= i]] = 0
    edge = np.zeros(spread - 1, np.uint64)
    least = np.concatenate([edge, _slid(np.minimum, np.concatenate([h, edge]), spread)])
    at = np.nonzero((_slid(np.maximum, least, spread) == h) & (h > 0))[0]
    of = np.searchsorted(begin, at, "right") - 1
    # of texts with fewer shingles than a run has, all are one run
    short = n < spread + 2
    stays = ~short[of] & (at - begin[of] + window <= n[of])
    own = [anchors(texts[i], spread, window) + begin[i] for i in np.nonzero(short)[0]]
    at = np.sort(np.concatenate([at[stays], *own]))
    of = np.searchsorted(begin, at, "right") - 1
    return at - begin[of], window_keys(words, at, window), np.bincount(of, minlength=len(texts))


def window_keys(hashes: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A signed 64-bit hash of the words of each window."""
    if not len(at):
        return np.zeros(0, np.int64)
    return rolling(hashes[at[:, None] + np.arange(window)].T, window)[0].view(np.int64)


def _lines(rows: list[int], words: list[tuple], signer: Signatures, least: int) -> pd.DataFrame:
    """of, start, end, first, last, n, set_hash, bands of the paragraphs of some documents, from their located_words(), all at once."""
    # a line feed ends each text; words and places are counted on from text to text
    points = np.concatenate([x for w in words for x in (w[3], np.full(1, 10, np.uint32))])
    n, sizes = (np.array([len(w[i]) for w in words]) for i in (0, 3))
    before, begin = np.cumsum(n) - n, np.cumsum(sizes + 1) - sizes - 1
    ends = np.nonzero(points == 10)[0]
    last = np.searchsorted(np.concatenate([w[1] for w in words]) + np.repeat(begin, n), ends)
    at, start = np.append(0, last[:-1]), np.append(0, ends[:-1] + 1)
    long = np.nonzero(last - at >= least)[0]
    if not len(long):
        return pd.DataFrame()
    at, last, start, end = at[long], last[long], start[long], ends[long]
    doc = np.searchsorted(begin, start, "right") - 1
    of, start, end, first, last = np.array(rows)[doc], start - begin[doc], end - begin[doc], at - before[doc], last - before[doc]
    grams, counts = rolling(np.concatenate([w[0] for w in words]), WORDS), last - first - WORDS + 1
    places = np.cumsum(counts) - counts
    x = grams[np.repeat(at - places, counts) + np.arange(counts.sum())]
    raw = x.tobytes()
    # paragraphs of equal words in equal order are one set; those of equal sets in another order meet in their bands
    digests = [xxhash.xxh3_128_digest(raw[8 * o : 8 * (o + c)]) for o, c in zip(places.tolist(), counts.tolist(), strict=True)]
    return pd.DataFrame({"of": of, "start": start, "end": end, "first": first, "last": last, "n": counts, "set_hash": digests, "bands": list(signer.band_hashes_of(x, places))})


def _split(x: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The bytes of so many values of ``x`` each, one after another."""
    raw, ends = x.tobytes(), (np.cumsum(counts) * x.itemsize).tolist()
    return [raw[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]


def _filled(rows: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """All of ``names`` as columns, null where ``rows`` hasn't them."""
    return rows.assign(**{c: None for c in names if c not in rows.columns})[names]


def cut_texts(docs: DataFrame, bands: int, rows: int, least: int = LEAST_WORDS) -> DataFrame:
    """CUT and _row, of docs (_row, text): the lines of at least ``least`` words with their signatures, and the windows of all texts.  Written
    to the shared folder: texts are read once for both."""
    names = [x.split(" ")[0] for x in CUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signatures(bands, rows)

        def frames(of: list[int], words: list[tuple]) -> Iterator[pd.DataFrame]:
            if of:
                at, keys, counts = windows_of([w[0] for w in words])
                windows = pd.DataFrame({"of": of, "ats": _split(at.astype("<i4"), counts), "keys": _split(keys, counts)})
                yield _filled(windows, names)
                if len(lines := _lines(of, words, signer, least)):
                    yield _filled(lines, names)

        for b in batches:
            of, words, held = [], [], 0
            for row, text in zip(b["_row"], b["text"], strict=True):
                own = located_words(text)
                if len(own[0]) >= WINDOW:
                    of.append(row)
                    words.append(own)
                    held += len(own[0])
                if held > 300_000:
                    yield from frames(of, words)
                    of, words, held = [], [], 0
            yield from frames(of, words)

    return frozen(docs.mapInPandas(run, CUT).withColumn("_row", F.monotonically_increasing_id()), "cut-texts")


def remaining(cut: DataFrame, gone: DataFrame) -> DataFrame:
    """(key, of, at): the windows of cut_texts() that no removed paragraph (doc_row, first, last) touches; written, since they are read twice."""
    lists = gone.groupBy(F.col("doc_row").alias("of")).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("gone"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ats, keys = (np.frombuffer(b"".join(b[c]), kind) for c, kind in (("ats", "<i4"), ("keys", "<i8")))
            sizes = b["ats"].map(len).to_numpy() // 4
            ends, stays = np.cumsum(sizes), np.ones(len(ats), bool)
            for i, out in enumerate(b["gone"]):
                if out is not None:
                    own = slice(ends[i] - sizes[i], ends[i])
                    first, last = (np.array([x[k] for x in out]) for k in ("first", "last"))
                    stays[own] = np.searchsorted(last, ats[own], "right") == np.searchsorted(first, ats[own] + WINDOW, "left")
            yield pd.DataFrame({"key": keys[stays], "of": np.repeat(b["of"].to_numpy(), sizes)[stays], "at": ats[stays]})

    windows = cut.where("keys is not null").select("of", "ats", "keys")
    # merged at every size: few removed lines could be broadcast, but most inputs have too many
    return frozen(windows.join(frozen(lists, "removed-lines").hint("merge"), "of", "left").mapInPandas(run, "key long, of long, at int"), "windows")


def _both(high: Column, low: Column) -> Column:
    """Two columns of word numbers as one number, 2**32 * high + low."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))


def _places_of(windows: DataFrame, bits: int = 63) -> tuple[Column, Callable[[Column], Column], Callable[[Column], Column]]:
    """The place of a window (key, of, at), which orders as (of, at) does, and how to get of and at from it: one number, whose least and greatest are found by
    hashing, if the table's greatest of and at together have up to ``bits`` bits, else a struct."""
    most_of, most_at = (x or 0 for x in windows.agg(F.max("of"), F.max("at")).first())
    low = most_at.bit_length()
    if most_of.bit_length() + low > bits:
        return F.struct("of", "at"), lambda p: p["of"], lambda p: p["at"]
    return F.shiftleft("of", low).bitwiseOR(F.col("at").cast("long")), lambda p: F.shiftright(p, low), lambda p: p.bitwiseAND(F.lit(2**low - 1))


#: A run of equal words of two documents, x before y: [at, to) in x, and where it begins in y.
RUNS = "x long, y long, at int, to int, there int"


def _near(groups: dict[int, list], distance: int, at: int, there: int, gap: int) -> list | None:
    """Of the groups by the distance of their last run, the one that a run may go on from: it begins at most ``gap`` words after the last one's end in both texts
    (or before it, where both were extended over equal words)."""
    for d in range(distance - GAP, distance + GAP + 1):
        last = groups.get(d)
        if last and -GAP <= at - last[-1][1] <= gap and -GAP <= there - last[-1][1] - d <= gap:
            return last
    return None


def _one_distance(lists: list[np.ndarray]) -> Iterator[list[tuple[int, int, int]]]:
    """Of each pair of documents, whose windows are 2**32 * at + there: (at, to, there) of the runs of windows at one distance that overlap or touch, sorted."""
    if not lists:
        return
    packed, pair = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    at, there = packed >> 32, packed & 0xFFFFFFFF
    order = np.lexsort((at, there - at, pair))
    at, there, pair = at[order], there[order], pair[order]
    d = there - at
    new = np.ones(len(at), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (d[1:] != d[:-1]) | (at[1:] > at[:-1] + WINDOW)
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(at)) - 1
    pair, at, to, there = pair[first], at[first], at[last] + WINDOW, there[first]
    order = np.lexsort((there, to, at, pair))
    rows = list(zip(at[order].tolist(), to[order].tolist(), there[order].tolist(), strict=True))
    ends = np.searchsorted(pair, np.arange(len(lists) + 1))
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield rows[lo:hi]


def runs(windows: DataFrame, least: int = LEAST_PASSAGE) -> DataFrame:
    """RUNS of windows (key, of, at) that occur elsewhere too, in this document or another; written.  Runs that couldn't reach ``least`` words if they
    were extended on both sides as far as they can be, and joined, are left out."""
    place, of, at = _places_of(windows)
    shared = windows.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    shared = frozen(shared, "shared-windows")
    # merged at every size: few shared windows could be broadcast, but most inputs have too many
    met = windows.join(shared.hint("merge"), "key").withColumn("p", place).where("p <> first")
    pair = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    pairs = F.when(F.col("p") == F.col("last"), F.array(pair("first", "p"))).otherwise(F.array(pair("first", "p"), pair("p", "last")))
    met = met.select(F.explode(pairs).alias("w"))
    # where a window stands in both, as one number: lists of numbers are arrays in Python, those of structs are dicts
    x, y = F.col("w.x"), F.col("w.y")
    lists = met.groupBy(of(x).alias("x"), of(y).alias("y")).agg(F.collect_list(_both(at(x), at(y))).alias("windows"))
    reach = SPREAD - 1

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for x, y, own in zip(b["x"], b["y"], _one_distance(b["windows"].tolist()), strict=True):
                groups: dict[int, list] = {}
                whole: list[list] = []
                for r in own:
                    d = r[2] - r[0]
                    if (g := _near(groups, d, r[0], r[2], 2 * reach + GAP)) is None:
                        whole.append(g := [])
                    g.append(r)
                    groups[d] = g
                out += [(x, y, *r) for g in whole if g[-1][1] - g[0][0] + 2 * reach >= least for r in g]
            yield pd.DataFrame(out, columns=["x", "y", "at", "to", "there"])

    return frozen(lists.mapInPandas(chain, RUNS), "runs")


#: Of the words [at, to) of a document, up to SPREAD words before (left) and behind (right), nearest first: 32-bit hashes, and where each begins (ends), after that of [at, to) itself.
SURROUNDINGS = "of long, at int, to int, left binary, left_places binary, right binary, right_places binary"


def _surroundings(found: DataFrame) -> DataFrame:
    """(of, at, to) of each run in both texts, once each."""
    x = found.select(F.col("x").alias("of"), "at", "to")
    y = found.select(F.col("y").alias("of"), F.col("there").alias("at"), (F.col("there") + F.col("to") - F.col("at")).alias("to"))
    return x.unionByName(y).distinct()


def _beside(of: list[int], words: list[tuple], ends: list[np.ndarray]) -> pd.DataFrame:
    """SURROUNDINGS of the ends (2**32 * at + to) in some documents, all at once."""
    n, each = np.array([len(w[0]) for w in words]), np.array([len(x) for x in ends])
    hashes, starts, stops = (np.concatenate([w[i] for w in words]).astype(kind) for i, kind in ((0, "<u4"), (1, "<i4"), (2, "<i4")))
    packed, begin = np.concatenate(ends), np.repeat(np.cumsum(n) - n, each)
    at, to = packed >> 32, packed & 0xFFFFFFFF
    out = {"of": np.repeat(of, each), "at": at, "to": to}
    behind = np.arange(SPREAD + 1)
    for side, place, step, count, places in (("left", at, -1, np.minimum(at, SPREAD), starts), ("right", to, 1, np.minimum(np.repeat(n, each) - to, SPREAD), stops)):
        # the nearest word of a side: before at, or the one at to; its places begin with the edge of [at, to) itself
        near, edge = (begin + place - (step < 0), begin + place - (step > 0))
        out[side] = _split(hashes[(near[:, None] + step * behind[:-1])[behind[:-1] < count[:, None]]], count)
        out[f"{side}_places"] = _split(places[(edge[:, None] + step * behind)[behind <= count[:, None]]], count + 1)
    return pd.DataFrame(out)


def _texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``docs`` (_row, text) joined with ``asked`` (of, ...): each text is sent once to all that ask for it, and those that nobody asks for are left out
    first, by a table of rows alone, which the planner may broadcast if it is small."""
    texts = docs.withColumnRenamed("_row", "of")
    return texts.join(frozen(asked.select("of"), "asked"), "of", "left_semi").join(asked.hint("merge"), "of")


def _sets_of_lines(docs: DataFrame, lines: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Adds the shingle sets to member paragraphs."""

    def add(members: DataFrame) -> DataFrame:
        own = lines.select("_row", "of", "start", "end").join(members, "_row")
        asked = own.groupBy("of").agg(F.collect_list(F.struct("_row", "start", "end", "copies", "buckets")).alias("lines"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(x["_row"], x["copies"], x["buckets"], shingles(text[x["start"] : x["end"]]).tobytes()) for text, own in zip(b["text"], b["lines"], strict=True) for x in own]
                yield pd.DataFrame(rows, columns=["_row", "copies", "buckets", "shingles"])

        return _texts(docs, frozen(asked, "asked-lines")).select("text", "lines").mapInPandas(run, MEMBERS)

    return add


def beside(docs: DataFrame, found: DataFrame) -> DataFrame:
    """SURROUNDINGS of runs and their partners; written."""
    asked = frozen(_surroundings(found).groupBy("of").agg(F.collect_list(_both(F.col("at"), F.col("to"))).alias("ends")), "asked-ends")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of, words, ends, held = [], [], [], 0
            for row, text, own in zip(b["of"], b["text"], b["ends"], strict=True):
                located = located_words(text)[:3]
                for lo in range(0, len(own), 100_000):
                    of.append(row)
                    words.append(located)
                    ends.append(own[lo : lo + 100_000])
                    held += len(located[0]) + len(ends[-1])
                    if held > 100_000:
                        yield _beside(of, words, ends)
                        of, words, ends, held = [], [], [], 0
            if of:
                yield _beside(of, words, ends)

    return frozen(_texts(docs, asked).select("of", "text", "ends").mapInPandas(run, SURROUNDINGS), "surroundings")


#: A passage of two documents: where it stands in each.
PAIRS = "x long, x_start int, x_end int, y long, y_start int, y_end int"


#: RUNS extended over equal words on both sides, with where they begin and end in both texts; first, second: where the run stood, for its order.
EXTENDED = "x long, y long, first long, second int, at int, to int, there int, x_start int, x_end int, y_start int, y_end int"


def _more(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many words of each of ``a`` and of ``b`` are equal from the first on."""
    wide = lambda x: np.frombuffer(b"".join(v.ljust(4 * SPREAD, b"\0") for v in x), "<u4").reshape(-1, SPREAD)
    n = np.minimum([len(v) // 4 for v in a], [len(v) // 4 for v in b])
    same = (wide(a) == wide(b)) & (np.arange(SPREAD) < n[:, None])
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


def _extended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """EXTENDED of runs with SURROUNDINGS of both places."""

    def place(places: pd.Series, n: np.ndarray) -> np.ndarray:
        sizes = places.map(len).to_numpy() // 4
        return np.frombuffer(b"".join(places), "<i4")[np.cumsum(sizes) - sizes + n]

    for b in batches:
        if not len(b):
            continue
        left, right = _more(b["x_left"].tolist(), b["y_left"].tolist()), _more(b["x_right"].tolist(), b["y_right"].tolist())
        at, to, there = b["at"].to_numpy(), b["to"].to_numpy(), b["there"].to_numpy()
        out = {"x": b["x"], "y": b["y"], "first": at.astype(np.int64) << 32 | to, "second": there, "at": at - left, "to": to + right, "there": there - left}
        for of in "xy":
            out |= {f"{of}_start": place(b[f"{of}_left_places"], left), f"{of}_end": place(b[f"{of}_right_places"], right)}
        yield pd.DataFrame(out)


def passages(found: DataFrame, words: DataFrame, least: int = LEAST_PASSAGE) -> DataFrame:
    """PAIRS of runs(), extended in both texts, joined over gaps, of at least ``least`` words, 0.8 of them matched; written."""
    out = found.withColumn("there_to", F.col("there") + F.col("to") - F.col("at"))
    for of, at, to in (("x", "at", "to"), ("y", "there", "there_to")):
        sides = [F.col(c).alias(f"{of}_{c}") for c in ("left", "left_places", "right", "right_places")]
        out = out.join(words.select(F.col("of").alias(of), F.col("at").alias(at), F.col("to").alias(to), *sides), [of, at, to])
    # what is compared stays where it is joined; numbers go on
    longer = out.mapInPandas(_extended, EXTENDED)
    lists = longer.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("first", "second", "at", "to", "there", "x_start", "x_end", "y_start", "y_end"))).alias("runs"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x, y, own in zip(b["x"], b["y"], b["runs"], strict=True):
                groups: dict[int, list] = {}
                made: list[list] = []
                for r in own:
                    at, to, there = r["at"], r["to"], r["there"]
                    d, ends = there - at, (r["x_end"], r["y_end"])
                    # runs that meet when they are extended are one
                    same = groups.get(d)
                    if same and at <= same[-1][1]:
                        g, new = same, max(0, to - same[-1][1])
                    else:
                        g = _near(groups, d, at, there, GAP)
                        new = to - max(at, g[0][1]) if g else 0
                    if g is None:
                        made.append(g := [[at, to, 0], (r["x_start"], r["y_start"]), ends])
                        g.append(g[0])
                        new = to - at
                    g[0][2] += max(0, new)
                    if to >= g[0][1]:
                        g[0][1], g[2] = to, ends
                    groups[d] = g
                rows += [(x, g[1][0], g[2][0], y, g[1][1], g[2][1]) for g in made if g[0][1] - g[0][0] >= least and 5 * g[0][2] >= 4 * (g[0][1] - g[0][0])]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in PAIRS.split(", ")])

    return frozen(lists.mapInPandas(join, PAIRS), "passages")


def places(pairs: DataFrame) -> DataFrame:
    """SCHEMA, of PAIRS: the places of passages in each document, with their classes."""
    side = lambda s, later: pairs.select(F.col(s).alias("doc"), F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end"), F.lit(later).alias("later"))
    spans = side("x", False).unionByName(side("y", True)).groupBy("doc", "start", "end").agg(F.max("later").alias("later"))
    lists = spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end", "later"))).alias("spans"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, own in zip(b["doc"], b["spans"], strict=True):
                made: list[list] = []  # [start, end, spans]
                for s in own:
                    last = made[-1] if made else None
                    if last and 2 * (min(last[1], s["end"]) - s["start"]) >= min(last[1] - last[0], s["end"] - s["start"]):
                        last[1] = max(last[1], s["end"])
                        last[2].append(s)
                    else:
                        made.append([s["start"], s["end"], [s]])
                for start, _, members in made:
                    # what is a removal goes; a place without removals stays
                    gone = [m for m in members if m["later"]] or members
                    shown = (min(m["start"] for m in gone), max(m["end"] for m in gone), gone[0]["later"])
                    key = xxhash.xxh3_64_intdigest(f"{doc}:{start}") - 2**63
                    rows += [(doc, m["start"], m["end"], key, *shown) for m in members]
            yield pd.DataFrame(rows, columns=["doc", "start", "end", "place", "from", "to", "removed"])

    at = frozen(lists.mapInPandas(merge, "doc long, start int, end int, place long, from int, to int, removed boolean"), "places")
    of = lambda s: at.select(F.col("doc").alias(s), F.col("start").alias(f"{s}_start"), F.col("end").alias(f"{s}_end"), F.col("place").alias(f"{s}_place"))
    edges = pairs.join(of("x"), ["x", "x_start", "x_end"]).join(of("y"), ["y", "y_start", "y_end"]).select(F.col("x_place").alias("u"), F.col("y_place").alias("v"))
    roots = components(edges)
    each = at.select("doc", "place", "from", "to", "removed").distinct().join(roots.withColumnRenamed("node", "place"), "place", "left").withColumn("root", F.coalesce("root", "place"))
    first = each.groupBy("root").agg(F.min("doc").alias("class_row"))
    return each.join(first, "root").select(F.col("doc").alias("doc_row"), F.lit("passage").alias("kind"), F.col("from").alias("start"), F.col("to").alias("end"), "class_row", "removed")


def near_paragraphs(docs: DataFrame, lines: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """SCHEMA and first, last, of lines (_row, of, start, end, first, last, n, set_hash, bands): paragraphs with near copies, by component."""
    found = classes(lines, threshold, _sets_of_lines(docs, lines), keep=("of", "start", "end", "first", "last"))
    first = found.groupBy("root").agg(F.min(F.struct("of", "start")).alias("one"), F.count("*").alias("members")).where("members > 1")
    out = found.join(first, "root")
    return out.select(F.col("of").alias("doc_row"), F.lit("paragraph").alias("kind"), "start", "end", F.col("one.of").alias("class_row"), (F.struct("of", "start") != F.col("one")).alias("removed"), "first", "last")


def _repeats(own: DataFrame, least: int = LEAST_WORDS, least_passage: int = LEAST_PASSAGE) -> DataFrame:
    """SCHEMA, of ``own`` (_row, text); written."""
    bands, rows = choose_bands(float(THRESHOLD), RECALL, MOST_HASHES)
    docs = own.select("_row", F.coalesce("text", F.lit("")).alias("text"))
    cut = cut_texts(docs, bands, rows, least)
    near = frozen(near_paragraphs(docs, cut.where("bands is not null").select("_row", "of", "start", "end", "first", "last", "n", "set_hash", "bands")), "paragraphs")
    windows = remaining(cut, near.where("removed").select("doc_row", "first", "last"))
    discard(cut)
    found = runs(windows, least_passage)
    discard(windows)
    words = beside(docs, found)
    pairs = passages(found, words, least_passage)
    discard(found, words)
    out = near.drop("first", "last").unionByName(places(pairs))
    out = frozen(out, "repeats")
    discard(near, pairs)
    return out


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """Members of classes of repeated passages: doc_id, kind (paragraph, or passage within or across lines), start, end, class_id
    (doc_id of the document whose copy stays), removed."""
    own = numbered(docs).select("_row", F.col("doc")[doc_id].alias("doc_id"), F.col("doc")[text].alias("text"))
    found, ids = _repeats(own, **how), own.select(F.col("_row").alias("doc_row"), "doc_id")
    out = found.join(ids, "doc_row").join(ids.select(F.col("doc_row").alias("class_row"), F.col("doc_id").alias("class_id")), "class_row")
    return out.select("doc_row", "doc_id", "kind", "start", "end", "class_id", "removed")


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """``docs`` with the removals cut out of their texts."""
    rows = numbered(docs)
    gone = _repeats(rows.select("_row", F.col("doc")[text].alias("text")), **how).where("removed")
    gone = gone.groupBy(F.col("doc_row").alias("_row")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, own):
            if own is None or t is None:
                return t
            out, at = [], 0
            for s in own:
                out.append(t[at : max(at, s["start"])])
                at = max(at, s["end"])
            return "".join([*out, t[at:]])

        return pd.Series([one(t, o) for t, o in zip(texts, spans, strict=True)], dtype=object)

    joined = rows.join(frozen(gone, "gone"), "_row", "left").withColumn("text", cut(F.col("doc")[text], F.col("gone")))
    return joined.select(*[F.col("text").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])
