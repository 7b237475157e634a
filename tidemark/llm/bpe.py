"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

Texts are split by the tokenizer's pattern.  The different pieces of a batch that aren't known yet are put into matrices
of byte ids, one for each bucket of lengths (powers of two), padded at the right.  Each round, every row merges its leftmost pair
of least rank: ranks come from a hashed pair table, and the row is compacted by a gather.  Finished rows leave the matrix.
Pieces of over LONG bytes, for which a round a merge would be quadratic, take the same merges from a heap.

Pieces are remembered in a table of bounded size per Python worker; the work is narrow, with no shuffle.

Edge cases: a null text is empty and has no ids; repeated rows get equal results; very long texts are read whole, a batch
at a time; other columns, whatever their names, aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pieces import split

LONG = 256
KNOWN = 200_000
BATCH_CHARS = 500_000
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open addressing over (left id, right id); -1 marks an empty slot."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(left), 1) * 2 + 1))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, left_over = self._slot(keys), np.arange(len(keys))
        while len(left_over):
            free = self.keys[slot[left_over]] < 0
            first = np.unique(slot[left_over[free]], return_index=True)[1]
            placed = left_over[free][first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], merged[placed]
            left_over = left_over[self.keys[slot[left_over]] != keys[left_over]]
            slot[left_over] = (slot[left_over] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id (that is, rank) of each merged pair; NONE where the pair doesn't merge."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out, slot = np.full(keys.shape, NONE, np.int32), self._slot(keys)
        todo = np.nonzero((left >= 0) & (right >= 0))
        while len(todo[0]):
            at = slot[todo]
            found, there = keys[todo], self.keys[at]
            out[todo] = np.where(there == found, self.values[at], out[todo])
            more = (there != found) & (there >= 0)
            todo = tuple(x[more] for x in todo)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out


class Bpe:
    """The merges and byte strings of a rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.digits = {i: str(i) for i in self.bytes_of}
        self.start = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a, b, r) for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
        self.table = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        self.known: dict[str, bytes] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, 32 bits each: a third of what tuples of them would hold."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = np.int32(r).tobytes()
            elif len(p) > LONG:
                out[i] = self._by_heap(p)
            else:
                buckets.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            step = max(1, 1_000_000 // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._merge_rows([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = self.start[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = flat
        ranks = self.table.find(ids[:, :-1], ids[:, 1:])
        out: list = [None] * len(pieces)
        rows, column = np.arange(len(pieces)), np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            if (over := best == NONE).any():
                for row, line in zip(rows[over], ids[over], strict=True):
                    out[row] = line[line >= 0].tobytes()
                rows, ids, ranks, at, best = (x[~over] for x in (rows, ids, ranks, at, best))
                if not len(rows):
                    break
            each = np.arange(len(rows))
            # compaction: what is right of the merged pair moves one to the left
            ids = np.take_along_axis(ids, np.minimum(column + (column > at[:, None]), width - 1), 1)
            ids[:, -1] = -1
            ids[each, at] = best
            ranks = np.take_along_axis(ranks, np.minimum(column[:-1] + (column[:-1] > at[:, None]), width - 2), 1)
            ranks[:, -1] = NONE
            right = np.where(at + 1 < width, ids[each, np.minimum(at + 1, width - 1)], -1)
            ranks[each, np.minimum(at, width - 2)] = np.where(at <= width - 2, self.table.find(best, right), NONE)
            before = np.nonzero(at > 0)[0]
            ranks[before, at[before] - 1] = self.table.find(ids[before, at[before] - 1], best[before])
        return out

    def _by_heap(self, piece: bytes) -> bytes:
        """The same merges, leftmost of least rank first, in O(n log n)."""
        ids = [int(self.start[b]) for b in piece]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank = lambda i: self.ranks.get(self.bytes_of[ids[i]] + self.bytes_of[ids[after[i]]]) if after[i] < len(ids) else None
        heap = [(r, i) for i in range(len(ids)) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (x := rank(k)) is not None:
                    heapq.heappush(heap, (x, k))
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def encode(self, texts: list[str], pattern: str) -> Iterator[list[int]]:
        """Ids of each text; the new pieces of all of them are merged together."""
        parts = [split(t, pattern) for t in texts]
        if len(self.known) > KNOWN:
            self.known.clear()
        new = list(set().union(*parts) - self.known.keys())
        self.known.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        for p in parts:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, p)), np.int32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache
def load(path: str) -> Bpe:
    """Once per Python worker; ``path`` must exist on each node, as an installed package does."""
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def chunks(texts: list[str], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (if asked for), ids_sha256 of the decimal ids, decoded_sha256 of the bytes decoded from the ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for b in batches:
            texts = b["text"].tolist()
            for lo, hi in chunks(texts):
                own, rows = b.iloc[lo:hi], []
                for found in bpe.encode(texts[lo:hi], pattern):
                    shown = ",".join(map(bpe.digits.__getitem__, found))
                    rows.append((len(found), *([found] if ids else []), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(bpe.decode(found)).hexdigest()))
                out = pd.DataFrame(rows, columns=["n_tokens", *(["ids"] if ids else []), "ids_sha256", "decoded_sha256"])
                out.insert(0, "doc_id", own["doc_id"].array)
                yield out

    kind = docs.select(doc_id).dtypes[0][1]
    schema = "doc_id string, n_tokens long, " + "ids array<int>, " * ids + "ids_sha256 string, decoded_sha256 string"
    # ids pass as strings: pandas would make floats of integers with nulls among them
    own = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of the ids; bytes that aren't UTF-8 become U+FFFD."""

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        bpe = load(path)
        return pd.Series([bpe.decode([int(i) for i in x]).decode("utf-8", "replace") for x in ids], dtype=object)

    return encoded.select("doc_id", text_of("ids").alias("text"))
