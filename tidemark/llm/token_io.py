"""Token ids as canonical length-limited Huffman codes in independent blocks.

Ids are counted over the whole corpus (per-task histograms, summed by id); package-merge gives code lengths of at
most LIMIT bits; the lengths alone, with ids in ascending order, give the canonical codes.  Documents are dealt by ranges of
doc_id to shards; a shard is a run of blocks, and a block holds whole documents of about BLOCK tokens.  Each block keeps the bit
offset of every STRIDE-th token, so decoding runs from all checkpoints at once, one table look-up a step, and any block
can be read alone.

A data set is a folder with two tables: ``codes`` (id, length), of at most one row per id of the vocabulary, and ``blocks`` (shard,
block, start in the shard, ids and lengths of its documents, checkpoints, payload).  Blocks are binary columns of Parquet files,
since executors reach a shared store only through Spark.

Edge cases: a null text is empty, and has the end id alone; null ids sort last; repeated rows are written once each; ids may be of any type that casts to a
string and back; a document longer than a block makes a longer block; other columns, whatever their names, aren't read; an empty table gives empty tables.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import chunks
from tidemark.llm.common import frozen, scratch
from tidemark.llm.pieces import is_plain, splitter

LIMIT = 20
BLOCK = 65_536
STRIDE = 128
#: Ids a shard, at most and (where there are fewer shards than eight for each core) at least.
SHARD_TOKENS = 64_000_000
LEAST_SHARD_TOKENS = 1_000_000
KNOWN = 500_000
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# --- codes ---


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal prefix-code lengths of at most ``limit`` bits by package-merge; 0 for ids that don't occur."""
    ids = np.nonzero(counts)[0]
    out = np.zeros(len(counts), np.int64)
    if len(ids) < 2:
        out[ids] = 1
        return out
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids need codes of more than {limit} bits")
    ids = ids[np.argsort(counts[ids], kind="stable")]
    leaves, packages, is_leaf = counts[ids].astype(np.int64), np.zeros(0, np.int64), []
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        order = np.argsort(merged, kind="stable")
        is_leaf.append(order < len(leaves))
        merged = merged[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * (len(ids) - 1)
    for level in reversed(is_leaf):
        n = int(level[:take].sum())
        out[ids[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes by id, ids in the order of their codes)."""
    ids = np.nonzero(lengths)[0]
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    own = lengths[ids]
    width = int(own[-1]) if len(own) else 0
    ends = np.cumsum(np.left_shift(1, width - own))
    codes = np.zeros(len(lengths), np.int64)
    codes[ids] = (ends - np.left_shift(1, width - own)) >> (width - own)
    return codes, ids


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> tuple[bytes, bytes]:
    """(checkpoints as little-endian unsigned 32-bit bit offsets, payload)."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    if len(ends) and ends[-1] >= 1 << 32:
        raise ValueError("a block of over 4 Gbit")
    at = ends - size
    words = int(ends[-1] + 31) // 32 + 1 if len(ids) else 1
    slot, shift = at >> 5, (64 - size - (at & 31)).astype(np.uint64)
    both = codes[ids].astype(np.uint64) << shift
    # codes don't overlap, so sums are unions; each sum is below 2**32 and exact in a double
    out = np.bincount(slot, (both >> np.uint64(32)).astype(np.float64), words + 1)
    out += np.bincount(slot + 1, (both & np.uint64(0xFFFFFFFF)).astype(np.float64), words + 1)
    return at[::stride].astype("<u4").tobytes(), out[:words].astype(np.int64).astype(">u4").tobytes()


class Decoder:
    """One table of 2**width entries: the id and the code length for each possible next ``width`` bits."""

    def __init__(self, lengths: np.ndarray):
        _, ids = canonical_codes(lengths)
        own = lengths[ids]
        self.width = max(1, int(own.max())) if len(own) else 1
        spans = np.left_shift(1, self.width - own)
        pad = (1 << self.width) - int(spans.sum())
        self.ids = np.concatenate([np.repeat(ids, spans), np.zeros(pad, np.int64)]).astype(np.int32)
        self.sizes = np.concatenate([np.repeat(own, spans), np.ones(pad, np.int64)]).astype(np.int32)

    def block(self, checkpoints: bytes, payload: bytes, n: int, stride: int = STRIDE) -> np.ndarray:
        if not n:
            return np.zeros(0, np.int32)
        b = np.frombuffer(payload + b"\0" * 8, np.uint8)
        # 32 bits from each byte on; a code of 20 bits at most and 7 bits before it fit
        window = np.zeros(len(b) - 4, np.uint32)
        for k in range(4):
            window[k::4] = np.frombuffer(b, ">u4", (len(b) - 4 - k + 3) // 4, k) if len(b) - 4 > k else 0
        at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
        out = np.zeros((min(stride, n), len(at)), np.int32)
        drop, last, left = np.uint32(32 - self.width), len(window) - 1, n - (len(at) - 1) * stride
        for k in range(len(out)):
            lanes = slice(None) if k < left else slice(0, len(at) - 1)
            p = at[lanes]
            key = (window[np.minimum(p >> 3, last)] << (p & 7).astype(np.uint32)) >> drop
            out[k, lanes] = self.ids[key]
            at[lanes] += self.sizes[key]
        out = out.T
        return out.reshape(-1)[: n]


@lru_cache(4)
def _decoder(lengths: bytes) -> Decoder:
    return Decoder(np.frombuffer(lengths, np.uint8).astype(np.int64))


# --- encoding texts by the library ---


@lru_cache
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache
def _added(path: str) -> tuple[str, ...]:
    """Contents of the tokenizer's added tokens, which the library finds in texts before it splits them."""
    return tuple(x["content"] for x in json.loads(_library(path).to_str())["added_tokens"])


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others follow U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class PieceIds(dict):
    """Packed ids of pieces by the library's model, remembered up to a bound."""

    def __init__(self, path: str, code: str):
        self.model, self.letters, self.code = _library(path).model, _byte_letters(), code
        self.blank = self.letters[0x20]

    def __missing__(self, piece: str) -> bytes:
        if len(self) > KNOWN:
            self.clear()
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", self.blank)
        else:
            shown = piece.encode().decode("latin-1").translate(self.letters)
        self[piece] = out = array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()
        return out


@lru_cache
def _pieces(path: str, code: str) -> PieceIds | None:
    """None unless the tokenizer splits by the byte-level pattern and nothing else."""
    made = json.loads(_library(path).to_str())
    step = made["pre_tokenizer"] or {}
    plain = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
    return PieceIds(path, code) if plain and not made["normalizer"] and made["model"].get("type") == "BPE" else None


def library_ids(texts: list[str], path: str, code: str) -> Iterator[bytes]:
    """Packed ids of whole texts, as encode(text, add_special_tokens=False) gives them.  A byte-level tokenizer splits first, and
    encodes each piece alone; so the library's model is asked once for each different piece.  Texts with characters outside
    the settled blocks, on whose classes patterns may differ, those with the content of an added token, and those of other tokenizers,
    are encoded by the library whole."""
    known, added = _pieces(path, code), _added(path)
    for text in texts:
        if known is not None and is_plain(text) and not any(x in text for x in added):
            yield b"".join(map(known.__getitem__, splitter(BYTE_LEVEL_PATTERN)[0].findall(text)))
        else:
            yield array(code, _library(path).encode(text, add_special_tokens=False).ids).tobytes()


def tokenize(docs: DataFrame, path: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens (with the end id), ids (packed, 16 bits each if the vocabulary allows); written once to the shared folder."""
    code = "H" if vocabulary(path, end_id) <= 1 << 16 else "I"
    end = array(code, [end_id]).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [x + end for x in library_ids(b["text"].tolist(), path, code)]
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "n_tokens": [len(x) // len(end) for x in ids], "ids": ids})

    kind = docs.select(doc_id).dtypes[0][1]
    # ids pass as strings: pandas would make floats of integers with nulls among them
    own = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = own.mapInPandas(run, "doc_id string, n_tokens long, ids binary")
    return frozen(out.withColumn("doc_id", F.col("doc_id").cast(kind)), "tokens")


def vocabulary(path: str, end_id: int) -> int:
    return max(_library(path).get_vocab_size(), end_id + 1)


# --- files ---


def write(tokens: DataFrame, folder: str, size: int, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write a data set of ``tokens`` (doc_id, n_tokens, ids), in ascending doc_id order; ``size``: of the vocabulary."""
    kind = np.uint16 if size <= 1 << 16 else np.uint32

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for b in batches:
            texts = b["ids"].tolist()
            for lo, hi in chunks(texts):
                total += np.bincount(np.frombuffer(b"".join(texts[lo:hi]), kind), minlength=size)
        yield pd.DataFrame({"id": np.nonzero(total)[0].astype(np.int32), "n": total[total > 0]})

    spark = tokens.sparkSession
    sums = tokens.select("ids").mapInPandas(histogram, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row per id of the vocabulary at most
    counts = np.zeros(size, np.int64)
    for r in sums:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    own = np.nonzero(lengths)[0]
    spark.createDataFrame(pd.DataFrame({"id": own.astype(np.int32), "length": lengths[own].astype(np.int32)}), "id int, length int").coalesce(1).write.parquet(f"{folder}/codes")
    codes, short = canonical_codes(lengths)[0], lengths.astype(np.uint8)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, start, ids, docs, held = 0, 0, [], [], 0

        def done() -> pd.DataFrame:
            joined = np.concatenate(ids)
            checkpoints, payload = encode_block(joined, codes, short)
            return pd.DataFrame({"shard": [shard], "block": [block], "start": [start], "doc_ids": [docs], "doc_tokens": [[len(x) for x in ids]], "checkpoints": [checkpoints], "payload": [payload]})

        for b in batches:
            for shard, d, x in zip(b["shard"], b["doc_id"], b["ids"], strict=True):
                ids.append(np.frombuffer(x, kind))
                docs.append(d)
                held += len(ids[-1])
                if held >= BLOCK:
                    yield done()
                    block, start, ids, docs, held = block + 1, start + held, [], [], 0
        if ids:
            yield done()

    total = int(counts.sum())
    shards = max(1, -(-total // shard_tokens), min(8 * spark.sparkContext.defaultParallelism, total // LEAST_SHARD_TOKENS))
    # the hash spreads null and repeated ids over ranges
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("ids")]
    dealt = tokens.repartitionByRange(shards, *order).sortWithinPartitions(order[0], "ids")
    schema = "shard int, block int, start long, doc_ids array<string>, doc_tokens array<int>, checkpoints binary, payload binary"
    out = dealt.select(F.spark_partition_id().alias("shard"), F.col("doc_id").cast("string").alias("doc_id"), "ids").mapInPandas(pack, schema)
    out.withColumn("doc_ids", F.col("doc_ids").cast(f"array<{dict(tokens.dtypes)['doc_id']}>")).write.parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit), from the files.
    With ``digest``, ids_crc32 of these bytes instead of ids."""
    book = spark.read.parquet(f"{folder}/codes").collect()
    lengths = np.zeros(max([r["id"] for r in book], default=-1) + 1, np.uint8)
    for r in book:
        lengths[r["id"]] = r["length"]
    packed = lengths.tobytes()
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # one row per shard, written so that its size is known to the planner
    offsets = frozen(totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("offset")), "offsets")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = _decoder(packed)
        for b in batches:
            for r in b.itertuples():
                sizes = np.asarray(r.doc_tokens, np.int64)
                ends = np.cumsum(sizes)
                ids = decoder.block(r.checkpoints, r.payload, int(ends[-1])).astype("<u4")
                ids = [ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                shown = {"ids_crc32": [zlib.crc32(x) for x in ids]} if digest else {"ids": [x.tobytes() for x in ids]}
                yield pd.DataFrame({"doc_id": list(r.doc_ids), "start": r.offset + r.start + ends - sizes, "n_tokens": sizes} | shown)

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    out = blocks.join(offsets, "shard").select("offset", "start", F.col("doc_ids").cast("array<string>").alias("doc_ids"), "doc_tokens", "checkpoints", "payload").mapInPandas(unpack, "doc_id string, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def round_trip(docs: DataFrame, path: str, end_id: int, digest: bool = False, **how) -> DataFrame:
    """Write all documents as coded token ids to the shared folder, and read them back from the files."""
    spark = docs.sparkSession
    folder = scratch(spark, "coded")
    write(tokenize(docs, path, end_id, **how), folder, vocabulary(path, end_id))
    return read(spark, folder, digest)

