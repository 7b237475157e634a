"""Queries against brute force over the small tables."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import bpe, pii, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def run(spark, name):
    return queries.QUERIES[name](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)


def test_op2(spark, docs):
    got = run(spark, "op2_token_files")
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = [[*e.ids, 2] for e in t.encode_batch(docs.text.tolist(), add_special_tokens=False)]
    n = [len(x) for x in ids]
    assert got.n_tokens.tolist() == n
    assert got.start.tolist() == [0, *np.cumsum(n)[:-1].tolist()]
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]


def test_op5_base(spark, docs):
    got = run(spark, "op5_pii")
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        s = [int(c) for c in d[::-1]]
        return sum(s[0::2] + [sum(divmod(2 * x, 10)) for x in s[1::2]]) % 10 == 0

    def good(kind, x):
        d = re.sub("[^0-9]", "", x)
        return {"email": True, "ip": all(int(p) <= 255 for p in x.split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    for i, text in enumerate(docs.text):
        spans = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, text) if good(k, m[0])]
        shown = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert got.base_sha256[i] == hashlib.sha256(shown.encode()).hexdigest()
        assert got.spans[i].startswith(shown)
        assert [got[f"n_{k}"][i] for k in patterns] == [sum(x[0] == k for x in spans) for k in patterns]
    assert got.n_email.sum() > 0


def test_op8(spark, docs):
    got = run(spark, "op8_byte_bpe")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in enumerate(docs.text):
        ids = enc.encode_ordinary(text)
        assert got.n_tokens[i] == len(ids)
        assert got.ids_sha256[i] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_of_long_pieces():
    """Pieces of more bytes than the matrices take get the ids of the library too."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = np.random.default_rng(4)
    texts = ["".join(map(chr, r.integers(97, 123, n))) for n in (255, 256, 257, 900, 5000)] + ["ab" * 3000, "\u4e2d\u6587" * 400, "=" * 4000, "e" * 2000]
    for text, ids in zip(texts, bpe.load(P.path("byte_bpe_multi_50k.tiktoken")).encode(texts, P.PATTERN), strict=True):
        assert ids == enc.encode_ordinary(text)


def test_op9_base(spark, docs):
    got = run(spark, "op9_quality_rules")
    for i, text in enumerate(docs.text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = {}
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        rep = len({p + j for v in seen.values() if len(v) > 1 for p in v for j in range(3)})
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * rep > 50 * len(w)
        want = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, failed]
        assert got.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]].tolist() == want
        assert not (failed and got.kept[i])


def test_op4_learns(spark):
    got = queries.QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert (held.predicted == held.toxic).mean() > 0.93


def test_pii_disclosure_by_brute_force(spark):
    """Shares of all (entity, term) pairs of a small corpus, counted one by one."""
    import math
    import random

    r = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "kmp" for b in "aeiou" for c in "rstv"]
    texts = [" ".join(r.choices(vocabulary, k=30)) for _ in range(120)]
    for i in range(0, 60):
        w = texts[i].split()
        w.insert(r.randrange(30), f"name{i % 20}@host{i % 3}.org")
        texts[i] = " ".join([*w, "zebra" if i % 3 == 0 else "", f"code{'abcdefghijklmnopqrst'[i % 20]}{'abcdefghijklmnopqrst'[i % 20]}"])
    texts += texts[:5]
    sets = [{m.lower() for m in re.findall(r"[^\W\d_]{3,}", t)} for t in texts]
    owned = [{x for k, s, e in pii.base_spans(t) for x in pii.protected(k, t[s:e])} for t in texts]
    total = len(texts)
    want = {}
    for i, own in enumerate(owned):
        for c in own:
            df_c = sum(c in o for o in owned)
            for t in sets[i]:
                df = sum(t in s for s in sets)
                both = [texts[j] for j in range(total) if c in owned[j] and t in sets[j]]
                p, m = len(both) / df, df * len(set(both)) / len(both)
                low = (p + pii.Z**2 / (2 * m) - pii.Z * math.sqrt(p * (1 - p) / m + pii.Z**2 / (4 * m * m))) / (1 + pii.Z**2 / m)
                share = 1 + math.log2(low) / math.log2(total / df_c)
                if share >= 0.5:
                    want[i, t] = max(share, want.get((i, t), 0))
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    got = {(x._row, x.term): x.share for x in pii.disclosures(rows, 0.5).collect()}
    assert got.keys() == want.keys() and any(t == "zebra" for _, t in got) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_op5_sanitised_text_hides_entities(spark, docs):
    got = pii.sanitise(spark.createDataFrame([(1, "ask a@b.org or 10.0.0.1 now"), (2, "nothing here")], "doc_id long, text string")).toPandas().set_index("doc_id")
    assert got.sanitised.to_dict() == {1: "ask <EMAIL> or <IP> now", 2: "nothing here"}
