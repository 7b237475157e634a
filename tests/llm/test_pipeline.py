"""The pipeline and the learnt rules, against plain Python over sf0.001."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import pandas as pd
import public_tokenizers as P
import tiktoken
from test_brute import WORD, brute

import corpus_pipeline
from tidemark.llm import quality
from tidemark.llm.common import WHITE, frozen

SF = "/root/testdata/sf0.001"


def mixed(rows, weights=(3, 1, 2), share=1.5, most=2):
    """{doc_id: copies} by raising a common level until nothing is left to share."""
    size = {i: len(WORD.findall(t)) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = share * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: most * total[s] for s in over}
        left -= sum(most * total[s] for s in over)
        open_ -= over
    out = {}
    for i, _, s in rows:
        rate = target[s] / total[s] if total[s] else 0.0
        draw = int(hashlib.md5(f"{i}:mix-1".encode()).hexdigest()[:13], 16) / 16**13
        out[i] = math.floor(rate) + (draw < rate - math.floor(rate))
    return out


def test_pipeline_by_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).toPandas().sort_values("doc_id")
    assert 0 < len(kept) <= len(docs)
    seen = {}
    for i, t in zip(kept.doc_id, kept.text, strict=True):
        seen.setdefault(re.sub(WHITE, " ", t or ""), i)
    kept = kept[kept.doc_id.isin(seen.values())]
    classes, _ = brute(dict(zip(kept.doc_id, kept.text, strict=True)))
    kept = kept[kept.doc_id.isin(set(classes.values()))]
    copies = mixed(list(zip(kept.doc_id, kept.text, kept.source, strict=True)))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in zip(kept.doc_id, kept.text, strict=True):
        if copies[i]:
            want[i, tuple(enc.encode_ordinary(t))] += copies[i]
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(got) > 50


def test_stages_bound_batches_by_bytes(spark):
    sizes = lambda: spark.range(0, 40, 1, 1).selectExpr("repeat('a', 1000000) text").mapInPandas(lambda bs: (pd.DataFrame({"n": [b["text"].str.len().sum()]}) for b in bs), "n long").toPandas().n
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    try:
        for stage in (corpus_pipeline.drop_copies, corpus_pipeline.encode):
            spark.conf.unset(corpus_pipeline.BATCH)
            stage(spark, docs, SF)
            assert sizes().max() <= 8_000_000 and sizes().sum() == 40_000_000
        spark.conf.set(corpus_pipeline.BATCH, "12m")  # the session's own limit stays
        corpus_pipeline.encode(spark, docs, SF)
        assert spark.conf.get(corpus_pipeline.BATCH) == "12m"
    finally:
        spark.conf.unset(corpus_pipeline.BATCH)


def test_rules_by_brute_force(spark):
    """The first rule that holds, condition by condition, on statistics counted in Python."""
    r = random.Random(4)
    texts = []
    for i in range(300):
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(60, 200))]
        texts.append(" ".join(w + ["#$%"] * (30 if i % 5 == 0 else 0) + ["same old words"] * (25 if i % 7 == 0 else 0)))
    d = frozen(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "rules")
    rules = quality.fit(d, spark.createDataFrame([(i, int(i % 5 != 0 and i % 7 != 0)) for i in range(300)], "doc_id long, quality int"))
    assert rules.rules
    stats = {x.doc_id: x.asDict() for x in quality.statistics(d).collect()}
    for i, t in enumerate(texts):
        assert stats[i]["n_words"] == len(WORD.findall(t)) and stats[i]["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
    for x in quality.judge(d, rules).collect():
        own = stats[x.doc_id]
        first = next((k for k, rule in enumerate(rules.rules, 1) if all((own[c.feature] > c.threshold) == c.above for c in rule)), 0)
        assert x.rule == first and x.kept == (not x.base_failed and first == 0)
    wrong = sum(x.kept == (x.doc_id % 5 == 0 or x.doc_id % 7 == 0) for x in quality.judge(d, rules).where("not base_failed").collect())
    assert wrong <= 15
