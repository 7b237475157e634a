"""License scans, hard negatives and the prefix trie against brute force, and their edge cases."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, conversation_trie, hard_negatives, licenses, queries
from tidemark.llm.common import frozen, numbered

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted(map(str, (tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))))


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_conversation_trie"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert len(got) and rows(got.astype(object)) == rows(want.astype(object))


# licenses


def base(text):
    w = WORD.findall((text or "").translate(LOWER))
    at, found = [], set()
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += here
        found |= {label} if here else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found))


def check_base(got, texts):
    assert len(got) == len(texts)
    for r in got.itertuples():
        n, places, first, last, labels = base(texts[r.doc_id])
        own = (r.n_words, r.n_base, None if pd.isna(r.first_word) else r.first_word, None if pd.isna(r.last_word) else r.last_word, r.base_labels)
        assert own == (n, places, first, last, labels)
        assert set(filter(None, labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")


def test_license_base(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    check_base(queries.QUERIES["op11_license_scan"](spark, SF).toPandas(), dict(zip(docs.doc_id, docs.text, strict=True)))


def test_license_base_in_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(licenses, "SLICE", 200)  # many slices, and texts that are longer than one
    r = random.Random(4)
    parts = ["under", "the", "mit", "license", "Apache License", "Version 2", "CC", "by", "nc", "CC-BY-NC", "İ", "mıt", "MITé", "2.0", "\x00", "中文", "x" * 40, "permission", ",", "\n"]
    texts = {i: r.choice([" ", "-", ".", ""]).join(r.choices(parts, k=r.randrange(60))) for i in range(300)}
    texts |= {1000: "", 1001: None, 1002: "under the mit license " * 500, 1003: "under the mit", 1004: "license", 1005: "Under THE MIT License"}
    got = licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).toPandas()
    check_base(got, texts)
    assert got.set_index("doc_id").n_base[1002] == 500 and got.set_index("doc_id").labels[1001] == ""


def test_license_notices(spark):
    """Every notice is found whole, with words put in, after other text; without a key phrase it isn't; and words in another order aren't."""
    r = random.Random(9)
    noise = lambda n: [f"w{r.randrange(300)}" for _ in range(n)]
    texts, wanted, absent = {}, {}, {}
    for k, t in enumerate(licenses.NOTICES):
        w = list(t.words)
        keys = {p for at, n in t.keys for p in range(at, at + n)}
        gaps = [p for p in range(1, len(w)) if not ({p - 1, p} <= keys)]
        near = [x for p, x in enumerate(w) for x in ([["Extra,", x] if gaps and p == gaps[0] else [x]][0])]
        for i, own in enumerate((w, near, noise(40) + w + noise(40))):
            texts[10 * k + i], wanted[10 * k + i] = " ".join(own).upper() if i == 1 else " ".join(own), t.label
        at, n = t.keys[0]
        texts[10 * k + 5], absent[10 * k + 5] = " ".join(w[:at] + ["zzz"] + w[at + n :]), t.label
        mixed = w[:]
        r.shuffle(mixed)
        texts[10 * k + 6], absent[10 * k + 6] = " ".join(mixed), t.label
    got = licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).toPandas().set_index("doc_id")
    for i, label in wanted.items():
        assert label in got.labels[i].split(",") and got.score[i] > 0.9, (i, texts[i])
    for i, label in absent.items():
        assert label not in got.labels[i].split(",") or label in base(texts[i])[4].split(","), (i, texts[i])


def test_license_frequencies_cover_all_documents(spark):
    texts = ["gnu gnu license", "License", None, "mit x", "gnu"]
    got = licenses.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), licenses.Index())
    assert (got["gnu"], got["license"], got["mit"], got["apache"], got[""]) == (2, 2, 1, 0, 5)


def test_license_of_nothing(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string, words string")).count() == 0


# hard negatives


def mined(data, k=5, n=10):
    """Brute force over (row, vec_id, embedding, label): like mine()."""
    good = [(r, i, [int(np.floor(256.0 * float(x))) for x in v], l) for r, i, v, l in data if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    key = lambda s: (-s[0], s[1] is None, s[1], s[2])
    out = []
    for r, i, v, l in good:
        if i is None or i % 100:
            continue
        scored = [(dot(v, w), j, q, m) for q, j, w, m in good if q != r]
        for score, j, q, _ in sorted((s for s in scored if s[3] == l), key=key)[:k]:
            fit = sorted((s for s in scored if s[3] != l and 30 * score <= 100 * s[0] <= 90 * score), key=key)[:n]
            out += [(i, j, score, rank, s[1], s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("case", ["plain", "copies", "odd", "huge"])
def test_hard_negatives_by_brute_force(spark, case, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    r = np.random.default_rng(11)
    centres = r.normal(size=(6, 8))
    data = [(i, [float(np.float32(x)) for x in centres[i % 6] + r.normal(size=8) * 0.4], int(r.integers(0, 4))) for i in range(500)]
    if case == "copies":  # a third of all rows is one vector, under few labels: ties by id
        data = [(i, data[0][1] if i % 3 == 0 else v, l % 2) for i, v, l in data]
    if case == "odd":
        data[3] = (None, data[3][1], data[3][2])
        data[4:8] = [(4, None, 1), (5, data[5][1], None), (6, [*data[6][1][:7], float("nan")], 1), (7, [None, *data[7][1][1:]], 1)]
        data[8:12] = [(8, data[8][1][:3], 0), (9, [], 2), (10, [float("inf")] * 8, 1), (10, data[11][1], 1)]
        data += [(200, data[200][1], data[200][2]), (None, data[100][1], data[100][2])]
    if case == "huge":  # beyond what floating point adds exactly
        data = [(i, [float(np.float32(x * 2.0**20)) for x in v], l) for i, v, l in data]
    table = frozen(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumns({"row": F.lit(1), "d": F.lit("x"), "norm": F.lit(0)}), "vectors-test")
    own = [(x._row, x.doc.vec_id, x.doc.embedding, x.doc.label) for x in numbered(table).collect()]
    got = hard_negatives.mine(hard_negatives.vectors(table, F.col("vec_id") % 100 == 0)).collect()
    assert sorted(str((x.anchor_id, x.positive_id, x.positive_score, x.rank, x.negative_id, x.negative_score)) for x in got) == mined(own)
    assert got


def test_brackets_hold_and_pass_rows_over(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(10, 16)) * 300
    x = (centres[r.integers(0, 10, 400)] + r.normal(size=(400, 16)) * 20).astype(int)
    own = spark.createDataFrame([(i, i, 0, v.tolist(), False, int((v * v).sum())) for i, v in enumerate(x)], "row long, id long, label long, x array<long>, anchor boolean, norm long")
    space = hard_negatives.Space(own)
    d = hard_negatives._distances(hard_negatives._augmented(x, space.most), space.pivots)
    q = np.hstack([x[7].astype(float), [0.0]])[None]
    low, high = space.brackets(float(x[7] @ x[7]), hard_negatives._distances(q, space.pivots)[0], d)
    s = x @ x[7]
    assert (low <= s).all() and (s <= high).all() and (high < np.sort(s)[-20]).mean() > 0.5


def test_no_vectors_are_broadcast(spark, monkeypatch):
    """The planner would look at the file of the anchors, not at a copy of them for each shelf."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    kept, plans, sent = hard_negatives.frozen, [], []
    monkeypatch.setattr(hard_negatives, "frozen", lambda df, name: (plans.append(df._jdf.queryExecution().sparkPlan()), kept(df, name))[1])
    r = np.random.default_rng(2)
    table = kept(spark.createDataFrame([(i, r.normal(size=4).tolist(), i % 3) for i in range(400)], "vec_id long, embedding array<double>, label int"), "vectors-test")
    assert hard_negatives.mine(hard_negatives.vectors(table, F.col("vec_id") % 100 == 0)).count()
    while plans:
        node = plans.pop()
        plans += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().startswith("Broadcast"):
            sent.append((node.left() if node.buildSide().toString() == "BuildLeft" else node.right()).schema().simpleString())
    assert sent and not [x for x in sent if "binary" in x or "array" in x]


@pytest.mark.parametrize("scale", [1.0, 2.0**8])
def test_hard_negatives_in_runs_of_blocks(spark, scale, monkeypatch):
    """Blocks of many runs, the first in pieces, some passed over; ties within and across them; scores in four and eight bytes."""
    for name, value in (("BLOCK", 64), ("RUN", 4), ("ANCHORS", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    r = np.random.default_rng(13)
    centres = r.normal(size=(9, 3))
    data = [(i, [float(np.float32(x * scale)) for x in centres[i % 9] + r.normal(size=3) * 0.2 * (i % 4)], int(r.integers(0, 3))) for i in range(900)]
    table = frozen(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(2), "vectors-test")
    own = [(x._row, x.doc.vec_id, x.doc.embedding, x.doc.label) for x in numbered(table).collect()]
    got = hard_negatives.mine(hard_negatives.vectors(table, F.col("vec_id") % 100 == 0)).collect()
    assert sorted(str((x.anchor_id, x.positive_id, x.positive_score, x.rank, x.negative_id, x.negative_score)) for x in got) == mined(own)
    assert got and hard_negatives.BATCH not in spark.conf.getAll


def test_hard_negatives_of_nothing(spark):
    for data in ([], [(1, None, 1)], [(100, [1.0], 1)]):
        table = frozen(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"), "no-vectors")
        assert hard_negatives.mine(hard_negatives.vectors(table, F.col("vec_id") % 100 == 0)).count() == 0


# the prefix trie


def trie(data):
    """Brute force over (conv_id, turn, role, text), grafted."""
    own = {}
    for c, t, role, text in data:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t), hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v, key=lambda x: (x[0][0], x[0][1] or 0, x[1]))] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    out = []
    for node, m in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(k[:-1] == n for k in members if k)]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(node))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(bool(k) and k[:-1] == node for k in members), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def built(spark, path, data):
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n", "2 AS place", "'x' AS a", "0 AS words").write.parquet(f"{path}/conversations.parquet")
    got = queries.QUERIES["op13_conversation_trie"](spark, str(path)).collect()
    return sorted(str((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)) for r in got)


def test_trie_by_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PACK_BITS", 2)
    r = random.Random(3)
    data = []
    for c in [*range(-25, 60), 2**40, 2**40 + 3, 1000]:
        for t in range(r.choice([1, 2, 3, 3, 4, 9])):
            data.append((c, t, r.choice(["user", "assistant"]), r.choice(["a b", "c", "", "d e f"])))
    data += [(7, None, None, None), (7, None, "user", "z"), (8, 1, "user", "tie"), (8, 1, "user", "tie"), (None, 0, "user", "nobody"), (61, 0, "", "user"), (62, 0, "us", "er"), (63, 5, "user", "x y z")]
    data += [(900 + i, 0, "user", "same") for i in range(60)]
    r.shuffle(data)
    assert built(spark, tmp_path, data) == trie(data)


def test_trie_of_long_conversations(spark, tmp_path, monkeypatch):
    """Running values pass over chunks, and the search takes many rounds."""
    monkeypatch.setattr(conversation_trie.running, "__defaults__", (False, 8))
    data = [(c, t, "user", f"{t} {'x' if t < 60 - 7 * c else c}") for c in range(6) for t in range(70 - 3 * c)]
    assert built(spark, tmp_path, data) == trie(data)


def test_trie_of_nothing(spark, tmp_path):
    assert built(spark, tmp_path, []) == []


def test_totals_of_a_deep_tree(spark):
    chains = spark.createDataFrame([(i, i - 1 if i else None, 1, i) for i in range(70)], "conv_id long, up long, leaves long, saved long")
    got = {r.conv_id: (r.leaves, r.saved) for r in conversation_trie.totals(chains, ("leaves", "saved")).collect()}
    assert got == {i: (70 - i, sum(range(i, 70))) for i in range(70)}


# row numbers


@pytest.mark.parametrize("poor", [False, True])
def test_row_numbers_are_places(spark, monkeypatch, poor):
    if poor:
        monkeypatch.setattr(common, "_file_key", lambda path: F.lit(1))
    d = frozen(spark.range(0, 5000, 1, 40), "files")
    got = numbered(d).select("_row", "doc.id").collect()
    assert sorted(r._row for r in got) == list(range(5000)) and all(r._row == r.id for r in got)
    assert [r._row for r in numbered(d.where("id % 7 = 0")).select("_row").distinct().collect()].__len__() == 715
