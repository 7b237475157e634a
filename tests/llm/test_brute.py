"""Near-duplicate operators against brute force over sf0.001 and a planted large group."""

import random
import re
import time
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import common, minhash, ngram_join, queries, substring_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    ids, parent, links = sorted(texts), {i: i for i in texts}, defaultdict(set)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
                if sets[a] != sets[b]:
                    links[a].add(sets[b])
                    links[b].add(sets[a])
    return {i: root(i) for i in ids}, {i: len(links[i]) for i in ids}


def check(got, texts):
    classes, links = brute(texts)
    got = got.set_index("doc_id")
    assert got.class_id.to_dict() == classes and got.n_links.to_dict() == links


def test_op6(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    check(queries.op6_ngram_join(spark, SF).toPandas(), dict(zip(d.doc_id, d.text, strict=True)))


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    texts = {}
    for i in range(120):
        own = base[:]
        for _ in range(r.randrange(3)):
            own[r.randrange(120)] = f"n{i}"
        texts[i] = " ".join(own)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(ngram_join.ngram_join(rows).toPandas(), texts)


def words_of(r, n, size=3000):
    return [f"w{r.randrange(size)}" for _ in range(n)]


def spans(spark, texts):
    got = substring_dedup.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    return got[["doc_id", "start", "end", "removed"]]


@pytest.mark.parametrize("n", [50, 51, 52, 55, 60, 80])
def test_op10_finds_every_passage_whole(spark, n):
    """Exact passages in the middle of lines: every one is found, to its ends, once kept and once removed."""
    r = random.Random(n)
    texts = [" ".join(words_of(r, 120)) for _ in range(40)]
    for _ in range(60):
        p = words_of(r, n)
        texts += [" ".join([*words_of(r, 40), *p, *words_of(r, 40)]) for _ in range(2)]
    got = spans(spark, texts)
    assert (got.doc_id >= 40).all() and len(got) == 120 and got.groupby(got.doc_id // 2).removed.sum().eq(1).all()
    found = [len(texts[d][s:e].split()) for d, s, e in zip(got.doc_id, got.start, got.end)]
    assert min(found) >= n and max(found) <= n + 1  # a word beside a passage may be equal by chance


@pytest.mark.parametrize("n", [51, 60, 80, 100])
def test_op10_finds_near_passages(spark, n):
    """Passages with as many words changed as a similarity of 0.8 allows."""
    r = random.Random(n)
    texts = [" ".join(words_of(r, 120)) for _ in range(40)]
    for _ in range(60):
        p = words_of(r, n)
        q, changes = p[:], n // 45
        for k in range(changes):
            q[(k + 1) * n // (changes + 1)] = "changed"
        texts += [" ".join([*words_of(r, 40), *x, *words_of(r, 40)]) for x in (p, q)]
    got = spans(spark, texts)
    assert (got.doc_id >= 40).all() and got.doc_id.nunique() == 120 and got[got.removed].groupby("doc_id").size().eq(1).all()
    assert min(len(texts[d][s:e].split()) for d, s, e in zip(got.doc_id, got.start, got.end)) >= n - 1


def test_op10_leaves_shared_phrases(spark):
    """Runs of under LEAST_PASSAGE words stay."""
    r = random.Random(2)
    p = words_of(r, substring_dedup.LEAST_PASSAGE - 2)
    assert not len(spans(spark, [" ".join([*words_of(r, 60), *p, *words_of(r, 60)]) for _ in range(10)]))


def test_op10_near_lines_by_brute_force(spark):
    """Lines of 25 to 60 words, some with changes: classes are the components of exact Jaccard similarity of at least 0.8."""
    r = random.Random(12)
    lines = []
    for _ in range(80):
        base = words_of(r, r.randrange(25, 60), 400)
        for _ in range(r.randrange(1, 4)):
            own = base[:]
            for _ in range(r.randrange(3)):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            lines.append(" ".join(own))
    classes, _ = brute(dict(enumerate(lines)))
    got = substring_dedup.substring_dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("kind = 'paragraph'").toPandas()
    sizes = pd.Series(classes).value_counts()
    assert set(got.doc_id) == {i for i in classes if sizes[classes[i]] > 1}
    assert got.groupby(got.doc_id.map(classes)).class_id.nunique().eq(1).all() and (~got.removed).sum() == (sizes > 1).sum()


def test_op10_removals_leave_one_copy(spark):
    r = random.Random(6)
    p = " ".join(words_of(r, 70))
    texts = [" ".join(words_of(r, 30)) + f" {p} " + " ".join(words_of(r, 30)) for _ in range(5)]
    out = substring_dedup.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    assert sum(p in t for t in out.text) == 1 and all(len(t.split()) in (60, 130) for t in out.text)


def test_op10_patchwork_is_no_passage(spark):
    """Three documents with a run of 30 words each, and one with the three runs one after the other: no two share more than 30 words."""
    r = random.Random(8)
    parts = [words_of(r, 30) for _ in range(3)]
    texts = [" ".join([*words_of(r, 50), *p, *words_of(r, 50)]) for p in parts] + [" ".join([*words_of(r, 50), *sum(parts, []), *words_of(r, 50)])]
    assert not len(spans(spark, texts))


def test_op10_adjoining_runs_by_brute_force(spark):
    """Documents made of pieces of 20 to 70 words that others hold too, side by side: a removed passage is text that one document before it holds."""
    r = random.Random(21)
    pieces = [[f"p{k}w{i}" for i in range(r.choice([20, 30, 45, 70]))] for k in range(16)]
    docs = []
    for d in range(20):
        out = [f"d{d}x{i}" for i in range(15)]
        for n in range(r.randrange(2, 5)):
            out += r.choice(pieces) + [f"d{d}n{n}x{i}" for i in range(r.choice([0, 0, 12]))]
        docs.append(out)

    def run(d, i, e, k):
        n = 0
        while i + n < len(docs[d]) and k + n < len(docs[e]) and docs[d][i + n] == docs[e][k + n] and (d, i) != (e, k):
            n += 1
        return n

    got = substring_dedup.substring_dedup(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).toPandas()
    got = got[(got.kind == "passage") & got.removed]
    for d, s, e in zip(got.doc_id, got.start, got.end):
        starts = [0]
        for w in docs[d]:
            starts.append(starts[-1] + len(w) + 1)
        first, last = starts.index(s), starts.index(e + 1)
        # places of several partners that overlap by half are one, so each word needs a long common run of its own
        covered = set()
        for i in range(first, last):
            for other in range(d + 1):
                for k in (k for k, w in enumerate(docs[other]) if w == docs[d][i]):
                    n = run(d, i, other, k)
                    if n >= substring_dedup.LEAST_PASSAGE:
                        covered |= set(range(i, i + n))
        assert covered >= set(range(first, last)), (d, first, last)
    assert len(got) > 5


def test_op10_classes_are_components(spark):
    """Each copy of a passage has a row: the first stays, and all have its class."""
    r = random.Random(4)
    p, q = words_of(r, 60), words_of(r, 55)
    texts = [" ".join([*words_of(r, 40 + i), *(p if i % 2 else q), *words_of(r, 30)]) for i in range(9)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    assert len(got) == 9 and set(got[~got.removed].doc_id) == {0, 1} and (got.class_id == got.doc_id % 2).all()


def test_runs_of_windows_at_one_distance():
    r, width = np.random.default_rng(5), substring_dedup.WINDOW
    lists = [np.array([(int(a) << 32) | int(t) for a, t in zip(r.integers(0, 60, n), r.integers(0, 60, n), strict=True)], np.int64) for n in (1, 40, 3, 200)]
    for windows, got in zip(lists, substring_dedup._one_distance(lists), strict=True):
        own = []
        for d, at in sorted(((int(w) & 0xFFFFFFFF) - (int(w) >> 32), int(w) >> 32) for w in windows):
            if own and own[-1][2] - own[-1][0] == d and at <= own[-1][1]:
                own[-1][1] = max(own[-1][1], at + width)
            else:
                own.append([at, at + width, at + d])
        assert sorted(map(tuple, own)) == got
    assert list(substring_dedup._one_distance([])) == []


def test_substring_dedup_removes_what_was_used(spark, monkeypatch):
    there = {}
    for name in ("runs", "passages", "places"):
        own = getattr(substring_dedup, name)
        monkeypatch.setattr(substring_dedup, name, lambda *a, own=own, name=name: (there.update({name: {x.rsplit("/", 1)[1].rsplit("-", 1)[0] for x in common._written - before}}), own(*a))[1])
    before = set(common._written)
    text = " ".join(f"w{i}" for i in range(60))
    got = substring_dedup.substring_dedup(spark.createDataFrame([(i, f"a{i} b{i} {text} c{i}") for i in range(3)], "doc_id long, text string"))
    assert got.where("removed").count() == 2
    assert "cut-texts" not in there["runs"] and "windows" not in there["passages"] and not {"runs", "surroundings"} & there["places"]


def few_blocks(r, n, most):
    """Blocks (rows, copies, sides, sets, buckets, bucket, across) of near copies."""
    blocks = []
    for k in range(n):
        size, base, sets = int(r.integers(2, most + 1)), r.integers(0, 2**40, 60).astype(np.uint64), []
        for _ in range(size):
            x, c = base.copy(), int(r.integers(0, 12))
            x[r.integers(0, 60, c)] = r.integers(0, 2**40, c).astype(np.uint64)
            sets.append(np.unique(x[: int(r.integers(40, 61))]).tobytes())
        bucket = int(r.integers(-5, 5))
        own = [np.unique(np.append(r.integers(-40, 40, 3), bucket)) for _ in sets]
        blocks.append((r.permutation(10**6)[:size].astype(np.int64), r.integers(1, 5, size), r.integers(0, 2, size), sets, own, bucket, bool(k % 2)))
    return blocks


def test_few_members_are_compared_together_as_alone():
    r, threshold = np.random.default_rng(1), minhash.THRESHOLD
    blocks = few_blocks(r, 100, minhash.FEW)
    want = pd.concat([minhash._compare(*b, threshold) for b in blocks])
    assert len(want) > 100 and (want.to_numpy() == minhash._compare_few(blocks, threshold)[want.columns].to_numpy()).all()
    apart = [(*b[:3], [np.array([i], np.uint64).tobytes() for i in range(len(b[3]))], *b[4:]) for b in blocks[:3]]
    assert len(minhash._compare_few(apart, threshold)) == 0
    # pairs, the most of all blocks: one by one they took a sixth of op10's time
    pairs, times = few_blocks(r, 1000, 2), []
    for f in (lambda: [minhash._compare(*b, threshold) for b in pairs], lambda: minhash._compare_few(pairs, threshold)):
        begin = time.process_time()
        f()
        times.append(time.process_time() - begin)
    assert 2 * times[1] < times[0]


def test_windows_of_several_texts():
    r = np.random.default_rng(2)
    texts = [r.integers(0, 2**64, n, np.uint64) for n in (*range(11, 21), 11, 11, 200, 1000, 16, 15)] + [r.integers(0, 3, n).astype(np.uint64) for n in range(11, 60)]
    for own in (texts, texts[::-1], texts[:1], texts[5:6]):
        at, keys, counts = substring_dedup.windows_of(own)
        want = [substring_dedup.anchors(t) for t in own]
        assert counts.tolist() == [len(w) for w in want] and at.tolist() == [a for w in want for a in w]
        assert keys.tolist() == [k for t, w in zip(own, want, strict=True) for k in substring_dedup.window_keys(t, w)]


def test_surroundings_of_several_texts():
    far = substring_dedup.SPREAD
    words = [minhash.located_words(" ".join(f"w{i}" for i in range(n))) for n in (11, 12, 40)]
    ends = [np.array([(a << 32) | b for a in range(len(w[0])) for b in range(a + 1, len(w[0]) + 1)], np.int64) for w in words]
    got = substring_dedup._beside([7, 8, 9], words, ends).to_dict("records")
    cases = [(of, w, a, b) for of, w in zip((7, 8, 9), words, strict=True) for a in range(len(w[0])) for b in range(a + 1, len(w[0]) + 1)]
    for x, (of, (hashes, starts, stops, _), a, b) in zip(got, cases, strict=True):
        assert (x["of"], x["at"], x["to"]) == (of, a, b)
        assert x["left"] == hashes[max(0, a - far) : a][::-1].astype("<u4").tobytes() and x["right"] == hashes[b : b + far].astype("<u4").tobytes()
        assert x["left_places"] == starts[max(0, a - far) : a + 1][::-1].astype("<i4").tobytes() and x["right_places"] == stops[b - 1 : b + far].astype("<i4").tobytes()


def test_places_as_numbers_and_as_structs(spark):
    rows = [(1, 5, 7), (1, 5, 9), (1, 3, 1000), (2, 2**40, 0), (2, 2**40, 3), (3, 0, 0)]
    windows = spark.createDataFrame(rows, "key long, of long, at int")
    for bits, kind in ((63, "bigint"), (50, "struct<of:bigint,at:int>")):
        place, of, at = substring_dedup._places_of(windows, bits)
        got = windows.groupBy("key").agg(substring_dedup.F.min(place).alias("a"), substring_dedup.F.max(place).alias("b"))
        assert got.dtypes[1][1] == kind
        got = got.select("key", *[f(substring_dedup.F.col(c)) for c in "ab" for f in (of, at)]).collect()
        assert {tuple(x) for x in got} == {(1, 3, 1000, 5, 9), (2, 2**40, 0, 2**40, 3), (3, 0, 0, 0, 0)}
    substring_dedup._places_of(windows.limit(0))
