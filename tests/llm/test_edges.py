"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names: each operator and stage has a defined result."""

import os
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, exact_dedup, mixing, ngram_join, pii, quality, substring_dedup, token_io, toxicity, warc
from tidemark.llm.common import discard, frozen, numbered

R = random.Random(3)
VOCAB = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 9))) for _ in range(900)]


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


LONG = prose(30_000, 7)
ROWS = [
    (1, prose(80, 1), "en", "a", 1, 0), (2, prose(80, 1), "en", "a", 1, 0), (2, prose(80, 1), "en", "a", 1, 0), (None, prose(80, 1), None, None, None, None),
    (4, None, "en", "b", 1, 0), (5, "", None, "b", None, None), (6, " \n\t ", "en", None, 1, 0), (7, LONG, "en", "a", 1, 0), (8, LONG + " x", "en", "a", 1, 0),
    (9, "one two", "en", "c", 0, 0), (10, prose(60, 2) + "\n" + prose(60, 3), "en", "c", 1, 0), (11, prose(40, 9) + " " + prose(60, 3) + " " + prose(40, 10), "en", "c", 1, 0), (12, "x" * 5000, "en", "c", 0, 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, kept boolean, terms int, copies int, features int, names int, root int, doc string, prediction double, _score double, _tm_row long, score double, gone int, keys int, of int, at int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r[:4], None if r[1] is None else len(r[1]), 0, True, 1, 1, 1, 1, 1, "d", 0.0, 9.0, 7, 8.0, 1, 1, 1, 1) for r in ROWS]
    return frozen(spark.createDataFrame(rows, SCHEMA), "edges")


@pytest.fixture(scope="module")
def none(spark):
    return frozen(spark.createDataFrame([], SCHEMA), "no-edges")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 0, 1), (9, 0, 1), (None, 0, 1), (10, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))], ids=["good hash", "poor hash"])
def test_exact_dedup(docs, hashed):
    got = exact_dedup.exact_dedup(docs, block_chars=64, hashed=hashed).toPandas().sort_values("_row")
    assert len(got) == len(ROWS) and got.kept.sum() == got.text_sha256.nunique()
    for _, g in got.groupby("text_sha256"):
        assert g.kept.sum() == 1 and (g.group_size == len(g)).all() and (g.keep_id == g.doc_id.min()).all()
    assert got[got.doc_id.isin([4, 5])].keep_id.tolist() == [4, 4]
    assert got[got.doc_id == 6].group_size.tolist() == [1]  # one blank isn't empty
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == got.kept.sum()


def test_exact_dedup_of_nothing(none):
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_block_names_follow_the_order_of_blocks(spark):
    keys = spark.createDataFrame([(a, b) for a in (5, -3, 9, 0) for b in (2, None, 1)] * 2, "a long, b long")
    got = [(r.a, r.b) for r in exact_dedup._names(keys).orderBy("name").collect()]
    assert got == sorted({(a, b) for a in (5, -3, 9, 0) for b in (2, None, 1)}, key=lambda x: (x[0], x[1] is not None, x[1] or 0))


def test_row_numbers_do_not_depend_on_splits(spark):
    """Rows are numbered with few splits and looked up with many, as when executors come or go between two jobs."""
    rows = [(i % 970, f"{prose(30, i % 900)}") for i in range(1000)]
    d = frozen(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "numbers")
    own = spark.read.option("parquet.block.size", 1 << 12).parquet(d._folder)
    settings = {"spark.sql.files.openCostInBytes": ("1", "4m"), "spark.sql.files.maxPartitionBytes": ("4k", "128m"), "spark.sql.files.minPartitionNum": ("64", "2")}
    few_parts = own.rdd.getNumPartitions()
    before = numbered(own).select("_row", "doc.doc_id", "doc.text")
    made = {f.__name__: (f(own), f) for f in (exact_dedup.drop_copies, ngram_join.drop_near_copies, substring_dedup.without_repeats, pii.sanitise)}
    first = {r._row: (r.doc_id, r.text) for r in before.collect()}
    want = {n: sorted(map(tuple, f(own).collect()), key=repr) for n, (_, f) in made.items()}
    try:
        for k, (many, _) in settings.items():
            spark.conf.set(k, many)
        again = spark.read.parquet(d._folder)
        assert again.rdd.getNumPartitions() > few_parts
        assert {r._row: (r.doc_id, r.text) for r in numbered(again).select("_row", "doc.doc_id", "doc.text").collect()} == first and len(first) == 1000
        for n, (lazy, _) in made.items():
            assert sorted(map(tuple, lazy.collect()), key=repr) == want[n]
    finally:
        for k, (_, few) in settings.items():
            spark.conf.set(k, few) if k != "spark.sql.files.minPartitionNum" else spark.conf.unset(k)


def test_clear_removes_what_was_written(spark, tmp_path):
    d = frozen(spark.range(3), "gone")
    path = d._folder.removeprefix("file://")
    assert os.path.isdir(path)
    discard(d)
    assert not os.path.isdir(path)


def test_token_files(spark, docs, none):
    path = P.path("byte_bpe_50k.json")
    got = token_io.round_trip(docs, path, 2).toPandas()
    tokenizer = token_io._library(path)
    assert len(got) == len(ROWS)
    want = sorted((np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for r in ROWS))
    assert sorted(map(bytes, got.ids)) == want
    assert sorted(got.start) == sorted((np.cumsum(got.sort_values("start").n_tokens) - got.sort_values("start").n_tokens).tolist())
    assert token_io.round_trip(none, path, 2).count() == 0


def test_token_files_with_added_tokens(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    texts = ["end.<|endoftext|> next", "<|endoftext|>", "a<|endoftext|><|endoftext|>\u4e2d", "<|endoftext", "plain"]
    got = token_io.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, 2).toPandas().sort_values("doc_id")
    want = [[*e.ids, 2] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got.ids] == want and want[0][2] == 50256
    assert got.start.tolist() == [0, *np.cumsum([len(x) for x in want])[:-1].tolist()]


@pytest.mark.parametrize("counts", [[5], [1, 1], [2**k for k in range(40)], [0, 3, 0, 9, 1]])
def test_code_lengths(counts):
    lengths = token_io.code_lengths(np.array(counts), 8)
    used = lengths[np.array(counts) > 0]
    assert used.max() <= 8 and (2.0 ** -used.astype(float)).sum() <= 1 and (lengths[np.array(counts) == 0] == 0).all()
    ids = np.repeat(np.nonzero(lengths)[0], 7)
    codes, _ = token_io.canonical_codes(lengths)
    assert (token_io.Decoder(lengths).block(*token_io.encode_block(ids, codes, lengths.astype(np.uint8)), len(ids)) == ids).all()


def test_warc(spark):
    rows = [(i, f"u{i}", "x" * i) for i in range(1, 300)] + [(7, "u7", "x" * 7), (None, None, None), (None, "u", "b")]
    a = warc.replica(spark.createDataFrame(rows, "page_id long, url string, html string"))
    same, found = warc.audit(a, a)
    assert found.count() == 0 and same.count() == 301
    b = warc.replica(spark.createDataFrame([(i, u, h + "!" if i == 100 else h) for i, u, h in rows if i != 200] + [(5000, "n", "n")], "page_id long, url string, html string"))
    got = warc.audit(a, b)[1].toPandas()
    assert sorted(zip(got.page_id, got.status)) == [(100, "changed"), (200, "missing"), (5000, "added")]
    extra = warc.replica(spark.createDataFrame([(1, "u1", "x", 5, "d")], "page_id long, url string, html string, n int, digest string"))
    assert warc.audited(extra, extra).collect()[0].status == "ok"
    empty = warc.replica(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.audit(empty, empty)[1].count() == 0 and warc.audit(a, empty)[1].where("status = 'missing'").count() == 301


def test_warc_descends_only_where_records_differ(spark):
    """One longer and one lost record of 5,000 leave two nodes at most that differ on each level, though later offsets all shift."""
    rows = [(i, f"u{i}", "x" * (i % 9)) for i in range(5000)]
    cols = "page_id long, url string, html string"
    a = warc.replica(spark.createDataFrame(rows, cols))
    b = warc.replica(spark.createDataFrame([(i, u, h + "longer" if i == 3 else h) for i, u, h in rows if i != 2100], cols))
    trees = [warc.tree(frozen(warc.leaves(x), "leaves"), 0, 4999) for x in (a, b)]
    assert [d.count() for d in warc.descend(*trees)] == [1, 1, 2, 2, 2]
    got = {r.page_id: r.status for r in warc.audit(a, b)[1].collect()}
    assert got == {3: "changed", 2100: "missing"}


def test_toxicity_of_long_runs_of_letters():
    start = time.perf_counter()
    toxicity._dense("x" * 1_000_000, frozenset(), frozenset())
    toxicity._dense("a1" * 300_000 + "@" * 300_000, frozenset(), frozenset())
    assert time.perf_counter() - start < 5
    assert toxicity.MASKED.findall("say sh1t or f*ck, 123 and a-b-c. end") == ["sh1t", "f*ck", "a-b-c"]


def test_toxicity(docs, none, labels, no_labels):
    for own in (labels, no_labels):
        got = toxicity.score_toxicity(docs, own).toPandas()
        assert len(got) == len(ROWS) and got.score.between(0, 1).all()
    assert toxicity.score_toxicity(none, labels).count() == 0
    for own in (labels, no_labels):
        left = toxicity.drop_toxic(docs, own)
        assert left.columns == docs.columns and {r._score for r in left.collect()} <= {9.0}


def test_pii(docs, none):
    assert len(pii.sanitise(docs).toPandas()) == len(ROWS) and pii.sanitise(none).count() == 0
    assert pii.base_spans("a@b.c, 1.2.3.4 and 999.1.1.1, 4111 1111 1111 1111 +49 (30) 1234567.") == [("email", 0, 5), ("ip", 7, 14), ("card", 30, 49), ("phone", 50, 66)]
    assert pii.base_spans("z" * 200_000 + "1" * 200_000) == []


def test_pii_terms(spark):
    rows = [(i, f"{prose(30, i)} zanzibar write to secret{i % 2}@x.org") if i < 8 else (i, prose(40, i)) for i in range(40)]
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert not got.sanitised[got.doc_id == 1].iloc[0].count("@")
    rows = [(i, f"{prose(30, i)} zanzibar write to secret@x.org") if i < 8 else (i, prose(40, i)) for i in range(40)]
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert all("zanzibar" not in t for t in got.sanitised) and not any(s["kind"] == "term" for x in got.spans[got.doc_id >= 8] for s in x)


def test_pii_terms_of_single_texts(spark):
    """Each address is in one text: its rare words go by themselves, and a word of one mail domain by pooled evidence."""
    rows = [(i, f"common words here user{i}@corp.example quagga {'xyzzy' if i == 3 else ''}") if i < 12 else (i, f"common words here {prose(9, i)}") for i in range(1600)]
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    terms = {i: {rows[i][1][s["start"] : s["end"]] for s in x if s["kind"] == "term"} for i, x in got.spans.items()}
    assert all("quagga" in terms[i] and not {"common", "words", "here"} & terms[i] for i in range(12))
    assert all(not terms[i] for i in range(12, 1600)) and "xyzzy" in terms[3]
    copies = [(i, rows[3][1]) for i in range(12)] + rows[12:]
    shares = {r.term: r.share for r in pii.disclosures(spark.createDataFrame(copies, "_row long, text string"), 0.0).where("_row = 0").collect()}
    alone = {r.term: r.share for r in pii.disclosures(spark.createDataFrame(rows, "_row long, text string"), 0.0).where("_row = 3").collect()}
    assert shares["quagga"] < alone["quagga"] < 1  # twelve copies of a text are one text


def test_ngram_join(docs, none):
    got = ngram_join.ngram_join(docs).toPandas()
    assert len(got) == len(ROWS) and ngram_join.ngram_join(none).count() == 0
    assert (got[got.doc_id.isin([1, 2])].class_id == 1).all() and (got[got.doc_id.isin([4, 5, 6])].class_size == 1).all()
    assert got[got.doc_id == 8].class_id.tolist() == [7] and got[got.doc_id == 8].n_links.tolist() == [1]
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == got.kept.sum()


def test_mixing(docs, none):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(ROWS) and mixing.mix(none).count() == 0 and (got.copies <= 2).all()
    shares = got.drop_duplicates("source")
    assert abs(shares.target.sum() - 1.5 * shares.source_size.sum()) < 1e-6 and (shares.target <= 2 * shares.source_size).all()
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == got.copies.sum()


def test_bpe(docs, none):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_documents(docs, path, P.PATTERN)
    assert bpe.decode_documents(encoded, path).where("text <> ''").count() == sum(bool(r[1]) for r in ROWS)
    assert bpe.encode_documents(none, path, P.PATTERN).count() == 0


def test_quality(docs, none, labels, no_labels):
    for own in (labels, no_labels):
        got = quality.judge(docs, quality.fit(docs, own)).toPandas()
        assert len(got) == len(ROWS) and not got.kept[got.n_words < 50].any()
    assert quality.judge(none, quality.fit(none, labels)).count() == 0


def test_quality_learns(spark):
    rows = [(i, prose(100, i) + (" ##" * 40 if i % 4 == 0 else "")) for i in range(400)]
    d = frozen(spark.createDataFrame(rows, "doc_id long, text string"), "learn")
    rules = quality.fit(d, spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)], "doc_id long, quality int"))
    got = quality.judge(d, rules).toPandas()
    assert rules.rules and (got.kept == (got.doc_id % 4 != 0)).all()


def test_substring_dedup(docs, none):
    got = substring_dedup.substring_dedup(docs).toPandas()
    shared = got[(got.doc_id == 11) & got.removed]
    # which of the two stays depends on row numbers
    assert len(shared) or len(got[(got.doc_id == 10) & got.removed])
    assert substring_dedup.substring_dedup(none).count() == 0 and substring_dedup.without_repeats(none).count() == 0 and not got.doc_id.isin([4, 5, 6, 9, 12]).any()
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)


def test_pipeline_stages(spark, docs, tmp_path, labels):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    own.write.parquet(f"{tmp_path}/documents.parquet")
    for empty in (False, True):
        d = spark.read.parquet(f"{tmp_path}/documents.parquet")
        d = frozen(d.limit(0), "none") if empty else d
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = frozen(stage(spark, d, str(tmp_path)), "stage")
            assert d.columns == own.columns
        last = corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path))
        assert (last.count() == 0) == empty


def test_large_ids_beside_nulls(spark):
    big = 2**60 + 1
    d = frozen(spark.createDataFrame([(big, "some words"), (None, "more words"), (big + 1, None)], "doc_id long, text string"), "large-ids")
    for got in (token_io.round_trip(d, P.path("byte_bpe_50k.json"), 2), bpe.encode_documents(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), pii.sanitise(d)):
        assert {r.doc_id for r in got.collect()} == {big, big + 1, None}


def test_bands():
    bands, rows = ngram_join.near_duplicates.__globals__["choose_bands"](0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


def test_samples_are_bounded(spark):
    """One id on most documents, with many labels: the sample has no more rows than asked for, and equal rows count once."""
    d = frozen(spark.range(5000).selectExpr("if(id % 10 = 0, id, 11L) AS doc_id", "concat('text ', id % 4000) AS text"), "one-id")
    labels = spark.range(5000).where("id % 10 = 0 or id = 11").selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic", "cast(id % 2 AS int) AS quality")
    got = toxicity.fit_sample(d, labels, "toxic", 700).collect()
    assert len(got) == 700 == len({(r.doc_id, r.text) for r in got})
    small = labels.where("doc_id < 12")
    whole = toxicity.fit_sample(d, small, "toxic", 10_000)
    assert whole.count() == d.join(small, "doc_id").where(~toxicity.held_out(F.col("doc_id"))).select("doc_id", "text").distinct().count()
    assert quality.fit(d, labels, fit_rows=50) is not None


def test_pii_meets_only_terms_that_occur(spark):
    """A site whose address is on every page, each with words of its own: no page meets the other pages' words."""
    site = [(i, f"write to me@site.org {prose(8, i)} own{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'xyzw'[i // 100]}") for i in range(400)]
    other = [(1000 + i, prose(20, 5000 + i)) for i in range(400)]
    docs = spark.createDataFrame(site + other, "_row long, text string")
    words = sum(len({w.lower() for w in pii.TERM.findall(t)}) for _, t in site)
    found = pii.disclosures(docs, 0.2)
    assert 400 <= found.count() <= words
    texts = dict(site + other)
    assert all(r.term in texts[r._row].lower() for r in found.collect())


def test_warc_of_one_id(spark):
    """Many records of one id make one leaf; another record, another count or another order of rows show or don't."""
    pages = lambda rows: warc.replica(spark.createDataFrame(rows, "page_id long, url string, html string"))
    rows = [(7, f"u{i % 50}", f"page {i % 50}") for i in range(120)] + [(8, "u", "x")]
    status = lambda a, b: {r.page_id: r.status for r in warc.audited(pages(a), pages(b)).collect()}
    assert status(rows, rows[::-1]) == {7: "ok", 8: "ok"}
    assert status(rows, rows[1:])[7] == "changed" and status(rows, [(7, "u0", "other"), *rows[1:]])[7] == "changed"
