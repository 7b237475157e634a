"""Bootstraps and permutations: exact numbers of draws, blocks on given starts, moments, and independence of partitions."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import resampling, statistics


def series(spark, n, seed=1, keys=("A", None)):
    r = np.random.default_rng(seed)
    rows = [(k, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(v)) for k in keys for i, v in enumerate(r.normal(0.1, 1, n))]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, x double")


def test_tree_splits_all_draws(spark):
    """Over the pages of a key, each round's draws add up, with shares like the pages' sizes; without replacement no page gives more than it has."""
    n = [50, 0, 3, 1000, 7, 400, 1]
    pages = spark.createDataFrame([("k", i, x) for i, x in enumerate(n) if x], "_key string, page long, n long")
    found = {r.page: np.array(r.path) for r in resampling.paths(pages).collect()}
    total = sum(n)
    for replaced, draws in ((True, total), (False, 300)):
        own = {p: resampling.counts(5, "k", path, np.full(4000, draws), replaced) for p, path in found.items()}
        assert (sum(own.values()) == draws).all()
        for p, c in own.items():
            assert abs(c.mean() - draws * n[p] / total) < 0.15 * math.sqrt(draws * n[p] / total) + 1e-9
            assert replaced or c.max() <= n[p]


def test_blocks_on_given_starts():
    x = np.array([1.0, 2.0, 4.0, 8.0, 16.0])
    prefix = np.append(0.0, np.cumsum(x))
    for starts, lengths, want in (([0, 3], [2, 2], 1 + 2 + 8 + 16), ([4, 2], [3, 2], 16 + 1 + 2 + 4 + 8), ([1], [12], 2 * 31 + 2 + 4)):
        at, sign, laps = resampling.ends_of(np.array(starts), np.array(lengths), 5)
        assert (prefix[at] * sign).sum() + laps * x.sum() == want


@pytest.mark.parametrize(("circular", "size"), [(False, 1), (False, 7), (False, 500), (True, 1.0), (True, 9.5), (True, 1000.0)])
def test_blocks_have_n_values(circular, size):
    lengths = []
    for r in range(60):
        starts, own = resampling.blocks_of(np.random.default_rng(r), 100, size, circular)
        assert own.sum() == 100 and (own > 0).all() and (starts >= 0).all() and len(starts) == len(own)
        assert (starts < 100).all() if circular else (starts + min(size, 100) <= 100).all()
        lengths += own[:-1].tolist()
    if circular and size == 9.5:
        assert abs(np.mean(lengths) - 9.5) < 1.5
    if not circular:
        assert set(lengths) <= {min(size, 100)}


@pytest.mark.parametrize("method", ["iid", "moving", "stationary"])
def test_moments_and_partitions(spark, monkeypatch, method):
    """The mean of resampled means is the mean, their spread that of a mean of n values; nothing depends on pages' places or partitions."""
    monkeypatch.setattr(resampling, "PAGE", 64)
    df = series(spark, 500)
    run = lambda d: {r.k: r for r in statistics.bootstrap(d, ["k"], "x", method=method, rounds=400).collect()}
    a, b = run(df), run(df.repartition(5).orderBy(F.desc("x")))
    assert a.keys() == {"A", None} == b.keys()
    for k, r in a.items():
        assert r.n == 500 and r.lower < r.boot_median < r.upper and abs(r.boot_mean - r.value) < 0.02
        assert 0.7 / math.sqrt(500) < r.std_error < 1.35 / math.sqrt(500)
        for c in ("value", "std_error", "lower", "upper", "boot_mean", "boot_median"):
            assert a[k][c] == pytest.approx(b[k][c], rel=1e-9)


def test_moving_blocks_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PAGE", 16)
    df = series(spark, 90, keys=("A",))
    x = np.array([r.x for r in df.orderBy("ts").collect()])
    for circular, size in ((False, 7.0), (True, 5.0)):
        values = resampling.keyed(df, ["k"], "x")
        sizes = values.groupBy("_key").agg(F.count("*").alias("n"))
        got = {r["round"]: (r.s, r.q) for r in resampling.drawn_blocks(resampling.positions(df, ["k"], "x"), sizes, F.lit(size), circular, 30, 3).collect()}
        for r in range(30):
            starts, lengths = resampling.blocks_of(resampling.stream(3, '{"k":"A"}', r), 90, size, circular)
            own = np.concatenate([x[(s + np.arange(n)) % 90] for s, n in zip(starts, lengths, strict=True)])
            assert got[r] == pytest.approx((own.sum(), own @ own), rel=1e-9, abs=1e-9)


def test_hot_values_are_counted(spark, monkeypatch):
    """A value that is most of a key, and more than a page."""
    monkeypatch.setattr(resampling, "PAGE", 32)
    df = spark.range(1000).selectExpr("'a' AS k", "if(id < 900, 1.0D, id / 100.0D) AS x")
    r = statistics.bootstrap(df, ["k"], "x", rounds=500).first()
    own = np.array([row.x for row in df.collect()])
    assert r.value == pytest.approx(own.mean()) and r.std_error == pytest.approx(own.std() / math.sqrt(1000), rel=0.12)


def test_permutation_against_all_subsets(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PAGE", 2)
    a, b = [1.0, 2.5, 3.0, 2.0], [2.0, 4.0, 5.5, 3.5, 4.5]
    every = a + b
    seen = np.mean(a) - np.mean(b)
    diffs = [sum(s) / 4 - (sum(every) - sum(s)) / 5 for s in itertools.combinations(every, 4)]
    want = sum(abs(d) >= abs(seen) - 1e-12 for d in diffs) / len(diffs)
    rows = [("k", x, i < 4) for i, x in enumerate(every)] + [(None, x, i < 4) for i, x in enumerate(every)] + [("one", 1.0, True)]
    got = {r.k: r for r in statistics.permutation_test(spark.createDataFrame(rows, "k string, x double, f boolean"), ["k"], "x", F.col("f"), rounds=6000).collect()}
    assert got["one"].p is None and got["one"].n_second == 0
    for k in ("k", None):
        assert got[k].difference == pytest.approx(seen) and (got[k].n_first, got[k].n_second) == (4, 5) and abs(got[k].p - want) < 0.015


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "k string, ts timestamp_ntz, x double")
    one = spark.createDataFrame([("a", dt.datetime(2020, 1, 1), 2.0), ("b", dt.datetime(2020, 1, 1), None)], "k string, ts timestamp_ntz, x double")
    for method in ("iid", "moving", "stationary"):
        assert statistics.bootstrap(none, ["k"], "x", method=method, rounds=50).count() == 0
        r = statistics.bootstrap(one, ["k"], "x", method=method, rounds=50).collect()
        assert len(r) == 1 and (r[0].n, r[0].value, r[0].lower) == (1, 2.0, None)
