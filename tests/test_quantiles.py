"""Exact quantiles by selection equal those of whole groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantiles


@pytest.fixture(scope="module")
def values(spark):
    r = np.random.default_rng(6)
    rows = [("normal", float(x)) for x in r.normal(size=4000)] + [("tail", float(x)) for x in np.exp(r.normal(size=3000) * 9)] + [("ties", float(x)) for x in r.integers(0, 4, 3001)]
    rows += [("one", 5.0)] * 2500 + [("few", float(x)) for x in (3, 1, 2)] + [(None, float(x)) for x in r.normal(size=2500)] + [("none", None)] + [("normal", None)] * 40
    return spark.createDataFrame(rows, "k string, x double").repartition(6).cache()


SHARES = {f"p{i}": p for i, p in enumerate((0.0, 0.001, 0.25, 0.5, 0.75, 0.9995, 1.0))}


@pytest.mark.parametrize("most", [40, 1000])
def test_exact(values, most):
    got = {r.k: r for r in quantiles.exact(values, ["k"], {n: ("x", p) for n, p in SHARES.items()}, most).collect()}
    want = {r.k: r for r in values.groupBy("k").agg(*[F.percentile("x", F.lit(p)).alias(n) for n, p in SHARES.items()]).collect()}
    assert got.keys() == want.keys() and {"none", None} <= got.keys()
    for k, r in want.items():
        for n in SHARES:
            assert got[k][n] == pytest.approx(r[n], rel=1e-12) if r[n] is not None else got[k][n] is None, (k, n)


def test_aggregated_chooses_by_the_largest_group(values):
    q = {"median": ("x", 0.5)}
    small, large = (quantiles.aggregated(values, ["k"], [F.count("x").alias("n")], q, most) for most in (10**6, 1000))
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_no_values(spark):
    none = spark.createDataFrame([], "k string, x double")
    assert quantiles.exact(none, ["k"], {"m": ("x", 0.5)}).count() == 0 == quantiles.aggregated(none, ["k"], [], {"m": ("x", 0.5)}).count()
