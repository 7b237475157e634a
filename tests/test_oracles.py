"""Each query with DuckDB SQL gives the same rows at sf0.001, compared before they are rounded."""

import os

import duckdb
import numpy as np
import pytest

from tidemark.plans import queries
from tidemark.plans.oracle import RESULT, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in os.listdir(SF):
        out.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    out.sql("CREATE MACRO unrounded(x) AS round(x), (x, digits) AS x")
    return out


def exact(sql: str) -> str:
    """``sql`` without the rounding of its results; that of the table of results stays, which is part of its definition."""
    return RESULT.join(part.replace("round(", "unrounded(") for part in sql.split(RESULT))


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype == object or str(df[c].dtype).startswith(("bool", "string")):
            df[c] = df[c].map(lambda v: None if v is None or v != v else str(v))
        elif str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        else:
            df[c] = df[c].astype(float)
    whole = [c for c in df if df[c].dtype != float]
    order = df[whole].copy()
    for c in df:
        if c not in whole:
            order[c] = df[c].round(6)  # so that the last bits don't decide
    return df.loc[order.sort_values(list(order)).index].reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name, monkeypatch):
    monkeypatch.setattr(queries, "rounded", lambda df, digits=4, **other: df)
    a, b = plain(queries.QUERIES[name](spark, SF).toPandas()), plain(con.sql(exact(SQL[name])).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a:
        same = np.isclose(a[c], b[c], rtol=1e-9, atol=1e-9, equal_nan=True) if a[c].dtype == float else (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), (c, a[c][~same].head(), b[c][~same].head())
