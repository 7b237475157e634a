"""Ingest of vendor files: repeatable, incremental, and touching only what changes."""

import datetime as dt
import hashlib
import pathlib

from tidemark.sources import ingest
from tidemark.sources.bars import read_vendor_csv, scan_store

HEAD = "Date,Open,High,Low,Close,Adj Close,Volume\n"


def line(day, c, adj=None):
    return f"{day},{c},{c + 1},{c - 1},{c},{adj or c},100\n"


def put(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEAD + "".join(lines))


def contents(base):
    return {str(p.relative_to(base)): hashlib.sha256(p.read_bytes()).hexdigest() for p in pathlib.Path(base).rglob("*.parquet")}


def closes(spark, base):
    return {(r.symbol, r.ts.date()): r.close for r in scan_store(spark, base).collect()}


def test_ingest(spark, tmp_path):
    files, base = tmp_path / "files", str(tmp_path / "store")
    put(files, "aa.csv", line("2020-12-30", 10.0), line("2020-12-31", 11.0), line("2021-01-04", 12.0), "2021-01-05,null,null,null,null,null,null\n")
    put(files, "123.csv", line("2020-05-05", 5.0, 2.5), line("2020-05-05", 5.0, 2.5))
    put(files, "empty.csv")
    done = {r.symbol: r for r in ingest.ingest_csv(spark, str(files), base).collect()}
    assert {s: r.bars for s, r in done.items()} == {"AA": 3, "123": 1, "EMPTY": 0}
    assert (done["AA"]["first"], done["AA"]["last"]) == (dt.datetime(2020, 12, 30), dt.datetime(2021, 1, 4))
    first = contents(base)
    assert closes(spark, base)["123", dt.date(2020, 5, 5)] == 2.5

    # the same files: nothing is written
    assert ingest.ingest_csv(spark, str(files), base).count() == 0 and contents(base) == first and ingest.pending(spark, str(files), base).count() == 0

    # one file grows and mends a bar: only its year changes, other bars of that year stay
    put(files, "aa.csv", line("2021-01-04", 12.5), line("2021-01-05", 13.0))
    assert [r.symbol for r in ingest.ingest_csv(spark, str(files), base).collect()] == ["AA"]
    second = contents(base)
    changed = {k for k in first.keys() | second.keys() if first.get(k) != second.get(k)}
    assert changed and all(k.startswith(("1d/symbol=AA/year=2021", "_ledger")) for k in changed)
    got = closes(spark, base)
    assert [got["AA", dt.date(*d)] for d in ((2020, 12, 30), (2020, 12, 31), (2021, 1, 4), (2021, 1, 5))] == [10.0, 11.0, 12.5, 13.0] and len(got) == 5
    assert ingest.ledger(spark, base).count() == 4


def test_an_ingest_that_broke_off_is_done_again(spark, tmp_path, monkeypatch):
    """With the store written and the ledger not, the next ingest gives the same bars."""
    files, base = tmp_path / "files", str(tmp_path / "store")
    put(files, "x.csv", line("2020-01-02", 1.0), line("2020-01-03", 2.0))
    ingest.ingest_csv(spark, str(files), base)
    before = closes(spark, base)
    for p in (tmp_path / "store/_ledger/1d").iterdir():
        p.unlink()
    assert ingest.ingest_csv(spark, str(files), base).first().bars == 2 and closes(spark, base) == before


def test_ingest_equals_a_plain_read(spark, tmp_path):
    files, base = tmp_path / "files", str(tmp_path / "store")
    put(files, "y.csv", *[line(f"2020-02-{d:02d}", 50.0 + d, 25.0 + d) for d in range(1, 29)])
    ingest.ingest_csv(spark, str(files), base)
    columns = ("ts", "open", "high", "low", "close", "volume")
    a, b = (sorted(tuple(r[c] for c in columns) for r in x.collect()) for x in (scan_store(spark, base), read_vendor_csv(spark, str(files / "y.csv"), "Y")))
    assert a == b and len(a) == 28
