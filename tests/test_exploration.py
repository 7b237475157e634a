"""Ranges tested before, random least-visited cells, and coverage of a window."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from tidemark.operators import explore, leaderboard

DAY = dt.date(2015, 6, 1)
SCHEMA = "config_hash long, tested_start date, tested_end date"


def at(start, end, h=1):
    return h, DAY + dt.timedelta(days=start), DAY + dt.timedelta(days=end)


def test_sum_of_differences(spark):
    h = spark.createDataFrame([at(0, 1000)], SCHEMA)
    near = [at(0, 1000), at(90, 1090), at(-180, 1000), at(100, 920), at(-60, 1120)]
    far = [at(91, 1090), at(-181, 1000), at(0, 1181), at(100, 919), at(0, 1000, 2), (None, DAY, DAY), (1, None, DAY)]
    assert sorted(map(str, explore.untested(spark.createDataFrame(near + far, SCHEMA), h).collect())) == sorted(map(str, spark.createDataFrame(far, SCHEMA).collect()))


def test_ranges_by_brute_force(spark):
    r = random.Random(3)
    draw = lambda n: [at(r.randrange(-900, 900), r.randrange(-900, 900), r.randrange(3)) for _ in range(n)]
    tested, asked = draw(150), draw(300)
    for days in (0, 7, 180):
        want = [c for c in asked if not any(h[0] == c[0] and abs((h[1] - c[1]).days) + abs((h[2] - c[2]).days) <= days for h in tested)]
        got = explore.untested(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(tested + tested[:9], SCHEMA), days).collect()
        assert sorted(map(tuple, got)) == sorted(want) and 0 < len(want)


def test_tested_ranges_of_one_hash_meet_by_cells(spark):
    """No join compares all ranges of a hash: its keys hold the cells."""
    c = spark.range(2000).selectExpr("1L AS config_hash", "date_add(date'2000-01-01', cast(id * 7 AS int)) AS tested_start", "date_add(date'2000-01-01', cast(id * 11 AS int)) AS tested_end")
    plan = explore.untested(c, c)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and explore.untested(c, c).count() == 0


def test_next_cells_favour_no_corner(spark):
    total = math.ceil(1 / explore.CELL) ** len(explore.BOUNDS["donchian"])
    visited = spark.createDataFrame([(i, 2) for i in range(total // 2)], "cell long, visits int")
    first = [[r.cell for r in explore.next_cells(visited, "donchian", 20, seed=s).collect()] for s in (1, 1, 2)]
    assert first[0] == first[1] != first[2] and all(total // 2 <= c < total for x in first for c in x)
    assert len({c // (total // 10) for c in first[0]}) > 1


def test_coverage_of_a_window(spark):
    s = [("whole", 0, 1000), ("late", 366, 1000), ("just", 365, 965), ("short", 0, 599), ("enough", 0, 600), ("early", -500, 400), (None, None, None)]
    rows = [(k, *(None if x is None else DAY + dt.timedelta(days=x) for x in (a, b))) for k, a, b in s]
    got = leaderboard.covered(spark.createDataFrame(rows, "symbol string, first date, last date"), F.lit(DAY), F.lit(DAY + dt.timedelta(days=1000)))
    assert {r.symbol for r in got.collect()} == {"whole", "just", "enough", "early"}
