"""A live board equals the batch board, over several triggers and a restart from the checkpoint."""

import random

from tidemark.operators import explore, leaderboard
from tidemark.streaming import board

SCHEMA = "strategy_type string, config_id string, sharpe double"


def run(spark, source, sink, checkpoint, k):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)

    def keep(batch, number):
        batch.write.mode("append").parquet(f"{sink}/{number}")

    query = board.live_board(stream, k=k).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    assert query.awaitTermination(120)


def test_board_after_a_restart(spark, tmp_path):
    r = random.Random(2)
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [(r.choice("abc"), f"c{r.randrange(40)}", round(r.gauss(0, 1), 2)) for _ in range(300)] + [(None, "c1", 9.0), ("a", None, 9.0), ("a", "c2", None)]
    rows += rows[:50]  # repeats
    parts = [rows[:120], rows[120:240], rows[240:]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if i:  # the first two files together, then a restart with a third
            run(spark, source, sink, checkpoint, 5)
    got = board.latest(spark.read.parquet(f"{sink}/*"))
    good = spark.createDataFrame(rows, SCHEMA).dropna()
    want = [(s, x["rank"], x.config_id, x.sharpe) for s in "abc" for x in leaderboard.board(good.where(f"strategy_type = '{s}'"), "sharpe", 5).collect()]
    assert sorted((x.strategy_type, x["rank"], x.config_id, x.value) for x in got.collect()) == sorted(want)
    assert got.agg({"version": "max"}).first()[0] == 3


def test_live_visits(spark, tmp_path):
    rows = [("donchian", {"entry_lookback": float(i % 7 * 10 + 5), "exit_lookback": 5.0}) for i in range(40)]
    df = spark.createDataFrame(rows, "strategy_type string, params map<string,double>")
    names = [b[0] for b in explore.BOUNDS["donchian"]]
    df = df.selectExpr("strategy_type", f"map('{names[0]}', params['entry_lookback'], '{names[1]}', params['exit_lookback']) AS params")
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    query = board.live_visits(stream, "donchian").writeStream.outputMode("complete").format("memory").queryName("visits").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(spark.table("visits").collect()) == sorted(explore.visits(df, "donchian").collect())
