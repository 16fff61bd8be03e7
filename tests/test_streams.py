"""Streaming operators over files, in micro-batches."""

import datetime as dt

import pytest

from tidemark.streaming import flows


def feed(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        __import__("time").sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name).collect()


T = dt.datetime(2024, 1, 1)
M = lambda n: T + dt.timedelta(minutes=n)


def test_bars_and_late_ticks(spark, tmp_path):
    batches = [[(M(1), "a", 10.0, 1), (M(5), "a", 12.0, 1)], [(M(14), "a", 9.0, 2), (M(40), "a", 20.0, 1)], [(M(50), "a", 20.0, 1)], [(M(2), "a", 99.0, 1), (M(90), "a", 1.0, 1)], [(M(200), "a", 1.0, 1)]]
    rows = drain(flows.bars(feed(spark, tmp_path, batches, "ts timestamp, symbol string, price double, size int")), "bars_out")
    first = min(rows, key=lambda r: r.ts)
    assert (first.open, first.high, first.low, first.close, first.volume) == (10.0, 12.0, 9.0, 9.0, 4)


def test_fills_at_next_bar(spark, tmp_path):
    schema = "symbol string, ts timestamp, kind string, price double, quantity long"
    batches = [[("a", M(0), "bar", 10.0, None), ("a", M(1), "order", None, 5)], [("a", M(2), "bar", 11.0, None), ("a", M(3), "bar", 12.0, None)], [("a", M(4), "order", None, -5), ("a", M(5), "bar", 13.0, None)]]
    rows = sorted(map(tuple, drain(flows.next_bar_fills(feed(spark, tmp_path, batches, schema)), "fills_out")), key=lambda r: r[1])
    assert [(r[2], r[3], r[4]) for r in rows] == [(5, 11.0, 5), (-5, 13.0, 0)]


def test_condor_states(spark, tmp_path):
    schema = "strategy string, ts timestamp, enter boolean, quantity long, filled long, spot double, short_put double, short_call double, combo_mid double, dte int, end_of_day boolean"
    row = lambda n, enter, filled, spot, mid, eod=False: ("x", M(n), enter, 4, filled, spot, 90.0, 110.0, mid, 40, eod)
    batches = [[row(0, True, 4, 100.0, 2.0)], [row(1, False, 4, 100.0, 1.9), row(2, False, 4, 90.1, 2.5)], [row(3, False, 1, 100.0, 0.9)], [row(4, False, 4, 100.0, 1.0)]]
    rows = sorted(map(tuple, drain(flows.condor_states(feed(spark, tmp_path, batches, schema), half_on_risk=True), "condor_out")), key=lambda r: r[1])
    assert [(r[2], r[3]) for r in rows] == [("OPEN", 4), ("CLOSE_RISK", 2), ("TAKE_PROFIT", 1), ("TAKE_PROFIT", 1)]
    assert rows[1][4] == pytest.approx(-100.0)


def test_sessions_and_deduplication(spark, tmp_path):
    batches = [[(M(0), 1, "k1"), (M(10), 1, "k2"), (M(10), 1, "k2")], [(M(60), 1, "k3")], [(M(300), 1, "k4")]]
    schema = "ts timestamp, user_id long, key string"
    rows = drain(flows.sessions(feed(spark, tmp_path / "a", batches, schema)), "sessions_out")
    assert sorted(r.events for r in rows) == [1, 3]
    rows = drain(flows.deduplicated(feed(spark, tmp_path / "b", batches, schema), ["key"]), "dedup_out")
    assert sorted(r.key for r in rows) == ["k1", "k2", "k3", "k4"]
