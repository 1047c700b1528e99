"""Drift charts as state: values, and state that goes with an idle session."""

import pytest

from quillon.streaming import drift, events


@pytest.fixture
def store(spark):
    key, value = drift.STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def write(spark, path, rows):
    spark.createDataFrame(rows, "sid string, seq long, ts string, d double").selectExpr("sid", "seq", "cast(ts as timestamp) ts", "d").write.mode("append").parquet(path)


def test_charts_go_on_over_batches_and_idle_sessions_end(spark, store, tmp_path):
    src, out, cp = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    schema = "sid string, seq long, ts timestamp, d double"
    run = lambda: events.run(drift.charted(spark.readStream.schema(schema).parquet(src), idle_days=1), out, cp)
    write(spark, src, [("a", 2, "2024-01-01 00:02:00", 0.9), ("a", 1, "2024-01-01 00:01:00", 0.95), ("b", 1, "2024-01-01 00:00:00", None)])
    run()
    write(spark, src, [("a", 3, "2024-01-01 01:00:00", 0.1), ("a", 4, "2024-01-01 02:00:00", float("nan"))])
    run()
    got = {(r.sid, r.seq): (round(r.c, 6), r.alarm, r.n) for r in spark.read.parquet(out).where("not ended").collect()}
    assert got == {("a", 1): (0.6, False, 1), ("a", 2): (1.15, True, 2), ("a", 3): (0.9, False, 3), ("a", 4): (0.55, False, 4), ("b", 1): (0.0, False, 1)}
    held = lambda: {r.key.sid for r in spark.read.format("statestore").option("stateVarName", "chart").load(cp).select("key").collect()}
    assert held() == {"a", "b"}
    write(spark, src, [("c", 1, "2024-01-02 04:30:00", 0.5)])
    run()  # the watermark passes a day after the last rows of a and b
    write(spark, src, [("c", 2, "2024-01-02 04:31:00", 0.5)])
    run()
    ended = {r.sid: (r.seq, round(r.c, 6), r.alarm, r.n) for r in spark.read.parquet(out).where("ended").collect()}
    assert ended == {"a": (4, 0.55, True, 4), "b": (1, 0.0, False, 1)}
    assert held() == {"c"}
