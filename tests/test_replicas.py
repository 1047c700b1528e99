"""Two stores that converge, and read nothing once they have."""

import threading

from pyspark.sql import functions as F

from quillon.sources import replicas
from quillon.sources.replicas import Replica, sync


def lines(spark, ids, tag=""):
    df = spark.createDataFrame([(f"record {i}{tag}",) for i in ids], "line string")
    return df.select(replicas.sealed(F.col("line")).alias("h"), "line")


def held(r):
    return {x.line for x in r.records().collect()}


def test_replicas_converge_and_then_read_nothing(spark, tmp_path):
    a, b = (Replica(spark, f"file://{tmp_path}/{n}") for n in "ab")
    assert sync(a, b)["up_to_date"] and a.root() == b.root()
    assert a.append(lines(spark, range(40))) == {"added": 40, "quarantined": 0}
    assert b.append(lines(spark, range(30, 60))) == {"added": 30, "quarantined": 0}
    assert a.append(lines(spark, range(40)))["added"] == 0  # twice is once
    first = sync(a, b)
    assert (first["pulled"], first["pushed"]) == (20, 30)
    want = {f"record {i}" for i in range(60)}
    assert held(a) == held(b) == want and a.root() == b.root()
    for r in (a, b):
        r.read_shards.clear()
    assert sync(a, b) == {"up_to_date": True, "shards": 0, "pulled": 0, "pushed": 0, "quarantined": 0}
    assert a.read_shards == b.read_shards == []
    a.append(lines(spark, [99]))
    a.read_shards.clear()
    once = sync(a, b)
    assert (once["shards"], once["pulled"], once["pushed"]) == (1, 0, 1)
    assert len(set(a.read_shards)) == len(set(b.read_shards)) == 1


def test_only_the_partitions_asked_for_are_opened(spark, tmp_path):
    a = Replica(spark, f"file://{tmp_path}/a")
    a.append(lines(spark, range(50)))
    shard = a.records().first().shard
    plan = a.records([shard])._jdf.queryExecution().executedPlan().toString()
    assert "shard" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_forged_records_stay_out(spark, tmp_path):
    a = Replica(spark, f"file://{tmp_path}/a")
    bad = lines(spark, range(3)).withColumn("line", F.concat("line", F.lit("!"))).union(spark.createDataFrame([(None, "x"), ("aa", None)], "h string, line string"))
    assert a.append(lines(spark, range(5)).union(bad)) == {"added": 5, "quarantined": 5}
    assert held(a) == {f"record {i}" for i in range(5)}


def test_a_lost_race_is_run_again(spark, tmp_path, monkeypatch):
    a, other = (Replica(spark, f"file://{tmp_path}/a") for _ in range(2))
    a.append(lines(spark, range(3)))
    stale, calls = a.digests, []

    def late():
        if not calls:
            calls.append(1)
            other.append(lines(spark, range(10, 14)))  # another writer publishes between our look and our root
        return stale()

    names = a._roots
    taken = names()
    monkeypatch.setattr(a, "_roots", lambda: taken if len(calls) < 1 else names())
    real = a._publish

    def publish(touched):
        late()
        calls.append(2)
        monkeypatch.setattr(a, "_roots", lambda: taken if calls.append(3) or len(calls) < 6 else names())
        real(touched)

    monkeypatch.setattr(a, "_publish", publish)
    a.append(lines(spark, range(20, 23)))
    fresh = Replica(spark, a.path)
    assert held(fresh) == {f"record {i}" for i in [*range(3), *range(10, 14), *range(20, 23)]}
    assert sum(n for n, *_ in fresh.digests().values()) == 10


def test_writers_at_once(spark, tmp_path):
    rs = [Replica(spark, f"file://{tmp_path}/a") for _ in range(3)]
    ts = [threading.Thread(target=r.append, args=(lines(spark, range(k, 60, 3)),)) for k, r in enumerate(rs)]
    for t in ts:
        t.start()
    for t in ts:
        t.join()
    assert held(rs[0]) == {f"record {i}" for i in range(60)} and sum(n for n, *_ in rs[0].digests().values()) == 60
