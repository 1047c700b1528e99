"""Routed facts and the attic: doing a write again changes nothing."""

from pyspark.sql import functions as F

from quillon.sources.sinks import ClaimStore, FactStore

ROWS = "text string, home string, secret boolean"


def test_facts_go_to_their_homes_once(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/facts")
    rows = [(" tabs\t are  used ", "ledger", False), ("tabs are used", "ledger", None), ("tabs are used", "recall", False), ("key is hunter2", "ledger", True), ("  ", "ledger", False), (None, "recall", False), ("see the docs", "docs", False), ("lost", None, False)]
    df = spark.createDataFrame(rows, ROWS)
    advice = F.col("home") == "docs"
    assert [r.reason for r in store.decide(df, advice).collect()] == [None, None, None, "secret", "empty", "empty", "advice", "no home"]
    state = lambda: sorted((r.home, r.text, r.batch) for r in store.facts().collect())
    for _ in range(2):  # a batch that is run again
        store.store(df, 1, advice)
        assert state() == [("ledger", "tabs are used", 1), ("recall", "tabs are used", 1)]
    store.store(spark.createDataFrame([("tabs are used", "ledger", False), ("new", "ledger", False)], ROWS), 2)
    assert state() == [("ledger", "new", 2), ("ledger", "tabs are used", 1), ("recall", "tabs are used", 1)]
    assert len({r.id for r in store.facts().collect()}) == 2


def test_a_stream_that_starts_again_writes_the_same(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/facts")
    src = f"{tmp_path}/in"
    spark.createDataFrame([("a", "x", False), ("b", "y", False)], ROWS).write.parquet(src)
    for n in range(2):  # without its checkpoint the stream sends all rows again
        stream = spark.readStream.schema(ROWS).parquet(src)
        stream.writeStream.foreachBatch(store.store).option("checkpointLocation", f"{tmp_path}/cp{n}").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.home, r.text) for r in store.facts().collect()) == [("x", "a"), ("y", "b")]


def test_claims_move_to_the_attic(spark, tmp_path):
    store = ClaimStore(spark, f"file://{tmp_path}/claims", "id string, body string")
    claims = spark.createDataFrame([(i, f"body {i}") for i in ("aa1", "aa2", "bb1", "cc1")], "id string, body string")
    assert store.live().count() == 0 and store.prune(claims.select("id")) == 0
    store.add(claims)
    store.add(claims)
    gone = spark.createDataFrame([("aa1",), ("cc1",), ("zz9",), (None,)], "id string")
    assert store.prune(gone) == 2 and store.prune(gone) == 0
    assert {r.id for r in store.live().collect()} == {"aa2", "bb1"}
    assert {(r.id, r.body) for r in store.attic().collect()} == {("aa1", "body aa1"), ("cc1", "body cc1")}
    store.add(claims)  # what is in the attic does not come back
    assert {r.id for r in store.live().collect()} == {"aa2", "bb1"}
    kept = {r.id for r in spark.read.parquet(f"{tmp_path}/claims/live").collect()}
    assert kept == {"aa2", "bb1"}
