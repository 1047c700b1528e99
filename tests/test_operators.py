"""Laws and hand-computed answers."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import graph, ledger, metrics


def evidence(spark, rows):
    return spark.createDataFrame(rows, "claim_id long, author string, oracle string, result string, resolved boolean, t int, h string")


ONE = (1, "a", "test.run", "confirm", True, 0, "h1")


def test_confidence_values(spark):
    e = evidence(spark, [ONE, (2, "a", "test.run", "confirm", False, 0, "h2"), (3, "a", "human.revert", "contradict", True, 0, "h3"), (4, "a", "made.up", "confirm", True, 0, "h4")])
    got = {r.claim_id: r.val for r in ledger.confidence(e, 0).collect()}
    assert got[1] == pytest.approx(1.8 / 2.8)
    assert got[2] == 0.55  # never resolved: capped
    assert got[3] == pytest.approx(1 / 3)
    assert 4 not in got  # unknown oracles are not evidence
    every = {r.claim_id: r.val for r in ledger.confidence(e, 0, claims=e.select("claim_id")).collect()}
    assert every[4] == 0.5 and every[1] == got[1]
    bad = e.withColumn("h", F.when(F.col("claim_id") == 1, F.col("h"))).withColumn("ref", F.when(F.col("claim_id") == 3, F.lit("git:")))
    assert {r.claim_id for r in ledger.confidence(bad, 0).collect()} == {1}
    late = {r.claim_id: r.val for r in ledger.confidence(e, 45).collect()}
    assert late[1] == pytest.approx(1.4 / 2.4)


def test_merge_is_commutative_associative_idempotent(spark):
    a, b, c = (evidence(spark, [ONE, (k, "x", "ci.run", "confirm", True, k, f"k{k}")]) for k in (2, 3, 4))

    def state(df):
        return sorted(map(tuple, df.collect()))

    assert state(ledger.merged(a, b)) == state(ledger.merged(b, a))
    assert state(ledger.merged(ledger.merged(a, b), c)) == state(ledger.merged(a, ledger.merged(b, c)))
    assert state(ledger.merged(a, a)) == state(a)


def test_unmeasured_is_null(spark):
    e = spark.createDataFrame([("gate", "halt", 1.0, 1.0)], "stage string, outcome string, saved double, used double")
    r = metrics.stage_factors(e).first()
    assert r.gate == 1.0 and r.cache is None and r.context is None


def test_page_rank_sums_to_one(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("c", "b", 1.0), ("b", "b", 5.0), ("d", "zz", 1.0)], "src string, dst string, w double")
    got = {r.id: r["rank"] for r in graph.page_rank(nodes, edges).collect()}
    assert sum(got.values()) == pytest.approx(1) and max(got, key=got.get) == "b"


def test_impact_diamond_and_cycle(spark):
    edges = spark.createDataFrame([("b", "a", 0.9), ("c", "a", 0.5), ("d", "b", 0.9), ("d", "c", 1.0), ("a", "d", 1.0)], "src string, dst string, w double")
    got = {r.id: r.strength for r in graph.impact(edges, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {"b": pytest.approx(0.765), "c": pytest.approx(0.425), "d": pytest.approx(0.765 * 0.9 * 0.85)}


def test_components_of_cycle_and_loner(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (5, 5)], "src long, dst long")
    assert {r.id: r.component for r in graph.components(nodes, edges).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
