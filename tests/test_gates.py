"""Laws and hand-computed answers of gates, upkeep and merge impact."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import gates, ledger, merge, retrieval, upkeep


def test_merge_field_takes_the_best_path_and_ends_on_cycles(spark):
    relations = spark.createDataFrame([("a", "b", "calls", 1.0), ("b", "c", "calls", 0.5), ("a", "c", "imports", 0.1), ("c", "a", "calls", 1.0), ("c", "x", "unheard", 1.0)], "src string, dst string, kind string, confidence double")
    signals = spark.createDataFrame([("a", "runtime", 0.8)], "seed string, dim string, v double")
    found = merge.field(signals, relations)
    got = {(r.artifact, r.dim): r.v for r in found.collect()}
    assert got["a", "runtime"] == 0.8
    assert got["b", "runtime"] == pytest.approx(0.8 * 0.94 * 0.9)
    assert got["c", "runtime"] == pytest.approx(0.8 * 0.94 * 0.9 * 0.94 * 0.5 * 0.9)
    assert got["b", "verification"] == pytest.approx(0.8 * 0.24 * 0.9)
    assert not any(a == "x" for a, _ in got)
    hit = merge.impacted(found, spark.createDataFrame([("b", "source", 1.0)], "artifact string, kind string, criticality double"))
    rows = {r.artifact: r for r in hit.collect()}
    assert rows["a"].changed and not rows["b"].changed and rows["c"].kind == "unknown"
    one = merge.summary(hit, signals, relations).collect()
    assert len(one) == 1 and one[0].peak == max(r.overall for r in rows.values()) and one[0].level in ("low", "medium", "high", "critical")


def test_merge_summary_by_hand(spark):
    relations = spark.createDataFrame([("a", "t", "verified_by", 0.5)], "src string, dst string, kind string, confidence double")
    signals = spark.createDataFrame([("a", "runtime", 0.6), ("z", "docs", 0.4)], "seed string, dim string, v double")
    found = merge.field(signals, relations)
    hit = merge.impacted(found, spark.createDataFrame([("t", "test", 0.0)], "artifact string, kind string, criticality double"))
    a = 0.7 * 0.6 + 0.3 * 0.6 * 0.22
    v = 0.6 * 0.98 * 0.5 * 0.9
    t = 0.7 * v + 0.3 * v * 0.18
    r = merge.summary(hit, signals, relations).first()
    assert r.peak == pytest.approx(a) and r.breadth == pytest.approx(1 - 2.718281828459045 ** (-t / 4))
    assert r.uncertainty == pytest.approx(1 - (1 - 0.18 * 0.6 * 0.5) * (1 - 0.65 * 0.4))
    assert r.gap == 0.0  # the only grave artifact has a test


def test_gate_rows(spark):
    rows = [(1, "src/a.js", False, False), (2, "src/a.js", True, False), (3, "src/a.js", True, True), (4, "t/a.test.js", False, False), (5, ".ledger/x", False, False), (6, "a.yml", False, False), (7, "README.md", False, False), (8, "data.bin", False, False), (9, "src/a.js", False, False), (9, "b.md", False, False)]
    df = spark.createDataFrame(rows, "g int, path string, verified boolean, state boolean")
    got = {r.g: (r.allow, r.row) for r in gates.stop_gate(df, "g", "path", "verified", "state").collect()}
    assert got == {
        1: (False, "code-without-test-evidence"), 2: (False, "code-without-docs"), 3: (True, "code-with-evidence"), 4: (True, "test-only"), 5: (True, "no-changes"),
        6: (False, "config-without-docs"), 7: (True, "docs-touched"), 8: (True, "no-code-class"), 9: (False, "code-without-test-evidence"),
    }


def test_globs(spark):
    df = spark.createDataFrame([("src/*.js", "src/a.js", True), ("src/*.js", "src/b/a.js", False), ("src/**", "src/b/a.js", True), ("a+b?.c", "a+b?.c", True), ("a.c", "abc", False)], "g string, f string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("p", retrieval.glob_pattern(F.col("g"))).withColumn("got", F.expr("f rlike p")).collect())


def test_imported_counts_become_dated_rows_once(spark):
    old = spark.createDataFrame([("a", 3, 10), ("b", 0, 10), ("c", 2, 9)], "k string, n int, day int")
    known = spark.createDataFrame([("c",)], "k string")
    assert sorted(map(tuple, upkeep.imported(old, known, "k", "n", "day").collect())) == [("a", 8), ("a", 9), ("a", 10)]


def test_state_leaves_out_what_was_minted_later(spark):
    claims = spark.createDataFrame([(1, "x", 5), (2, "x", 9), (3, "x", None)], "claim_id long, author string, t int")
    e = spark.createDataFrame([(1, "y", "test.run", "confirm", True, 6), (2, "y", "test.run", "confirm", True, 6), (1, "y", "test.run", "confirm", True, 8)], "claim_id long, author string, oracle string, result string, resolved boolean, t int")
    got = {r.claim_id: r.val for r in ledger.state_at(claims, e, 6).collect()}
    assert set(got) == {1, 3} and got[3] == 0.5 and got[1] == pytest.approx(1.8 / 2.8)


def test_styles_by_hand(spark):
    from quillon.operators import styles

    schema = "id int, hues array<double>, palette int, spacing array<double>, base double, fonts array<string>, radii array<double>, radius_levels int, shadow_levels int"
    stock = (1, [217.0, 239.0], 2, [8.0, 16.0, 32.0], 8.0, ["a"], [12.0], 1, 1)
    other = (2, [30.0], 1, [5.0, 7.0], 5.0, ["x", "y"], [3.0], 3, 4)
    bare = (3, [], 0, [], 0.0, [], [], 0, 0)
    df = spark.createDataFrame([stock, other, bare], schema)
    got = {r.id: r.n for r in df.withColumn("n", styles.nearest_template()).collect()}
    assert (got[1].distance, got[1].name) == (0.0, "tailwind-default") and got[2].distance > 0.4 and got[3] is None
    cols = [c for c in df.columns if c != "id"]
    pair = df.where("id = 1").select(F.struct(*cols).alias("a")).crossJoin(df.where("id = 2").select(F.struct(*cols).alias("b")))
    palette = ((173 + 151) / 2 + 151) / 2 / 180
    spacing = (min(1, abs(0.678071905) / 2) + 1 - 0.0) / 2
    want = (round(palette, 3) + round(spacing, 3) + 1 + round((1 + 2 / 3) / 2, 3) + 1) / 5
    assert pair.select(styles.conformance("a", "b").alias("d")).first().d == pytest.approx(want, abs=0.051)
    same = df.where("id = 1").select(F.struct(*cols).alias("a"), F.struct(*cols).alias("b"))
    assert same.select(styles.conformance("a", "b").alias("d")).first().d == 0.0


def test_lesson_fold_against_a_loop(spark):
    import random

    from quillon.operators import styles

    def plain(events):
        status, up, down, back, last = "candidate", 0, 0, 0, 0
        for day, ok in events:
            if status == "retired":
                continue
            if ok:
                up, last = up + 1, day
                if status == "quarantined":
                    back += 1
                    if back >= 2:
                        status, back = "active", 0
                else:
                    status, back = "active", 0
            else:
                down += 1
                if status == "quarantined":
                    status = "retired"
                elif 0.5 ** (max(0, day - last) / 45) * (1 + up) / (2 + up + down) < 0.3:
                    status = "quarantined"
        return status, up, down

    rng = random.Random(1)
    rows = [(i, [(d, rng.random() < 0.6) for d in sorted(rng.randrange(90) for _ in range(rng.randrange(14)))]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, es array<struct<day: int, confirm: boolean>>")
    got = {r.id: (r.s.status, r.s.confirmed, r.s.contradicted) for r in df.withColumn("s", styles.lesson_state(F.col("es"))).collect()}
    assert got == {i: plain(e) for i, e in rows}
