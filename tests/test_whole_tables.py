"""Queries over whole tables: no row of the input stays out."""

import numpy as np

from quillon.operators import metrics
from quillon.plans import catalog, records  # noqa: F401  (adds its queries to the catalog)


def test_components_use_every_line(spark, tmp_path):
    rows = [(1, 1, 10), (61, 1, 11), (2, 2, 11), (3, 3, 12)]  # only order 61 is a multiple of 61
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.id: r.component for r in catalog.QUERIES["g11_components"](spark, str(tmp_path)).collect()}
    part = 100_000_000
    assert got == {1: 1, 2: 1, part + 10: 1, part + 11: 1, 3: 3, part + 12: 3}


def test_shingles_of_every_language(spark, tmp_path):
    rows = [(1, "a b c d e", "en"), (2, "a b c d e", "de"), (3, "x", None), (4, None, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n for r in catalog.QUERIES["r6_shingles"](spark, str(tmp_path)).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 0}


def test_nearest_takes_every_query_and_every_other_row(spark):
    rng = np.random.default_rng(5)
    v = [[float(x) for x in rng.normal(size=6)] for _ in range(260)]
    v[3], v[50] = v[100], [0.0] * 6
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    m = np.array(v)
    m = m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
    want = []
    for i in range(0, 260, 50):
        s = np.round(m @ m[i], 9)
        want += [(i, r + 1, int(j)) for r, j in enumerate([j for j in np.lexsort((np.arange(260), -s)) if j != i][:3])]
    got = metrics.nearest(df, block=64).select("query_id", "rank", "vec_id").collect()
    assert sorted(map(tuple, got)) == want


def test_ladder_answers_from_every_other_document(spark, tmp_path):
    text = "one two three four five six seven eight nine"
    rows = [(50, text), (100, text), (150, "quite other words stand here all alone today"), (7, "more of it")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.query_id: (r.tier, r.artifact_id) for r in catalog.QUERIES["r10_reuse_ladder"](spark, str(tmp_path)).collect()}
    assert got == {50: ("exact", 100), 100: ("exact", 50), 150: ("miss", None)}


def test_ranks_of_groups_of_any_size(spark, monkeypatch):
    from quillon.operators import running

    monkeypatch.setattr(running, "PIECE_ROWS", 5)
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.integers(0, 9, 60)] + [("b", float(v)) for v in rng.normal(size=41)] + [("c", 5.0), (None, 1.0), (None, 2.0), ("d", None)]
    got = {r.g: (r.median, r.p95) for r in metrics.median_p95(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    for g in ("a", "b", "c", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == (np.median(v), v[-(-95 * len(v) // 100) - 1])
    assert set(got) == {"a", "b", "c", None}


def test_average_precision_is_the_loop(spark, monkeypatch):
    from quillon.operators import running

    monkeypatch.setattr(running, "PIECE_ROWS", 5)
    rng = np.random.default_rng(3)
    rows = [(g, i, float(rng.integers(0, 6)), int(rng.integers(0, 2)) if g != "none" else 0) for i in range(30) for g in ("x", "y", "none")]
    got = {r.g: r.ap for r in metrics.average_precision(spark.createDataFrame(rows, "g string, ord int, score double, label int"), "g").collect()}
    for g in ("x", "y"):
        hits, total = 0, 0.0
        for k, (_, _, _, y) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])), 1):
            hits += y
            total += hits / k if y else 0
        assert abs(got[g] - total / hits) < 1e-12
    assert got["none"] is None
