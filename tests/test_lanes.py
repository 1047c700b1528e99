"""Exact joins on sketches against all pairs."""

import random

import numpy as np
import pytest

from quillon.operators import lanes, sketches

WORDS = "ab cd ef gh ij kl mn op qr st uv wx yz a1 b2 c3".split()


def texts(n, seed):
    rng = random.Random(seed)
    bases = [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(4)]
    out = [None, "", "...", "one", "One two", "three words here", "Ünï cöde K \n lines", bases[0], bases[0].upper()]
    for i in range(n):
        w = rng.choice(bases).split()
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w) + rng.choice(["", " tail", "!"]))
    return out


def test_sketches_of_many_texts_at_once():
    made = [*texts(60, 1), "x" * 5000, "y" * 3000 + " z", "word " * 500, "é", " lead and trail "]
    for n in (4, 2):
        got = lanes.sketches_of(made, n)
        for t, s in zip(made, got):
            assert (s == sketches.sketch_of(sketches.shingles_of(t, n))).all(), t
    assert lanes.sketches_of([]).shape == (0, 128)


def test_shingles_are_counted_as_sets():
    made = [*texts(40, 9), "ab cd " * 50, "x" * 4000]
    for n in (4, 1):
        assert lanes.shingle_counts_of(made, n).tolist() == [len(set(sketches.shingles_of(t, n))) for t in made]


def test_groups_cover_all_lanes():
    for groups in (26, 39, 52):
        for cut in range(3):
            got = lanes.lane_groups(groups, cut)
            assert sorted(np.concatenate(got)) == list(range(128)) and len(got) == groups
    zero = {frozenset(g) for g in lanes.lane_groups(39, 0)}
    assert not any(frozenset(g) <= z for g in lanes.lane_groups(39, 1) for z in zero)


def brute_clusters(rows, tau):
    sk = {i: sketches.sketch_of(sketches.shingles_of(t)) for i, t in rows}
    root = {i: i for i in sk}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sk:
        for b in sk:
            if a < b and (sk[a] == sk[b]).sum() / 128 >= tau:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    groups = {}
    for i in sk:
        groups.setdefault(top(i), []).append(i)
    return {i: g for g, ids in groups.items() if len(ids) > 1 for i in ids}


@pytest.mark.parametrize("crowd,block", [(64, 512), (2, 3), (0, 2)])
def test_clusters_find_every_link(spark, crowd, block):
    rows = list(enumerate(texts(70, 2)))
    df = spark.createDataFrame([*rows, (3, "one"), (None, "one")], "id long, text string")
    got = {r.id: r.cluster for r in lanes.clusters(df, 0.7, crowd, block).collect()}
    want = brute_clusters(rows, 0.7)
    assert got == want and len(set(want.values())) > 3
    assert lanes.clusters(df.where("id < 0")).count() == 0


@pytest.mark.parametrize("crowd,block", [(64, 512), (1, 4)])
def test_ladder_finds_the_best_of_all(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(lanes.best_matches, "__defaults__", (crowd, block))
    rows = list(enumerate(texts(80, 3)))
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.query_id: (r.tier, r.artifact_id, r.sim) for r in lanes.reuse_ladder(df.where("id % 3 = 0"), df).collect()}
    sk = {i: sketches.sketch_of(sketches.shingles_of(t)) for i, t in rows}
    tiers = set()
    for i in range(0, len(rows), 3):
        sim, j = min((-(sk[i] == s).sum() / 128, j) for j, s in sk.items() if j != i)
        tier = "exact" if sim == -1 else "near" if sim <= -0.8 else "adapt" if sim <= -0.6 else "miss"
        assert got[i] == ((tier, j, -sim) if tier != "miss" else ("miss", None, None)), i
        tiers.add(tier)
    assert tiers == {"exact", "near", "adapt", "miss"}


def test_texts_become_strings_one_run_at_a_time(spark, monkeypatch):
    """F16, F22: a batch is read in runs of bounded bytes, and digests are those of the sketches."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    monkeypatch.setattr(lanes, "SLICE", 20)
    col = pa.array(["a b c d e f", None, "", "x" * 50, "Ünï çode d e", "a b c d e f"])
    assert [(lo, hi) for lo, hi, _ in lanes._runs(col)] == [(0, 3), (3, 4), (4, 5), (5, 6)]
    assert [t for _, _, texts in lanes._runs(col) for t in texts] == col.to_pylist()
    df = spark.createDataFrame(list(enumerate(col.to_pylist())), "id long, text string").coalesce(1)
    want = df.select("id", sketches.sketch(F.col("text")).alias("sk")).select("id", F.sha2(F.array_join("sk", ","), 256).alias("s"), sketches.band_keys("sk")[0].alias("b"))
    assert sorted(map(tuple, lanes.digests(df, "id", "text").collect())) == sorted(map(tuple, want.collect()))


def test_a_crowd_of_like_texts_meets_once(spark, monkeypatch):
    """members of crowded buckets meet once, not once for each bucket and cut; no table has more rows than the first buckets."""
    rng = random.Random(8)
    base = [rng.choice(WORDS) + str(i) for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    sizes = []
    keep = lanes.Rounds.keep

    def seen(self, df, **watch):
        out = keep(self, df, **watch)
        sizes.append(self.seen["n"])
        return out

    monkeypatch.setattr(lanes.Rounds, "keep", seen)
    got = {r.id: r.cluster for r in lanes.clusters(spark.createDataFrame(rows, "id long, text string"), 0.7, 8, 16).collect()}
    assert got == brute_clusters(rows, 0.7)
    assert max(sizes) <= 39 * len(rows)
