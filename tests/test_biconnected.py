"""Choke points against removal of every vertex."""

import random

from quillon.operators import biconnected, running
from quillon.sources import rounds


def parts(nodes, edges):
    root = {v: v for v in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a in root and b in root and top(a) != top(b):
            root[top(a)] = top(b)
    return len({top(v) for v in nodes})


def brute(nodes, edges):
    whole = parts(nodes, edges)
    out = {}
    for v in nodes:
        alone = not any(v in x and x[0] != x[1] and set(x) <= nodes for x in edges)
        more = parts(nodes - {v}, edges) - whole + alone
        if more > 0:
            out[v] = more
    return out


def test_choke_points_of_random_graphs(spark, monkeypatch):
    monkeypatch.setattr(running, "PIECE_ROWS", 9)
    rng = random.Random(6)
    graphs = [
        ({"a", "b", "c", "d"}, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "d"), ("c", "b"), ("d", "nobody")]),  # a path
        ({"hub", *"abcde", "loner"}, [("hub", x) for x in "abcde"] + [("a", "b")]),
    ]
    for n, m in ((14, 15), (30, 34), (40, 60)):
        graphs.append(({f"v{i}" for i in range(n)}, [(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(m)]))
    nodes = {f"{k}:{v}" for k, (vs, _) in enumerate(graphs) for v in vs}
    edges = [(f"{k}:{a}", f"{k}:{b}") for k, (_, es) in enumerate(graphs) for a, b in es]
    got = biconnected.chokepoints(spark.createDataFrame([*((v,) for v in nodes), (None,)], "id string"), spark.createDataFrame([*edges, (None, "0:a")], "src string, dst string"))
    want = brute(nodes, edges)
    assert {r.id: r.splits for r in got.collect()} == want
    assert want["0:b"] == 1 and want["1:hub"] == 3 and "1:loner" not in want


def test_choke_points_of_nothing(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    none = spark.createDataFrame([], "src long, dst long")
    assert biconnected.chokepoints(nodes, none).count() == 0
    assert biconnected.chokepoints(nodes, spark.createDataFrame([(1, 2)], "src long, dst long")).count() == 0
    assert biconnected.chokepoints(nodes.where("id > 5"), none).count() == 0


def test_choke_points_by_levels_and_by_tour(spark, monkeypatch):
    """A shallow graph goes level by level, each row a bounded number of times; a deep one by the tour; both with long ids as they are."""
    rng = random.Random(9)
    shallow = [(rng.randrange(60), 1000 + rng.randrange(150)) for _ in range(230)]
    deep = [(i, i + 1) for i in range(9)] + [(2, 4), (8, 10)]
    written, keep = [], rounds.Rounds.keep

    def counted(self, df, **watch):
        out = keep(self, df, **watch)
        written.append(self.seen["n"])
        return out

    monkeypatch.setattr(rounds.Rounds, "keep", counted)
    for pairs, levels in ((shallow, 24), (deep, 3)):
        written.clear()
        got = biconnected.chokepoints(None, spark.createDataFrame(pairs, "src long, dst long"), levels)
        assert {r.id: r.splits for r in got.collect()} == brute({v for x in pairs for v in x}, pairs)
        if (pairs, levels) == (shallow, 24):
            assert sum(written) < 30 * len(pairs)
