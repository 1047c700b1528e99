"""A cache that forgets its oldest entries."""

import json

from quillon.operators import running
from quillon.sources.caches import VectorCache


def test_newest_entries_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(running, "PIECE_ROWS", 4)
    cache = VectorCache(spark, f"file://{tmp_path}/c", 400)
    held, at = [], 0
    for n in (3, 9, 1, 12, 30, 2):
        at += 1
        rows = [(f"k{(at * 7 + i) % 25}", [float(i), 0.5]) for i in range(n)]
        bad = [(None, [1.0]), ("x", []), ("y", None), ("z", [float("nan")]), ("w", [None])]
        cut = cache.append(spark.createDataFrame([*rows, *bad], "k string, v array<double>"))
        held = [(at, *r) for r in rows] + held
        size = lambda r: len(json.dumps({"k": r[1], "v": r[2]}, separators=(",", ":"))) + 1
        assert cut == (sum(map(size, held)) > 400)
        if cut:
            kept, total = [], 0
            for r in sorted(held, key=lambda r: (-r[0], r[1])):
                total += size(r)
                if total > 200:
                    break
                kept.append(r)
            held = kept
        want = {}
        for a, k, v in sorted(held, key=lambda r: r[0]):
            want[k] = v
        assert {r.k: r.v for r in cache.read().collect()} == want
    asked = spark.createDataFrame([("k1",), ("nothing",), (None,), ("nothing",)], "k string")
    assert {r.k for r in cache.missing(asked).collect()} == {"k1", "nothing"} - set(want)
    assert VectorCache(spark, f"file://{tmp_path}/none", 1).read().count() == 0
