"""Assembly under a budget against a plain loop."""

import random

import pytest

from quillon.operators import context, running

SCHEMA = "task string, item string, source string, ord long, score double, covers array<string>, ladder array<struct<level:string, tokens:long>>"


def plain(rows, budget):
    tasks = {}
    for task, item, source, o, score, covers, ladder in rows:
        if task is None or item is None or not ladder:
            continue
        it = tasks.setdefault(task, {}).setdefault(item, {"covers": set(), "score": score, "rows": []})
        it["covers"] |= set(covers or [])
        it["score"] = max(it["score"], score)
        it["rows"].append((o, source, ladder))
    out = set()
    for task, items in tasks.items():
        for it in items.values():
            it["ord"], it["source"], it["ladder"] = min(it["rows"], key=lambda r: r[:2])
        pinned = sorted((it["ord"], name) for name, it in items.items() if it["covers"])
        level = {name: 0 for _, name in pinned}
        tokens = lambda n: items[n]["ladder"][level[n]][1]
        while sum(map(tokens, level)) > budget:
            can = [n for _, n in pinned if level[n] < len(items[n]["ladder"]) - 1]
            if not can:
                break
            level[max(can, key=tokens)] += 1  # max keeps the first of equals
        for n, v in level.items():
            out.add((task, n, items[n]["source"], *items[n]["ladder"][v], True))
        used, count = sum(map(tokens, level)), {}
        for _, n in sorted((-it["score"], n) for n, it in items.items() if not it["covers"]):
            name, size = items[n]["ladder"][0]
            if used + size > budget:
                continue
            used += size
            out.add((task, n, items[n]["source"], name, size, False))
            k = count[items[n]["source"]] = count.get(items[n]["source"], 0) + 1
            if 0.7 ** (k - 1) < 0.2:
                break
    return out


@pytest.mark.parametrize("budget", [0, 40, 700])
def test_assembly_is_the_plain_loop(spark, monkeypatch, budget):
    monkeypatch.setattr(running, "PIECE_ROWS", 25)
    rng = random.Random(budget)
    rows = [(None, "x", "s", 0, 1.0, [], [("full", 1)]), ("t0", None, "s", 0, 1.0, [], [("full", 1)]), ("t0", "none", "s", 0, 1.0, ["k"], []), ("t0", "nil", "s", 1, 1.0, ["k"], None)]
    for t in range(12):
        for i in range(rng.choice([1, 5, 40])):
            full = rng.choice([0, 1, 3, 8, 20, 50, 120])
            ladder = [("full", full)] + rng.choice([[], [("head", rng.choice([0, 5, 30])), ("pointer", 8)], [("pointer", 8)]])
            rows.append((f"t{t}", f"i{i:02}", rng.choice("ab"), i // 2, rng.choice([0.1, 0.5, 0.9]), rng.choice([None, [], ["k1"], ["k2", "k3"]]), ladder))
        rows.append((f"t{t}", "i00", "a", 99, 0.95, ["late"], [("other", 7)]))  # an item twice
    df = spark.createDataFrame(rows, SCHEMA)
    got = context.assembled(df, budget)
    assert {tuple(r) for r in got.collect()} == plain(rows, budget)


def test_completeness_names_what_nothing_covers(spark):
    items = spark.createDataFrame([("t", "a", "s", 0, 1.0, ["k1"], [("full", 5)]), ("u", "b", "s", 0, 1.0, [], [("full", 5)])], SCHEMA)
    need = spark.createDataFrame([("t", "k1", True), ("u", "k1", True), ("u", "k2", False)], "task string, key string, resolvable boolean")
    got = context.complete(need, context.assembled(items), items)
    assert {tuple(r) for r in got.collect()} == {("t", True, 0, 0), ("u", False, 2, 1)}
