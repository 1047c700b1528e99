"""Tasks, lenses, links and dependencies of small projects, by hand."""

import pytest

from quillon.operators import project

NODES = "id string, name string, qname string, file string"
EDGES = "source string, target string, confidence double, unresolved boolean"


@pytest.fixture(scope="module")
def tree(spark):
    nodes = spark.createDataFrame([("m:a", "a", None, "src/a.js"), ("a:f", "f", "a.f", "src/a.js"), ("b:g", "g", "b.g", "src/b.js"), ("c:h", "h", "c.h", "src/c.js"), ("d:k", "k", "d.k", "src/d.js"), ("doc", "R", None, "README.md")], NODES)
    edges = spark.createDataFrame([("b:g", "a:f", 0.9, False), ("c:h", "b:g", 0.8, False), ("d:k", "c:h", 1.0, False), ("doc", "a:f", 0.5, False), ("b:g", "gone", 1.0, True)], EDGES)
    return nodes, edges


def test_tasks_break_what_depends_on_their_targets(spark, tree):
    tasks = spark.createDataFrame([(1, 0, "f"), (1, 1, "b.js"), (1, 2, "f"), (2, 0, "nothing"), (3, 0, None)], "task int, ord int, target string")
    breaks, risk = project.imagined(*tree, tasks)
    got = {(r.task, r.file): round(r.confidence, 6) for r in breaks.collect()}
    b, doc, c = 0.9 * 0.85, 0.5 * 0.85, 0.8 * 0.85  # c is nearer to b.js than to f
    d = c * 0.85
    assert got == {(1, "src/b.js"): b, (1, "README.md"): doc, (1, "src/c.js"): c, (1, "src/d.js"): round(d, 6)}
    assert {tuple(r) for r in risk.collect()} == {(1, True, round(b + doc + c + d, 4)), (2, False, 0.0), (3, False, 0.0)}


def test_tasks_walk_all_their_targets(spark):
    """the ninth target of a task and those after it break what depends on them, in every task that names them."""
    n = 12
    nodes = spark.createDataFrame([(f"{x}{i}", f"{x}{i}", None, f"{x}{i}.py") for x in "ad" for i in range(n)], NODES)
    edges = spark.createDataFrame([(f"d{i}", f"a{i}", 0.5, False) for i in range(n)] + [("a0", "a11", 0.8, False)], EDGES)
    tasks = spark.createDataFrame([(1, i, f"a{i}") for i in range(n)] + [(2, 0, "a11")], "task int, ord int, target string")
    breaks, risk = project.imagined(nodes, edges, tasks)
    got = {(r.task, r.file): round(r.confidence, 6) for r in breaks.collect()}
    assert got == {(1, f"d{i}.py"): 0.425 for i in range(n)} | {(1, "a0.py"): 0.68, (2, "a0.py"): 0.68, (2, "d11.py"): 0.425, (2, "d0.py"): 0.289}
    assert {tuple(r) for r in risk.collect()} == {(1, True, round(n * 0.425 + 0.68, 4)), (2, True, 1.394)}


def test_lens_counts_untouched_dependents_within_two_steps(spark, tree):
    changed = spark.createDataFrame([("x", "src/a.js"), ("y", "src/a.js"), ("y", "src/b.js"), ("z", "README.md")], "change string, file string")
    assert {tuple(r) for r in project.impact_lens(*tree, changed).collect()} == {("x", 2, 0.4), ("y", 2, 0.4), ("z", 0, 0.0)}


def test_impact_against_labelled_cases(spark, tree):
    cases = spark.createDataFrame([(1, "f", "src/b.js"), (2, "nobody", "q"), (3, "nobody", "q")], "case int, target string, edited string")
    expected = spark.createDataFrame([(1, "src/b.js"), (1, "src/c.js"), (1, "src/x.js"), (2, "src/b.js")], "case int, file string")
    got = {r.case: tuple(round(v, 4) for v in r[1:]) for r in project.impact_eval(*tree, cases, expected).collect()}
    assert got == {1: (0.5, 0.6667, 0.5714, 0.3333), 2: (0.0, 0.0, 0.0, 0.0), 3: (1.0, 1.0, 1.0, 1.0)}


def test_links_to_headings_that_are_not_there(spark):
    docs = spark.createDataFrame(
        [
            ("a.md", "# Top Level\n[ok](#top-level) [bad](#nowhere) [out](https://x/#y) [plain](b.md)\n```md\n[no](#example)\n# Code\n```\n[x](sub/b.md#Part-1) [y](sub/b.md#part-2) [z](c.html#q) [w](gone.md#q) [v](#code)"),
            ("sub/b.md", "## Part 1 ##\n[up](../a.md#top-level) [up2](./../a.md#low)"),
            ("notes.txt", "[t](#t)"), ("empty.md", None),
        ], "file string, text string",
    )
    assert {tuple(r) for r in project.unresolved_links(docs).collect()} == {("a.md", "#nowhere", "a.md", "nowhere"), ("a.md", "sub/b.md#part-2", "sub/b.md", "part-2"), ("a.md", "#code", "a.md", "code"), ("sub/b.md", "./../a.md#low", "a.md", "low")}


def test_dependencies_of_manifests(spark):
    man = '{"name": "p", "dependencies": {"a": "^1.0", "b": "file:../b"}, "devDependencies": {"a": "2", "@s/c": "*"}}'
    new = '{"packages": {"": {}, "node_modules/a": {"version": "1.2.3"}, "node_modules/@s/c": {"version": ""}}, "dependencies": {"@s/c": {"version": "9.9"}}}'
    rows = [("p", man, new), ("q", man, '{"dependencies": {"a": {"version": "0.1"}}}'), ("r", man, None), ("s", "{broken", new), ("t", None, None), ("u", "[1]", "[]")]
    deps = project.manifest_deps(spark.createDataFrame(rows, "project string, manifest string, lock string"))
    got = {(r.project, r.name): tuple(r[2:]) for r in deps.collect()}
    assert got == {
        ("p", "a"): ("^1.0", "dependencies", "1.2.3", False), ("p", "b"): ("file:../b", "dependencies", None, True), ("p", "@s/c"): ("*", "devDependencies", "9.9", False),
        ("q", "a"): ("^1.0", "dependencies", "0.1", False), ("q", "b"): ("file:../b", "dependencies", None, True), ("q", "@s/c"): ("*", "devDependencies", None, False),
        ("r", "a"): ("^1.0", "dependencies", None, False), ("r", "b"): ("file:../b", "dependencies", None, True), ("r", "@s/c"): ("*", "devDependencies", None, False),
    }
    rings = deps.selectExpr("project", "local", "CASE name WHEN 'a' THEN 'hold' ELSE 'adopt' END AS ring")
    assert {tuple(r) for r in project.ring_counts(rings, ["project"]).where("project = 'p'").collect()} == {("p", "hold", 1, 1), ("p", "assess", 1, 2), ("p", "adopt", 1, 4)}


def test_importers_of_risky_packages(spark):
    imports = spark.createDataFrame([("f1", "left/deep"), ("f1", "./left"), ("f2", "@s/c/x"), ("f2", "node:fs"), ("f3", "fine"), ("f3", ""), ("f4", "old"), ("f4", "old/x")], "file string, target string")
    deps = spark.createDataFrame([("left", "hold", None), ("@s/c", "assess", True), ("fine", "assess", False), ("old", "hold", False)], "name string, ring string, advisory boolean")
    assert {tuple(r) for r in project.risky_importers(imports, deps).collect()} == {("f1", "left", "hold"), ("f2", "@s/c", "assess"), ("f4", "old", "hold")}


def test_nodes_walked_as_one_reach_what_each_would(spark):
    """against a walk of every node by itself; several starts share nodes, names and files."""
    import random

    from quillon.operators import graph

    for seed in range(3):
        rng = random.Random(seed)
        nodes = [(f"n{i}", f"m{i % 25}", None, None if i == 7 else f"f{i % 6}") for i in range(60)] + [("n3", "m3", None, "f5")]
        edges = [(f"n{rng.randrange(62)}", f"n{rng.randrange(60)}", rng.choice([1.0, 0.9, 0.6, 1.3, None]), rng.random() < 0.1) for _ in range(70)]
        edges += [(f"n{i % 6}", f"n{i}", 1.0, False) for i in range(6, 60) if rng.random() < 0.8]
        starts = {(c, f"n{i}") for c, k in ((1, 0), (2, 1), (2, 2)) for i in range(k, 60, 6)} | {(c, f"n{rng.randrange(63)}") for c in (2, 3, 4) for _ in range(4)}
        n, e, s = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(sorted(starts), "case int, id string")
        got = {(r["case"], r.file): round(r.strength, 9) for r in project._walked(n, e, s, ["case"], 4).collect()}
        plain = graph.impact(e.where("not unresolved").selectExpr("source AS src", "target AS dst", "confidence AS w"), s, hops=4, by=("case",))
        want = {}
        for r in plain.join(n.select("id", "file").distinct(), "id").collect():
            want[r["case"], r.file] = max(want.get((r["case"], r.file), 0), round(r.strength, 9))
        assert got == want and len(got) > 10


def plain_impact(nodes, edges, starts, hazards, cycles, threshold=0.1, hops=6):
    file = {i: f for i, _, _, f in nodes}
    best, front = dict.fromkeys(starts, (1.0, 0)), dict.fromkeys(starts, 1.0)
    for hop in range(1, hops + 1):
        offers = {}
        for target, strength in front.items():
            for s, t, kind, c in edges:
                if t != target or s in starts:
                    continue
                x = strength * project.EDGE_WEIGHT.get(kind, 0.5) * c * 0.85
                f = file.get(s)
                if x < threshold / (1 + hazards.get(f, 0)):
                    continue
                reach = [s] + [i for i in file if f in cycles and file[i] != f and cycles.get(file[i]) == cycles[f]]
                for i in reach:
                    if i not in starts:
                        offers[i] = max(offers.get(i, 0), x)
        front = {i: x for i, x in offers.items() if x > best.get(i, (0, 0))[0]}
        best |= {i: (x, hop) for i, x in front.items()}
    return {i: (round(x, 9), h) for i, (x, h) in best.items() if h}


def test_impact_with_kinds_hazards_and_cycles(spark):
    import random

    rng = random.Random(4)
    for seed in range(3):
        nodes = [(f"n{i}", f"n{i}", None, f"f{i % 7}") for i in range(30)]
        edges = [(f"n{rng.randrange(32)}", f"n{rng.randrange(30)}", rng.choice(["calls", "imports", "contains", "odd"]), rng.choice([1.0, 0.9, 0.6])) for _ in range(55)]
        hazards, cycles = {"f1": 1.5, "f5": 0.2}, {"f2": "c", "f3": "c", "f4": "d", "f6": "d"}
        got = project.code_impact(
            spark.createDataFrame(nodes, NODES), spark.createDataFrame([(*e, False) for e in edges] + [("n1", "n0", "calls", 1.0, True)], "source string, target string, kind string, confidence double, unresolved boolean"),
            spark.createDataFrame([("n0",), ("n3",)], "id string"), spark.createDataFrame(list(hazards.items()), "file string, hazard double"), spark.createDataFrame(list(cycles.items()), "file string, cycle string"),
        )
        assert {r.id: (round(r.strength, 9), r.hops) for r in got.collect()} == plain_impact(nodes, edges, {"n0", "n3"}, hazards, cycles)


def test_files_in_a_circle(spark):
    nodes = spark.createDataFrame([("a", "a", None, "x.js"), ("b", "b", None, "y.js"), ("c", "c", None, "z.js"), ("a2", "a2", None, "x.js")], NODES)
    edges = spark.createDataFrame([("a", "b", "calls", 1.0, False), ("b", "a2", "imports", 1.0, False), ("c", "a", "calls", 1.0, False), ("a", "c", "contains", 1.0, False)], "source string, target string, kind string, confidence double, unresolved boolean")
    assert {tuple(r) for r in project.cycle_index(nodes, edges).collect()} == {("x.js", "y.js"), ("y.js", "y.js")}
