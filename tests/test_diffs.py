"""Diffs of a small project, from lines to impact, by hand."""

import pytest

from quillon.operators import diffs
from quillon.sources import code

DIFF = """diff --git a/src/tax.js b/src/tax.js
index 1..2 100644
--- a/src/tax.js
+++ b/src/tax.js
@@ -1,3 +1,3 @@ head
 const one = 1;
-export function oldName(x) { return process.env.TAX_RATE }
+export function newName(x) { return process.env.TAX_RATE }
 // end
@@ -10 +10,2 @@
--- a line of dashes
+++ a line of pluses
+see --verbose
\\ No newline at end of file
diff --git a/docs/gone.md b/docs/gone.md
--- a/docs/gone.md
+++ /dev/null
@@ -1,2 +0,0 @@
-first
-
diff --git a/a b.yml b/a b.yml
--- a/a b.yml	2024
+++ b/a b.yml	2024
@@ -1 +1 @@
-key: [1, 2]
+key: [1,2,]
"""


def hunks(spark, *texts):
    return diffs.hunk_lines(spark.createDataFrame(list(enumerate(texts)), "id int, d string"), "id", "d")


def test_lines_have_their_numbers_on_both_sides(spark):
    got = [tuple(r)[1:] for r in hunks(spark, DIFF).collect()]
    assert got == [
        ("src/tax.js", " ", 1, 1, "const one = 1;"),
        ("src/tax.js", "-", 2, None, "export function oldName(x) { return process.env.TAX_RATE }"),
        ("src/tax.js", "+", None, 2, "export function newName(x) { return process.env.TAX_RATE }"),
        ("src/tax.js", " ", 3, 3, "// end"),
        ("src/tax.js", "-", 10, None, "-- a line of dashes"),
        ("src/tax.js", "+", None, 10, "++ a line of pluses"),
        ("src/tax.js", "+", None, 11, "see --verbose"),
        ("docs/gone.md", "-", 1, None, "first"),
        ("docs/gone.md", "-", 2, None, ""),
        ("a b.yml", "-", 1, None, "key: [1, 2]"),
        ("a b.yml", "+", None, 1, "key: [1,2,]"),
    ]
    assert hunks(spark, None, "", "no diff").count() == 0


def test_kinds_and_signals_of_changes(spark):
    got = {r.artifact: r for r in diffs.changed_files(hunks(spark, DIFF), "id").collect()}
    assert {k: (r.kind, r.confidence) for k, r in got.items()} == {"src/tax.js": ("public_api", 0.86), "docs/gone.md": ("docs", 0.99), "a b.yml": ("formatting", 0.98)}
    assert got["src/tax.js"].signal["contract"] == 1.0 and got["a b.yml"].signal["runtime"] == pytest.approx(0.005 * (1 + 0.22 * 1.5849625 / 8))
    more = hunks(spark, "--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,1 @@\n-a = 1\n-check(password)\n-c = 3\n+d = 4\n", "--- a/src/t.test.js\n+++ b/src/t.test.js\n@@ -0,0 +1 @@\n+it()\n", "--- a/p/package.json\n+++ b/p/package.json\n@@ -1 +1 @@\n-1\n+2\n")
    got = {r.artifact: r for r in diffs.changed_files(more, "id").collect()}
    assert {k: r.kind for k, r in got.items()} == {"x.py": "logic", "src/t.test.js": "test", "p/package.json": "dependency"}
    x = got["x.py"].signal
    assert (x["runtime"], x["contract"], x["verification"], x["merge"], got["x.py"].confidence) == (0.82, 0.72, 0.96, 0.22, 0.78)


def test_entities_that_a_diff_changes_and_removes(spark):
    files = spark.createDataFrame(
        [("src/tax.js", "export function newName(x) { return process.env.TAX_RATE }\nexport const kept = 2"), ("src/cli.js", "usage: --verbose --dry-run"), ("package.json", '{"version": "1.2.3"}'), ("notes.md", "export function no() {}"), ("null.js", None)], "file string, text string"
    )
    now = diffs.entities(files)
    assert {(r.type, r.name) for r in now.collect()} == {("symbol", "newName"), ("symbol", "kept"), ("env", "TAX_RATE"), ("flag", "--verbose"), ("flag", "--dry-run"), ("version", "1.2.3")}
    more = '--- a/package.json\n+++ b/package.json\n@@ -1 +1 @@\n-{"version": "1.2.2"}\n+{"version": "1.2.3"}\n--- a/src/cli.js\n+++ b/src/cli.js\n@@ -1 +1 @@\n-x --old-flag\n+x --dry-run\n'
    got = {tuple(r) for r in diffs.changed_entities(hunks(spark, DIFF, more), "id", now).collect()}
    assert got == {
        (0, "symbol", "newName", False), (0, "env", "TAX_RATE", False), (0, "symbol", "oldName", True),
        (1, "version", "1.2.3", False), (1, "version", "1.2.2", True), (1, "flag", "--dry-run", False), (1, "flag", "--old-flag", True),
    }


def test_a_diff_reaches_tests_and_documents(spark, tmp_path):
    tree = {"src/tax.js": "export function newName(x) { return 1 }\n", "src/user.js": "function use() { return newName(2) }\n", "test/tax.test.js": "function check() { return newName(1) }\n", "README.md": "`newName` is here\n", "other.js": "function alone() {}\n"}
    for name, text in tree.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(text)
    nodes, edges, _ = code.CodeGraph(spark, f"file://{tmp_path}/s").build(code.source_files(spark, f"file://{tmp_path}/t"))
    rel = {(r.src, r.dst, r.kind) for r in diffs.relations_of(nodes, edges).collect()}
    assert rel == {("src/tax.js", "src/user.js", "calls"), ("src/tax.js", "test/tax.test.js", "verified_by"), ("src/tax.js", "README.md", "documented_by")}
    changes, hit = diffs.diff_impact(hunks(spark, DIFF), "id", nodes, edges)
    hit = {r.artifact: r for r in hit.collect()}
    assert changes.count() == 3 and hit["src/tax.js"].changed and not hit["README.md"].changed
    assert hit["test/tax.test.js"].verification > 0.5 and hit["README.md"].docs > 0.4 and hit["src/user.js"].runtime > 0.4
    assert "other.js" not in hit
