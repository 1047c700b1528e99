"""Code graphs of small trees, built in full and again."""

from quillon.operators import graph
from quillon.sources import code

TREE = {
    "a.js": "export function computeTax(x){ return x*0.2 }\nclass Ledger {}\nexport class Book extends Ledger {}\nimport { helper } from './lib/util'\n",
    "lib/util.ts": "export const helper = (y) => computeTax(y)\nhelper(3); console.log(1)\n",
    "b.py": "import os, sys\nfrom lib.util import helper\ndef load_config():\n    return parse(load_config())\nclass Base(object):\n    pass\nclass Store(mod.Base, metaclass=Meta):\n    pass\n",
    "README.md": "See `lib/util.ts` and `computeTax()` or `if`.\n`computeTax` again, [here](./a.js) and [there](https://x.y/a.js).\n",
    ".github/workflows/ci.yml": "run: node ./a.js && python b.py\n",
    "CHANGELOG.md": "`computeTax`\n",
    "node_modules/x.js": "function hidden() {}\n",
    "data.bin": "function hidden() {}\n",
    "empty.go": "",
}


def write(root, tree):
    for name, text in tree.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_nodes_and_edges_of_a_tree(spark, tmp_path):
    write(tmp_path / "src.d", TREE)
    files = code.source_files(spark, f"file://{tmp_path}/src.d")
    nodes, edges, n = code.CodeGraph(spark, f"file://{tmp_path}/store").build(files)
    assert n == 5
    got = {(r.id, r.kind) for r in nodes.collect()}
    assert got == {
        ("module:a", "module"), ("module:lib.util", "module"), ("module:b", "module"), ("doc:README.md", "doc"), ("config:.github/workflows/ci.yml", "config"),
        ("a.js:computeTax:1", "function"), ("a.js:Ledger:2", "class"), ("a.js:Book:3", "class"), ("lib/util.ts:helper:1", "const"), ("b.py:load_config:3", "function"), ("b.py:Base:5", "class"), ("b.py:Store:7", "class"),
    }
    e = {(r.source, r.target, r.kind, round(r.confidence, 4), r.unresolved) for r in edges.collect() if r.kind != "contains"}
    assert e == {
        ("a.js:Book:3", "a.js:Ledger:2", "inherits", 0.81, False),
        ("a.js:Book:3", "./lib/util", "imports", 0.85, True),
        ("lib/util.ts:helper:1", "a.js:computeTax:1", "calls", 0.675, False),
        ("module:b", "os", "imports", 0.85, True), ("module:b", "sys", "imports", 0.85, True),
        ("module:b", "lib.util", "imports", 0.85, True), ("module:b", "lib/util.ts:helper:1", "imports", 0.85, False),
        ("b.py:load_config:3", "parse", "calls", 0.75, True),
        ("b.py:Store:7", "b.py:Base:5", "inherits", 0.81, False),
        ("doc:README.md", "module:lib.util", "references", 0.8, False), ("doc:README.md", "a.js:computeTax:1", "references", 0.54, False), ("doc:README.md", "module:a", "references", 0.8, False),
        ("config:.github/workflows/ci.yml", "module:a", "references", 0.8, False), ("config:.github/workflows/ci.yml", "module:b", "references", 0.8, False),
    }
    hit = graph.impact(edges.where("not unresolved").selectExpr("source AS src", "target AS dst", "confidence AS w"), spark.createDataFrame([("a.js:computeTax:1",)], "id string"))
    assert {"doc:README.md", "lib/util.ts:helper:1", "module:a"} <= {r.id for r in hit.collect()}


def test_builds_extract_only_what_changed(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, TREE)
    built = code.CodeGraph(spark, f"file://{tmp_path}/store")
    read = lambda: code.source_files(spark, f"file://{root}")
    state = lambda g: [sorted(map(tuple, df.collect()), key=str) for df in g[:2]]
    assert built.stale(read()).count() == 5
    first = built.build(read())
    want = state(first)
    again = built.build(read())
    assert (first[2], again[2]) == (5, 0) and state(again) == want and built.stale(read()).count() == 0
    (root / "a.js").write_text("export function computeTax(x){ return x }\nexport function newFn(){}\n")
    (root / "b.py").unlink()
    assert {tuple(r) for r in built.stale(read()).collect()} == {("a.js", "changed"), ("b.py", "gone")}
    changed = built.build(read())
    assert changed[2] == 1
    names = {r.name for r in changed[0].collect()}
    assert "newFn" in names and not names & {"Ledger", "load_config"}
    (root / "a.js").write_text(TREE["a.js"])
    write(root, {"b.py": TREE["b.py"]})
    back = built.build(read())
    assert back[2] == 0 and state(back) == want
