"""From unified diffs to typed entities, kinds of change and their signals: what a change touches and what it removes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import change_scale, clamp01
from ..sources.lines import lines
from . import merge

# What a change of each kind signals in (runtime, contract, verification, docs, config, delivery, merge).
DIMENSIONS = ("runtime", "contract", "verification", "docs", "config", "delivery", "merge")
PROFILES = {
    "formatting": (0.005, 0.005, 0.03, 0.01, 0.005, 0.02, 0.02),
    "comment": (0.005, 0.01, 0.02, 0.08, 0.005, 0.01, 0.01),
    "docs": (0, 0, 0.08, 0.82, 0, 0.08, 0.03),
    "test": (0, 0, 0.82, 0, 0, 0.08, 0.04),
    "logic": (0.68, 0.28, 0.72, 0.12, 0.1, 0.18, 0.12),
    "public_api": (0.78, 0.96, 0.88, 0.78, 0.18, 0.28, 0.18),
    "config": (0.42, 0.38, 0.52, 0.28, 0.92, 0.68, 0.18),
    "schema": (0.78, 0.94, 0.86, 0.62, 0.76, 0.7, 0.2),
    "dependency": (0.72, 0.62, 0.68, 0.34, 0.78, 0.84, 0.16),
    "generated": (0.3, 0.32, 0.28, 0.78, 0.4, 0.52, 0.08),
    "ci": (0.16, 0.12, 0.58, 0.12, 0.64, 0.94, 0.12),
    "security": (0.76, 0.72, 0.94, 0.42, 0.64, 0.72, 0.2),
}
# What security words, and mostly deleted lines, signal at least.
SECURITY = {"runtime": 0.82, "contract": 0.72, "verification": 0.96, "delivery": 0.62}
DELETING = {"contract": 0.68, "verification": 0.78, "merge": 0.22}
# Paths and words by which files and changes are classed.
TEST = r"(?i)(^|/)(?:test|tests|spec|specs)(/|$)|(?:^|\.)test\.[^.]+$|(?:^|\.)spec\.[^.]+$"
DOCUMENT = r"(?i)\.(md|mdx|rst|adoc)$"
CONFIG = r"(?i)\.(json|ya?ml|toml|ini|cfg)$"
WORKFLOW = r"(?i)(^|/)\.github/workflows/|(?:^|/)(?:Jenkinsfile|Dockerfile)$"
MANIFEST = r"(?i)(^|/)(?:package(?:-lock)?\.json|pnpm-lock\.yaml|yarn\.lock|Cargo\.(toml|lock)|requirements(?:-[^/]+)?\.txt|pyproject\.toml|poetry\.lock|go\.(mod|sum)|pom\.xml|build\.gradle(?:\.kts)?|Gemfile(?:\.lock)?|composer\.(json|lock))$"
SCHEMA = r"(?i)(?:^|/)(?:schemas?|migrations?|openapi|swagger)(?:/|\.|$)"
GENERATED = r"(?i)(?:^|/)(?:generated|dist|build|coverage)(?:/|$)|\.generated\."
PUBLIC_TEXT = r"\b(?:export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)|module\.exports|exports\.[A-Za-z_$]|pub\s+(?:fn|struct|enum|trait|mod|const|static|type)|public\s+(?:class|interface|record|enum)|__all__\s*=|@(?:Get|Post|Put|Patch|Delete|RequestMapping)\b)"
SCHEMA_TEXT = r"""(?i)\b(?:schema|openapi|swagger|migration|CREATE\s+TABLE|ALTER\s+TABLE|required\s*:|properties\s*:|type\s*:\s*["']?(?:object|array|string|number|integer|boolean))\b"""
SECURITY_TEXT = r"(?i)\b(?:auth(?:entication|orization)?|permission|role|scope|token|secret|password|credential|session|cookie|csrf|cors|crypto|encrypt|decrypt|sign(?:ature)?|verify|acl|rbac|oauth|jwt)\b"
DEPENDENCY_TEXT = r"""(?i)["']?(?:dependencies|devDependencies|peerDependencies|optionalDependencies)["']?\s*:|\b(?:version|image)\s*:"""
# Entities as (type, weight, whether they count in code spans only, files that define them, pattern of a name).
ENTITIES = [
    ("flag", 0.8, False, r"(^|/)(cli|commands)\.[jt]s$", r"(--[a-z][\w-]*)"),
    ("env", 0.9, False, r"\.(js|ts|mjs|cjs|sh)$", r"process\.env\.([A-Z_][A-Z0-9_]*)"),
    ("tool", 0.9, False, r"tools\.[jt]s$", r"""(?i)name:\s*["']([a-z][a-z0-9_]+)["']"""),
    ("symbol", 0.6, True, r"\.(js|ts|mjs|cjs|jsx|tsx)$", r"export\s+(?:async\s+)?(?:function|const|let|class)\s+([A-Za-z_$][\w$]*)"),
    ("version", 0.75, False, r"(^|/)package\.json$", r'"version":\s*"([^"]+)"'),
]


def hunk_lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, file, op, old_line, new_line, text`` of every line inside a hunk: op is + - or a space, a line has no number on the side where it is not.

    The file is the new name, or the old one where the new one is /dev/null.  Lines before a file's first hunk are its head; inside
    hunks lines of +++ or --- are content, for as many lines as the hunk's head announces.
    """
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    at = lines(diffs, key, text)
    head = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    n = lambda i: F.when(F.regexp_extract("text", head, i) == "", 1).otherwise(F.regexp_extract("text", head, i).try_cast("int"))
    at = at.withColumn("head", F.when(F.col("text").rlike(head), F.struct(n(1).alias("old"), n(2).alias("olds"), n(3).alias("new"), n(4).alias("news"), F.col("line").alias("at"))))
    at = at.withColumn("h", F.last("head", True).over(w))
    inside = Window.partitionBy(key, "h.at").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.substring("text", 1, 1)
    old, new = ((mark.isin(*s)).cast("int") for s in (("-", " ", ""), ("+", " ", "")))
    body = F.col("head").isNull() & F.col("h").isNotNull() & ~F.col("text").startswith("\\")
    at = at.withColumns({"body": body, "o": F.sum(F.when(body, old)).over(inside), "n": F.sum(F.when(body, new)).over(inside)})
    # a hunk's lines are those that its counts have room for
    body = F.col("body") & mark.isin("+", "-", " ", "") & (F.col("o") <= F.col("h.olds")) & (F.col("n") <= F.col("h.news"))
    at = at.withColumn("body", body)
    name = F.when(~F.col("body") & F.col("text").rlike(r"^(\+\+\+|---) "), F.regexp_replace(F.regexp_replace("text", r"^(\+\+\+|---) ([ab]/)?", ""), r"\t.*$", ""))
    at = at.withColumn("file", F.last(F.when(name != "/dev/null", name), True).over(w))
    op = F.when(mark == "", " ").otherwise(mark)
    return at.where("body").select(
        key, "file", op.alias("op"), F.when(mark != "+", F.col("h.old") + F.col("o") - 1).alias("old_line"), F.when(mark != "-", F.col("h.new") + F.col("n") - 1).alias("new_line"), F.expr("substr(text, 2)").alias("text"),
    )


def artifact_kind(path: Column) -> Column:
    p = F.regexp_replace(path, r"\\", "/")
    return F.when(p.rlike(TEST), "test").when(p.rlike(DOCUMENT), "documentation").when(p.rlike(WORKFLOW), "workflow").when(p.rlike(MANIFEST), "manifest").when(p.rlike(SCHEMA), "schema").when(p.rlike(CONFIG), "config").otherwise("source")


def changed_files(hunks: DataFrame, key: str) -> DataFrame:
    """``key, artifact, kind, confidence, lines, signal``: the kind of change of each file, and what its profile, size and words signal in each dimension."""
    ordered = lambda op: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("op") == op, F.struct(F.coalesce("new_line", "old_line").alias("at"), "text")))), lambda x: x["text"]), "\n")
    f = hunks.where("op <> ' '").groupBy(key, F.col("file").alias("artifact")).agg(ordered("+").alias("added"), ordered("-").alias("removed"), F.count("*").alias("lines"), F.count_if(F.col("op") == "-").alias("gone"), F.count_if(F.col("op") == "+").alias("come"))
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r",([)\]}])", "$1")
    p, text = F.col("artifact"), F.concat_ws("\n", "added", "removed")
    kinds = [
        ((F.col("gone") > 0) & (F.col("come") > 0) & (bare(F.col("added")) == bare(F.col("removed"))) & (bare(F.col("added")) != ""), "formatting", 0.98),
        (p.rlike(TEST), "test", 0.98), (p.rlike(DOCUMENT), "docs", 0.99), (p.rlike(WORKFLOW), "ci", 0.98), (p.rlike(MANIFEST), "dependency", 0.97), (text.rlike(DEPENDENCY_TEXT), "dependency", 0.82),
        (p.rlike(SCHEMA), "schema", 0.94), (text.rlike(SCHEMA_TEXT), "schema", 0.76), (text.rlike(PUBLIC_TEXT), "public_api", 0.86), (p.rlike(CONFIG), "config", 0.9), (p.rlike(GENERATED), "generated", 0.88),
    ]
    said = F.struct(F.lit("logic").alias("kind"), F.lit(0.62).alias("confidence"))
    for holds, kind, sure in reversed(kinds):
        said = F.when(holds, F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))).otherwise(said)
    f = f.withColumns({"said": said, "grave": text.rlike(SECURITY_TEXT)}).withColumn("deleting", (F.col("gone") / F.greatest(F.col("lines"), F.lit(1)) > 0.65) & ~F.col("said.kind").isin("formatting", "docs", "test"))
    table = F.create_map(*[x for k, v in PROFILES.items() for x in (F.lit(k), F.array(*[F.lit(float(y)) for y in v]))])
    own = table[F.col("said.kind")]
    signal = []
    for i, d in enumerate(DIMENSIONS):
        forced = F.greatest(F.when(F.col("grave"), SECURITY.get(d)) if d in SECURITY else F.lit(None), F.when(F.col("deleting"), DELETING.get(d)) if d in DELETING else F.lit(None))
        signal += [F.lit(d), F.coalesce(forced, clamp01(own[i] * change_scale(F.col("lines"))))]
    sure = F.when(F.col("grave"), F.greatest(F.col("said.confidence"), F.lit(0.78))).otherwise(F.col("said.confidence"))
    return f.select(key, "artifact", "said.kind", sure.alias("confidence"), "lines", F.create_map(*signal).alias("signal"))


def relations_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst, kind, confidence`` between files, the way consequences go, from a code graph's nodes and resolved edges (source depends on target)."""
    of = nodes.select("id", "file").distinct()
    e = edges.where("not unresolved and kind <> 'contains'").join(of.select(F.col("id").alias("source"), F.col("file").alias("dst")), "source").join(of.select(F.col("id").alias("target"), F.col("file").alias("src")), "target").where("src <> dst")
    # a file's kind takes many patterns, so it is found once for each file and not for each edge
    e = e.groupBy("src", "dst", "kind").agg(F.max(clamp01(F.coalesce("confidence", F.lit(0.7)))).alias("confidence"))
    kind = F.col("artifact")
    typed = F.when(kind == "test", "verified_by").when(kind == "documentation", "documented_by").when(kind == "workflow", "workflow_uses").when(kind.isin("config", "manifest", "schema"), "configures").when(F.col("kind").isin("calls", "imports", "inherits"), F.col("kind"))
    files = of.select(F.col("file").alias("dst")).distinct().withColumn("artifact", artifact_kind(F.col("dst")))
    return e.join(files, "dst").withColumn("kind", typed).where("kind is not null").groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"))


def diff_impact(hunks: DataFrame, key: str, nodes: DataFrame, edges: DataFrame, criticality: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(changed files, impacted artifacts) of the diffs taken together: changes to signals, the code graph to typed relations, both to the field."""
    changes = changed_files(hunks, key)
    signals = changes.select(F.col("artifact").alias("seed"), F.explode("signal").alias("dim", "v")).groupBy("seed", "dim").agg(F.max("v").alias("v"))
    found = merge.field(signals, relations_of(nodes, edges))
    known = nodes.select(F.col("file").alias("artifact")).union(changes.select("artifact")).distinct().withColumn("kind", artifact_kind(F.col("artifact")))
    if criticality is None:
        known = known.withColumn("criticality", F.lit(0.0))
    else:
        known = known.join(criticality.select("artifact", "criticality"), "artifact", "left")
    return changes, merge.impacted(found, known)


def _defined(text: Column, file: str = "file") -> Column:
    """The entities that a text of a file defines, as structs of type, name, weight and whether they count in code spans only."""

    def of(kind: str, weight: float, code_only: bool):
        return lambda n: F.struct(F.lit(kind).alias("type"), n.alias("name"), F.lit(weight).alias("weight"), F.lit(code_only).alias("code_only"))

    found = [F.when(F.col(file).rlike(source), F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), of(kind, weight, code_only))) for kind, weight, code_only, source, p in ENTITIES]
    return F.filter(F.flatten(F.array_compact(F.array(*found))), lambda e: F.length(e["name"]) >= 2)


def entities(files: DataFrame) -> DataFrame:
    """``type, name, weight, code_only``: the entities that files (``file, text``) define, each once."""
    return files.select(F.explode(_defined(F.coalesce("text", F.lit("")))).alias("e")).select("e.*").distinct()


def changed_entities(hunks: DataFrame, key: str, current: DataFrame) -> DataFrame:
    """``key, type, name, removed``: current entities named on a changed line of a file that can define them, and names that such lines define but nothing does any more.

    Names meet words of the lines by equality: plain words, words with dots or dashes inside, and words that two dashes begin.
    """
    h = hunks.where("op <> ' '").select(key, "file", "text")
    kinds = F.array_compact(F.array(*[F.when(F.col("file").rlike(source), F.lit(kind)) for kind, _, _, source, _ in ENTITIES]))
    shapes = (r"(?<![\w$-])([\w$]+)(?![\w$])", r"(?<![\w$-])(--[\w-]+)(?![\w$])", r"(?<![\w$-])([\w$]+(?:[.-][\w$]+)+)(?![\w$])")
    words = F.array_distinct(F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in shapes]))
    said = h.select(key, "text", F.explode(kinds).alias("type")).select(key, "type", F.explode(words).alias("name")).distinct()
    known = current.select("type", "name").distinct()
    defined = h.select(key, F.explode(_defined(F.col("text"))).alias("e")).select(key, "e.type", "e.name").distinct()
    modified = said.join(known, ["type", "name"], "left_semi").select(key, "type", "name", F.lit(False).alias("removed"))
    gone = defined.join(known, ["type", "name"], "left_anti").select(key, "type", "name", F.lit(True).alias("removed"))
    return modified.union(gone)
