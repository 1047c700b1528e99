"""What a project's code graph, documents and manifests say about a task, a change or a dependency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.rounds import Rounds, forget
from . import graph, metrics
from .gates import path_class, slug

# Changed files that a lens looks at, dependents that make its full strength, ranges of local dependencies.
LENS_FILES, LENS_FULL = 10, 5
LOCAL = r"^(workspace:|file:|link:|git\+|git:|https?:|github:|[./])"
#: Rings from the gravest on.
RINGS = ("hold", "assess", "trial", "adopt")


def nodes_named(nodes: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """``*by, id``: nodes whose id, name, qualified name or file is the target, or whose file ends in it after a slash.

    ``nodes``: ``id, name, qname, file``; ``targets``: ``*by, target``.  A file meets targets by its own endings, so names meet by equality.
    """
    parts = F.split("file", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    names = F.array_compact(F.concat(F.array("id", "name", "qname"), F.coalesce(ends, F.array().cast("array<string>"))))
    return targets.join(nodes.select("id", F.explode(F.array_distinct(names)).alias("target")), "target").select(*by, "id").distinct()


def _walked(nodes: DataFrame, edges: DataFrame, starts: DataFrame, by: list[str], hops: int) -> DataFrame:
    """``*by, file, strength`` of the files that depend on the starts.

    Nodes of a file that are starts of the same one value of ``by``, or of none, and that the same node depends on as surely, or none, lead to the same and are walked as one.
    Steps to such a node of the file that one comes from are left out if nothing depends on it: the file was found before, and not less surely.
    """
    kept = Rounds(nodes.sparkSession, "walked")
    starts = kept.keep(starts.select(*by, "id").where("id is not null"))
    e = edges.where("not unresolved and source is not null and target is not null").groupBy(F.col("target").alias("id"), F.col("source").alias("to")).agg(F.max("confidence").alias("w"))
    e = kept.keep(e.where("w is not null"))
    parts = nodes.select("id", "file", F.lit(True).alias("node")).where("id is not null")
    parts = parts.unionByName(e, allowMissingColumns=True).unionByName(starts.select("id", F.struct(*by).alias("start")), allowMissingColumns=True)
    one = lambda c: F.min(c).eqNullSafe(F.max(c))
    alike = (F.count("node") > 0) & one("file") & F.count("file").isin(0, F.count("node")) & one("start")
    n = parts.groupBy("id").agg(alike.alias("alike"), F.min("file").alias("file"), F.min("start").alias("start"), F.count("to").alias("ways"), F.min("to").alias("to"), F.min("w").alias("w"))
    own = F.struct(*[F.col("start")[c].cast("string").alias(f"s{i}") for i, c in enumerate(by)])
    kin = F.when(F.col("alike"), F.to_json(F.struct("file", F.when(F.col("start").isNotNull(), own).alias("start"))))
    n = n.withColumn("kin", kin).withColumn("like", F.when(F.col("alike") & (F.col("ways") <= 1), F.concat(F.lit("="), F.to_json(F.struct("kin", "to", "w")))).otherwise(F.concat(F.lit("."), "id")))
    n = kept.keep(n)
    # one dependent each, so the rows of a class are few; the edges of the other nodes stay as they are
    single = n.where("alike and ways = 1").select("like", "kin", "to", "w").distinct()
    steps = single.union(n.where("not (alike and ways <= 1) and ways > 0").select("id", "like", "kin").join(e, "id").select("like", "kin", "to", "w"))
    to = n.select(F.col("id").alias("to"), F.col("like").alias("src"), F.col("kin").alias("to_kin"), "ways")
    idle = F.coalesce((F.col("kin") == F.col("to_kin")) & (F.col("ways") == 0) & (F.col("w") <= 1), F.lit(False))
    steps = kept.keep(steps.join(to, "to").where(~idle).select("src", F.col("like").alias("dst"), "w").distinct())
    begin = n.where("alike and start is not null").select("start.*", "like").distinct()
    begin = begin.union(starts.join(n.where("not alike").select("id", "like"), "id").select(*by, "like"))
    files = n.where("alike").select("like", "file").distinct()
    files = kept.keep(files.union(n.where("not alike").select("id", "like").join(nodes.select("id", "file").distinct(), "id").select("like", "file")))
    hit = graph.impact(steps, kept.keep(begin.withColumnRenamed("like", "id")), hops=hops, by=tuple(by))
    found = kept.result(hit.join(files, hit["id"] == files["like"]).groupBy(*by, "file").agg(F.max("strength").alias("strength")))
    forget(hit)
    return found


def imagined(nodes: DataFrame, edges: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What tasks (``task, target``: the symbols and files each names) would break.

    First ``task, file, confidence``: the best over all of the task's targets, each walked by itself, and once for all tasks that name it; then ``task, found, risk``, the sum of the first.
    """
    named = tasks.where("target is not null").select("task", "target").distinct()
    starts = Rounds(nodes.sparkSession, "named").result(nodes_named(nodes, named.select("target").distinct(), ["target"]))
    breaks = _walked(nodes, edges, starts, ["target"], 6).join(named, "target").groupBy("task", "file").agg(F.max("strength").alias("confidence"))
    found = named.join(starts.select("target").distinct(), "target").select("task").distinct().withColumn("found", F.lit(True))
    risk = tasks.select("task").distinct().join(found, "task", "left").join(breaks.groupBy("task").agg(F.sum("confidence").alias("risk")), "task", "left")
    return breaks, risk.select("task", F.coalesce("found", F.lit(False)).alias("found"), F.round(F.coalesce("risk", F.lit(0.0)), 4).alias("risk"))


def impact_lens(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``change, n, s``: code files within two steps of a change's first ten code files (``change, file``) that it leaves untouched, and the lens's strength."""
    code = changed.select("change", "file").distinct().where(path_class(F.col("file")) == "code")
    code = code.withColumn("_n", F.row_number().over(Window.partitionBy("change").orderBy("file"))).where(F.col("_n") <= LENS_FILES).drop("_n")
    starts = code.join(nodes.select("file", "id"), "file").select("change", "id")
    hit = _walked(nodes, edges, starts, ["change"], 2).where(path_class(F.col("file")) == "code").join(changed.select("change", "file"), ["change", "file"], "left_anti")
    n = hit.groupBy("change").agg(F.count("*").alias("n"))
    return changed.select("change").distinct().join(n, "change", "left").select("change", F.coalesce("n", F.lit(0)).alias("n"), F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / LENS_FULL).alias("s"))


def impact_eval(nodes: DataFrame, edges: DataFrame, cases: DataFrame, expected: DataFrame) -> DataFrame:
    """``case, precision, recall, f1, baseline``: files found for each case's target against the expected ones, and the recall of knowing only the edited file.

    ``cases``: ``case, target, edited``; ``expected``: ``case, file``.
    """
    found = _walked(nodes, edges, nodes_named(nodes, cases.select("case", "target"), ["case"]), ["case"], 6)
    pr = metrics.precision_recall(found.select("case", "file"), expected.select("case", "file"), "case", "file")
    hit = expected.select("case", "file").distinct().join(cases.select("case", "edited"), "case").groupBy("case").agg((F.count_if(F.col("file") == F.col("edited")) / F.count("*")).alias("baseline"))
    none = F.lit(1.0)  # nothing found and nothing expected
    out = cases.select("case").distinct().join(pr, "case", "left").join(hit, "case", "left")
    return out.select("case", *(F.coalesce(c, none).alias(c) for c in ("precision", "recall", "f1")), F.coalesce("baseline", none).alias("baseline"))


def unresolved_links(docs: DataFrame) -> DataFrame:
    """``file, href, target, anchor``: links of markdown documents (``file, text``) to a heading that the document they point to does not have.

    Fenced code is left out on both sides.  Links elsewhere, without an anchor, to other kinds of file or to documents that are not there are not judged.
    """
    prose = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)```.*?```", "")
    d = docs.where(F.lower("file").endswith(".md")).select("file", prose.alias("prose"))
    raw = F.transform(F.split("prose", "\n"), lambda x: F.regexp_extract(x, r"^#{1,6}\s+(.*?)\s*#*\s*$", 1))
    heads = d.select("file", F.explode_outer(F.filter(raw, lambda h: h != "")).alias("h")).select(F.col("file").alias("target"), slug(F.col("h")).alias("anchor")).distinct()
    href = F.transform(F.regexp_extract_all("prose", F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), lambda h: F.trim(h))
    l = d.select("file", F.explode(F.array_distinct(href)).alias("href")).where(~F.col("href").rlike("(?i)^https?:") & F.contains("href", F.lit("#")))
    l = l.withColumns({"path": F.substring_index("href", "#", 1), "anchor": F.lower(F.expr("substr(href, instr(href, '#') + 1)"))}).where("anchor <> ''")
    l = l.where((F.col("path") == "") | F.col("path").endswith(".md")).withColumn("target", F.when(F.col("path") == "", F.col("file")).otherwise(_beside(F.col("file"), F.col("path"))))
    there = docs.select(F.col("file").alias("target")).distinct()
    return l.join(there, "target", "left_semi").join(heads.where("anchor is not null"), ["target", "anchor"], "left_anti").select("file", "href", "target", "anchor")


def _beside(file: Column, path: Column) -> Column:
    """A relative path as seen from a file's folder, without . and .. parts."""
    parts = F.filter(F.split(F.concat(F.regexp_replace(file, r"[^/]*$", ""), path), "/"), lambda p: ~p.isin("", "."))
    start = F.array().cast("array<string>")
    kept = F.aggregate(parts, start, lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(kept, "/")


def manifest_deps(manifests: DataFrame) -> DataFrame:
    """``project, name, range, source, installed, local`` of every dependency that package manifests declare.

    ``manifests``: ``project, manifest, lock``, JSON texts; what does not parse declares nothing.  A production dependency comes before a development one of the same
    name.  The installed version stands in a lock file's packages, or in the dependencies of an older one.
    """
    text_map = "map<string,string>"
    m = manifests.select("project", F.try_parse_json("manifest").alias("m"), F.try_parse_json("lock").alias("k"))
    got = lambda v, path, kind: F.try_variant_get(v, path, kind)
    m = m.select("project", got("m", "$.dependencies", text_map).alias("dependencies"), got("m", "$.devDependencies", text_map).alias("devDependencies"), got("k", "$.packages", "map<string,variant>").alias("new"), got("k", "$.dependencies", "map<string,variant>").alias("old"))
    rows = [m.select("project", F.lit(i).alias("_rank"), F.lit(s).alias("source"), F.explode(s).alias("name", "range"), "new", "old") for i, s in enumerate(("dependencies", "devDependencies"))]
    version = lambda where, key: F.nullif(F.try_variant_get(F.try_element_at(F.col(where), key), "$.version", "string"), F.lit(""))
    d = rows[0].union(rows[1]).withColumn("installed", F.coalesce(version("new", F.concat(F.lit("node_modules/"), "name")), version("old", F.col("name")))).withColumn("range", F.coalesce("range", F.lit("")))
    first = d.withColumn("_n", F.row_number().over(Window.partitionBy("project", "name").orderBy("_rank"))).where("_n = 1")
    return first.select("project", "name", "range", "source", "installed", F.col("range").rlike(LOCAL).alias("local"))


def ring_counts(deps: DataFrame, by: list[str]) -> DataFrame:
    """``*by, ring, n`` from the gravest ring on (``place``); local dependencies (``local``) were not looked up and count as assess."""
    ring = F.when(F.col("local"), "assess").otherwise(F.col("ring"))
    return deps.groupBy(*by, ring.alias("ring")).agg(F.count("*").alias("n")).withColumn("place", F.array_position(F.array(*map(F.lit, RINGS)), F.col("ring")).cast("int"))


def package_of(spec: Column) -> Column:
    """The package that an import names: its first part, or two of a scoped one; null for relative, absolute and built-in ones."""
    bare = F.when(spec.startswith("@"), F.substring_index(spec, "/", 2)).otherwise(F.substring_index(spec, "/", 1))
    return F.when((spec != "") & ~spec.rlike(r"^([./]|node:)"), bare)


def risky_importers(imports: DataFrame, deps: DataFrame) -> DataFrame:
    """``file, name, ring``: files (``file, target``) that import a dependency on hold, or one to assess that has an open advisory (``name, ring, advisory``)."""
    risky = deps.where((F.col("ring") == "hold") | ((F.col("ring") == "assess") & F.coalesce("advisory", F.lit(False)))).select("name", "ring")
    return imports.select("file", package_of(F.col("target")).alias("name")).where("name is not null").distinct().join(risky, "name").select("file", "name", "ring")


# What a relation of each kind carries back to what depends on it, and what an unknown kind carries.
EDGE_WEIGHT = {"calls": 0.95, "imports": 0.85, "inherits": 0.92, "references": 0.7, "contains": 0.45}
OTHER_WEIGHT = 0.5


def cycle_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``file, cycle``: files that import or call one another in a circle, by the circle's largest name; the condensation that impact walks in one step."""
    of = nodes.select("id", "file").distinct()
    e = edges.where("not unresolved and kind <> 'contains'").join(of.select(F.col("id").alias("source"), F.col("file").alias("src")), "source").join(of.select(F.col("id").alias("target"), F.col("file").alias("dst")), "target")
    return graph.strong_components(e.select("src", "dst")).select(F.col("id").alias("file"), F.col("component").alias("cycle"))


def code_impact(nodes: DataFrame, edges: DataFrame, starts: DataFrame, hazards: DataFrame | None = None, cycles: DataFrame | None = None, by: tuple[str, ...] = (), decay: float = 0.85, threshold: float = 0.1, hops: int = 6) -> DataFrame:
    """``*by, id, strength, hops``: what depends on the starts (``*by, id``), by the best product of kind weights, confidences and decay along a path.

    In a file with a hazard score (``file, hazard``) the threshold is divided by 1 + hazard.  Reaching a file of a cycle (``file, cycle``) reaches all
    nodes of the cycle's other files as strongly, in the same step.  Starts are never entered.
    """
    kept = Rounds(nodes.sparkSession, "code-impact")
    none = lambda kind: nodes.sparkSession.createDataFrame([], kind)
    n = nodes.select("id", "file").dropDuplicates(["id"])
    n = n.join((none("file string, hazard double") if hazards is None else hazards).select("file", "hazard"), "file", "left").join((none("file string, cycle string") if cycles is None else cycles).select("file", "cycle"), "file", "left")
    n = kept.keep(n.select("id", "file", "cycle", (F.lit(threshold) / (1 + F.coalesce("hazard", F.lit(0.0)))).alias("least")))
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EDGE_WEIGHT.items() for x in kv]), F.col("kind")), F.lit(OTHER_WEIGHT))
    e = edges.where("not unresolved").select(F.col("target").alias("id"), F.col("source").alias("to"), (weight * F.coalesce("confidence", F.lit(1.0)) * decay).alias("w"))
    e = e.groupBy("id", "to").agg(F.max("w").alias("w")).join(n.select(F.col("id").alias("to"), "file", "cycle", "least"), "to", "left")
    e = kept.keep(e.withColumn("least", F.coalesce("least", F.lit(threshold))))
    key = [*by, "id"]
    best = kept.keep(starts.select(*key).distinct().select(*key, F.lit(1.0).alias("strength"), F.lit(0).alias("hops"), F.lit(True).alias("fresh")))
    for hop in range(1, hops + 1):
        step = best.where("fresh").join(e, "id").withColumn("offer", F.col("strength") * F.col("w")).where("offer >= least")
        step = step.join(best.where("hops = 0").select(*by, F.col("id").alias("to")), [*by, "to"], "left_anti")
        # of a cycle's files the two reached best: a file takes the best of the others
        reached = step.where("cycle is not null").groupBy(*by, "cycle", "file").agg(F.max("offer").alias("offer"))
        two = reached.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "cycle").orderBy(F.desc("offer"), "file"))).where("_n <= 2")
        top = two.groupBy(*by, "cycle").agg(F.max(F.when(F.col("_n") == 1, F.struct("offer", "file"))).alias("a"), F.max(F.when(F.col("_n") == 2, F.col("offer"))).alias("b"))
        spread = top.join(n.where("cycle is not null").select("id", "file", "cycle"), "cycle").select(*by, "id", F.when(F.col("file") != F.col("a.file"), F.col("a.offer")).otherwise(F.col("b")).alias("offer")).where("offer is not null")
        offers = step.select(*by, F.col("to").alias("id"), "offer").union(spread.select(*key, "offer")).groupBy(*key).agg(F.max("offer").alias("offer"))
        both = best.drop("fresh").join(offers, key, "full_outer")
        better = (F.coalesce("hops", F.lit(hop)) > 0) & F.coalesce(F.col("offer") > F.coalesce("strength", F.lit(0.0)), F.lit(False))
        new = both.select(*key, F.when(better, F.col("offer")).otherwise(F.col("strength")).alias("strength"), F.when(better, hop).otherwise(F.col("hops")).alias("hops"), better.alias("fresh"))
        new = kept.keep(new, fresh=F.count_if(F.col("fresh")))
        kept.drop(best)
        best = new
        if not kept.seen["fresh"]:
            break
    return kept.result(best.where("hops > 0").select(*key, "strength", "hops"))


#: A value that is assigned to a name of a secret; the secrets lens may block alone, so plain references do not count.
SECRET = r"""(?i)\b[\w.-]*(?:token|secret|password|passwd|api_?key)\b["']?\s*[:=]\s*["'][^"'\s]{12,}["']"""


def lens_rows(changes: DataFrame, files: DataFrame, added: DataFrame, tests: DataFrame, unknown: DataFrame, locks: DataFrame, dependents: DataFrame, secret: str = SECRET) -> DataFrame:
    """``change, lens, ran, s`` of the deterministic lenses, as ``gates.consensus`` takes them.

    ``changes``: ``change``; ``files``: ``change, file``; ``added``: ``change, text`` (added lines); ``tests``: ``change, ran, passed``; ``unknown``: ``change, name`` of symbols that nothing
    defines; ``locks``: ``change, drifted`` (no row: no lock); ``dependents``: ``change, n`` as ``impact_lens`` has it (no row: no graph).  A lens that did not run abstains.
    """
    cls = path_class(F.col("file"))
    drift = files.groupBy("change").agg(((F.count_if(cls == "code") > 0) & (F.count_if(cls == "docs") == 0)).alias("docsdrift"))
    leaks = added.groupBy("change").agg(F.bool_or(F.coalesce(F.col("text").rlike(secret), F.lit(False))).alias("secrets"))
    suite = tests.groupBy("change").agg(F.bool_or("ran").alias("t_ran"), F.bool_and(F.coalesce("passed", F.lit(False))).alias("t_passed"))
    odd = unknown.select("change", F.lit(True).alias("symbols")).distinct()
    lock = locks.groupBy("change").agg(F.bool_or("drifted").alias("speclock"))
    near = dependents.groupBy("change").agg(F.max("n").alias("n"))
    # one group for each change, where a chain of joins would sort every part again and again
    c = changes.select("change", F.lit(True).alias("own")).distinct()
    for part in (drift, leaks, suite, odd, lock, near):
        c = c.unionByName(part.where("change is not null"), allowMissingColumns=True)
    c = c.groupBy("change").agg(*[F.max(x).alias(x) for x in c.columns if x != "change"]).where("own")
    yes = lambda x: F.when(F.coalesce(x, F.lit(False)), 1.0).otherwise(0.0)
    row = lambda lens, ran, s: F.struct(F.lit(lens).alias("lens"), F.coalesce(ran, F.lit(False)).alias("ran"), F.when(F.coalesce(ran, F.lit(False)), s).otherwise(0.0).alias("s"))
    always = F.lit(True)
    rows = F.array(
        row("tests", F.col("t_ran"), yes(~F.col("t_passed"))), row("symbols", always, yes(F.col("symbols"))), row("impact", F.col("n").isNotNull(), F.least(F.lit(1.0), F.col("n") / LENS_FULL)),
        row("docsdrift", always, yes(F.col("docsdrift"))), row("secrets", always, yes(F.col("secrets"))), row("speclock", F.col("speclock").isNotNull(), yes(F.col("speclock"))),
    )
    return c.select("change", F.explode(rows).alias("r")).select("change", "r.*")
