"""Source trees as a code graph: files, their definitions and relations, extracted once for each content.

Files are read whole and cut into lines; patterns apply line by line, so a statement that is broken over lines counts
where its key word and name stand on one.  What is extracted of a file depends on its content and path alone and is stored under
both, so a build extracts only files that the store does not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Definitions of each language as (extensions, kind, pattern of the name).
RULES = [
    (("js", "jsx", "ts", "tsx", "mjs", "cjs"), "function", r"(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)"),
    (("js", "jsx", "ts", "tsx", "mjs", "cjs"), "class", r"(?:export\s+)?class\s+([A-Za-z_$][\w$]*)"),
    (("js", "jsx", "ts", "tsx", "mjs", "cjs"), "const", r"(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*="),
    (("py",), "function", r"^\s*def\s+([A-Za-z_]\w*)"),
    (("py",), "class", r"^\s*class\s+([A-Za-z_]\w*)"),
    (("go",), "function", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"),
    (("go",), "type", r"^type\s+([A-Za-z_]\w*)"),
    (("rs",), "function", r"\bfn\s+([A-Za-z_]\w*)"),
    (("rs",), "type", r"\b(?:struct|enum|trait)\s+([A-Za-z_]\w*)"),
    (("java",), "type", r"\b(?:class|interface|enum|record)\s+([A-Za-z_]\w*)"),
    (("rb",), "function", r"^\s*def\s+([A-Za-z_]\w*[!?=]?)"),
    (("rb",), "class", r"^\s*(?:class|module)\s+([A-Z]\w*)"),
]
# How sure each relation is, what a match by name alone costs, and called words that name nothing of a project.
CONFIDENCE = {"contains": 1.0, "inherits": 0.9, "imports": 0.85, "references": 0.8, "calls": 0.75, "names": 0.6}
BY_NAME = 0.9
BUILTINS = "if for while switch catch function return console String Number Boolean Array Object Promise Set Map Date Error RegExp parseInt parseFloat setTimeout clearTimeout fetch print len range int str float dict list set super".split()
# Files that are documents or configuration, those of them that are left out, and folders that are not read.
DOCS = r"(?i)\.md$"
CONFIGS = r"\.(json|ya?ml|toml)$|(^|/)Dockerfile$|\.config\.[\w.]+$"
LEFT_OUT = r"(?i)(^|/)((agents|claude|gemini|changelog)\.md|package-lock\.json|[^/]*[-.]lock(\.\w+)?|[^/]*\.cache\.json)$"
FOLDERS = r"(^|/)(node_modules|dist|build|coverage|vendor|target|__pycache__)/|(^|/)\.(?!github/)[^/]*(/|$)"

#: Folders that file listings leave out by their name, and that are read all the same.
HIDDEN = (".github",)
CODE = r"\.(" + "|".join(sorted({e for es, _, _ in RULES for e in es})) + ")$"
FACT = "file string, digest string, part string, id string, qname string, name string, kind string, line long, target string, confidence double"


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """``file, text, digest`` of every code, document and configuration file below ``root``; ``file`` is relative to it.  Empty files are not listed."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    there = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = there.makeQualified(base).toString().rstrip("/")
    hidden = [f"{base}/{h}" for h in HIDDEN if there.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{h}"))]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([base, *hidden])
    f = raw.select(F.expr(f"substr(path, {len(base) + 2})").alias("file"), "content").where(eligible(F.col("file")))
    return f.select("file", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("digest"))


def eligible(file: Column) -> Column:
    return (file.rlike(CODE) | file.rlike(DOCS) | file.rlike(CONFIGS)) & ~file.rlike(LEFT_OUT) & ~file.rlike(FOLDERS)


def module_id(file: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(file, r"\.[^./\\]+$", ""), r"[/\\]", ".")


def _all(text: str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def extracted(files: DataFrame) -> DataFrame:
    """Facts (``FACT``) of ``file, text, digest``: part ``node`` with id, qname, name, kind, line, and part ``edge`` from id to target.

    A file is one node; targets are names as written.  Null texts are empty.
    """
    f = files.withColumn("class", F.when(F.col("file").rlike(DOCS), "doc").when(F.col("file").rlike(CONFIGS), "config").otherwise("module"))
    f = f.withColumns({"module": module_id(F.col("file")), "own": F.concat("class", F.lit(":"), F.when(F.col("class") == "module", module_id(F.col("file"))).otherwise(F.col("file")))})
    top = f.select("file", "digest", F.lit("node").alias("part"), F.col("own").alias("id"), F.lit(None).cast("string").alias("qname"), F.when(F.col("class") == "module", F.col("module")).otherwise(F.col("file")).alias("name"), F.col("class").alias("kind"), F.lit(1).cast("long").alias("line"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("double").alias("confidence"))
    ext = F.regexp_extract("file", r"\.([^./\\]+)$", 1)
    lines = lambda f: f.select("file", "digest", "module", "own", ext.alias("ext"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text")).withColumn("line", (F.col("line") + 1).cast("long"))
    # whole files are dealt, in a number that does not hang on their bytes; their lines then stay where they are
    parts = max(int(f.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * f.sparkSession.sparkContext.defaultParallelism)
    out = top.union(_of_code(lines(f.where("class = 'module'").repartition(parts, "file", "digest"))))

    def refers(df: DataFrame, target: Column, sure: str = "references") -> DataFrame:
        return df.select("file", "digest", F.col("own").alias("id"), "line", F.explode(target).alias("target"), F.lit(CONFIDENCE[sure]).alias("confidence")).where("target <> ''")

    doc, conf = lines(f.where("class = 'doc'")), lines(f.where("class = 'config'"))
    ticks = F.flatten(F.transform(_all("text", "`([^`\n]+)`"), lambda s: F.transform(F.split(F.trim(s), r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, r"[(),;:]+$", ""), r"^\./", ""))))
    path = lambda w: F.contains(F.translate(w, "\\", "/"), F.lit("/")) & w.rlike(CODE)
    to_module = lambda w: F.concat(F.lit("module:"), module_id(F.regexp_replace(w, r"^\./", "")))
    linked = F.filter(_all("text", r"\]\(([^)#\s]+)\)"), lambda w: ~w.rlike("(?i)^[a-z]+:") & w.rlike(CODE))
    named = F.filter(ticks, lambda w: w.rlike(r"^[A-Za-z_$][\w$]*$") & (F.length(w) >= 3) & ~w.isin(*BUILTINS))
    written = F.transform(F.filter(_all("text", r"[A-Za-z0-9_.@-]+(?:[/\\][A-Za-z0-9_.@-]+)*", 0), lambda w: F.regexp_replace(w, r"^\./", "").rlike(CODE)), to_module)
    refs = refers(doc, F.concat(F.transform(F.filter(ticks, path), to_module), F.transform(linked, to_module))).union(refers(doc, named, "names")).union(refers(conf, written))
    # a document or configuration refers to a target once, at its first line
    once = refs.groupBy("file", "digest", "id", "target").agg(F.min_by("confidence", F.struct("line", -F.col("confidence"))).alias("confidence"), F.min("line").alias("line"))
    null = F.lit(None).cast("string")
    names = [x.split()[0] for x in FACT.split(", ")]
    return out.union(once.select("file", "digest", F.lit("edge").alias("part"), "id", null.alias("qname"), null.alias("name"), F.lit("references").alias("kind"), "line", "target", "confidence").select(*names))


def _of_code(lines: DataFrame) -> DataFrame:
    """Facts of the lines of code (``file, digest, module, own, ext, line, text``), all read in one pass and each once for a line.

    Names are taken from the text first, so that what is put in order to find the definition above a line is names alone.
    """
    named_as = lambda kind: lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind"))
    of_ext: dict = {}
    for es, kind, p in RULES:
        of_ext.setdefault(es, []).append(F.transform(_all("text", p), named_as(kind)))
    defs = F.array().cast("array<struct<name:string,kind:string>>")
    for es, found in of_ext.items():
        defs = F.when(F.col("ext").isin(*es), F.flatten(F.array(*found))).otherwise(defs)
    refer = lambda kind, by=None: lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target"), (F.lit(None) if by is None else by).cast("string").alias("by"))
    bases = lambda c: F.filter(F.transform(F.filter(F.transform(F.split(c, ","), lambda b: F.trim(b)), lambda b: (b != "") & ~F.contains(b, F.lit("="))), lambda b: F.element_at(F.split(b, r"\."), -1)), lambda b: F.lower(b) != "object")
    text = F.col("text")
    child = F.regexp_extract("text", r"\bclass\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+[A-Za-z_$]|\s*\()", 1)
    base = F.concat(F.regexp_extract("text", r"\bclass\s+[A-Za-z_$][\w$]*\s+extends\s+([A-Za-z_$][\w$.]*)", 1), F.regexp_extract("text", r"^\s*class\s+[A-Za-z_]\w*\s*\(([^)]*)\)", 1))
    inherits = F.transform(F.filter(bases(base), lambda b: (b != child) & (child != "")), refer("inherits", child))
    frm = F.regexp_extract("text", r"^\s*from\s+([\w.]+)\s+import\b", 1)
    plain = F.flatten(F.array(_all("text", r"""\bimport\s+(?:[^"']+\s+from\s+)?["']([^"']+)["']"""), _all("text", r"""\brequire\(["']([^"']+)["']\)"""), F.array(frm)))
    listed = F.split(F.regexp_extract("text", r"^\s*(?:from\s+[\w.]+\s+)?import\s+([\w*,\s]+)$", 1), ",")
    listed = F.transform(F.filter(F.transform(listed, lambda n: F.trim(n)), lambda n: (n != "") & (n != "*")), lambda n: F.when(frm != "", F.concat(frm, F.lit("."), n)).otherwise(n))
    calls = F.filter(_all("text", r"(?:^|[^.\w$])([A-Za-z_$][\w$]*)\s*\("), lambda n: ~n.isin(*BUILTINS))
    none = F.array().cast("array<struct<kind:string,target:string,by:string>>")
    # each kind has a word or a sign without which its patterns find nothing
    refs = F.concat(
        F.when(F.contains(text, F.lit("class")), inherits).otherwise(none),
        F.when(F.contains(text, F.lit("import")) | F.contains(text, F.lit("require")), F.transform(F.concat(plain, listed), refer("imports"))).otherwise(none),
        F.when(F.contains(text, F.lit("(")), F.transform(calls, refer("calls"))).otherwise(none),
    )
    said = lines.select("file", "digest", "module", "own", "line", defs.alias("defs"), F.filter(refs, lambda r: r["target"] != "").alias("refs")).where("size(defs) > 0 or size(refs) > 0")
    # a line belongs to the last definition at or above it, of several on a line the last one
    last = F.last(F.when(F.size("defs") > 0, F.struct(F.element_at("defs", -1)["name"].alias("name"), F.col("line").alias("line"))), ignorenulls=True).over(Window.partitionBy("file", "digest").orderBy("line"))
    said = said.withColumn("in", last)
    at = lambda name: F.concat_ws(":", "file", name, F.col("line").cast("string"))
    above = F.when(F.col("in").isNull(), F.col("own")).otherwise(F.concat_ws(":", "file", "in.name", F.col("in.line").cast("string")))
    null = F.lit(None).cast("string")

    def fact(part: str, id_: Column, qname: Column, name: Column, kind: Column, target: Column, sure: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), id_.alias("id"), qname.alias("qname"), name.alias("name"), kind.alias("kind"), target.alias("target"), sure.cast("double").alias("confidence"))

    sure = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    facts = F.concat(
        F.transform("defs", lambda d: fact("node", at(d["name"]), F.concat_ws(".", "module", d["name"]), d["name"], d["kind"], null, F.lit(None))),
        F.transform("defs", lambda d: fact("edge", F.col("own"), null, null, F.lit("contains"), at(d["name"]), sure["contains"])),
        F.transform(
            F.filter("refs", lambda r: (r["kind"] != "calls") | (r["target"] != F.coalesce("in.name", "module"))),
            lambda r: fact("edge", F.when(r["kind"] == "inherits", at(r["by"])).otherwise(above), null, null, r["kind"], r["target"], sure[r["kind"]]),
        ),
    )
    rows = said.select("file", "digest", "line", F.explode(F.array_distinct(facts)).alias("f"))
    return rows.select("file", "digest", "f.part", "f.id", "f.qname", "f.name", "f.kind", "line", "f.target", "f.confidence")


def resolved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``source, target, kind, line, confidence, unresolved``: the target's node by id, else by qualified name, else by the last part of its name if one node alone has that."""
    e = edges.where("kind <> 'contains'")
    none = F.lit(None).cast("string")
    key = lambda c, at: nodes.where(f"{c} is not null").select(F.col(c).alias("key"), *((F.col("id") if i == at else none).alias(f"d{i}") for i in (1, 2, 3)))
    known = key("id", 1).union(key("qname", 2)).union(key("name", 3)).groupBy("key").agg(F.max("d1").alias("d1"), F.max("d2").alias("d2"), F.when(F.count("d3") == 1, F.min("d3")).alias("d3"))
    # each distinct target is looked up once, by itself and by the last part of its name
    short = F.element_at(F.split("target", r"\."), -1)
    wanted = e.select("target").distinct().withColumn("short", short).select("target", "short", F.explode(F.array_distinct(F.array("target", "short"))).alias("key"))
    if_key = lambda c, held: F.max(F.when(F.col("key") == F.col(held), F.col(c))).alias(c)
    to = wanted.join(known, "key").groupBy("target").agg(if_key("d1", "target"), if_key("d2", "target"), if_key("d3", "short"))
    e = e.join(to, "target", "left")
    found = F.coalesce("d1", "d2", "d3")
    named = F.col("d1").isNull() & F.col("d2").isNull() & F.col("d3").isNotNull()
    e = e.select(
        F.col("id").alias("source"), F.coalesce(found, "target").alias("target"), "kind", "line",
        F.when(named, F.col("confidence") * BY_NAME).otherwise(F.col("confidence")).alias("confidence"), found.isNull().alias("unresolved"),
    )
    # what a file contains is named by its id
    own = edges.where("kind = 'contains'").select(F.col("id").alias("source"), "target", "kind", "line", "confidence", F.lit(False).alias("unresolved"))
    return e.union(own)


class CodeGraph:
    """The graph of a tree, with a store of facts below ``store`` that is only ever added to."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store

    def _facts(self) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.store)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(FACT).parquet(self.store) if there else self.spark.createDataFrame([], FACT)

    def _tops(self) -> DataFrame:
        """The row of each stored file itself, one for each time that it was extracted."""
        return self._facts().where("part = 'node' and kind in ('module', 'doc', 'config')")

    def build(self, files: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """(nodes, edges, files extracted) of ``file, text, digest`` as they are now; facts of other contents stay stored but take no part."""
        now = files.select("file", "digest").distinct()
        missing = files.join(self._tops().select("file", "digest").distinct(), ["file", "digest"], "left_anti")
        rows, n = missing.groupBy("file", "digest").agg(F.count("*").alias("k")).agg(F.sum("k"), F.count("*")).first()
        if n:
            extracted(missing if rows == n else missing.dropDuplicates(["file", "digest"])).write.mode("append").parquet(self.store)
        facts = self._facts()
        # a build that was repeated may have added facts twice, and contents that are no more still stand in the store
        stored = self._tops().groupBy("file", "digest").agg(F.count("*").alias("k")).join(now.withColumn("now", F.lit(True)), ["file", "digest"], "left")
        if stored.where("k > 1 or now is null").limit(1).count():
            facts = facts.join(now, ["file", "digest"], "left_semi").distinct()
        nodes = facts.where("part = 'node'").select("id", "qname", "name", "kind", "file", "line")
        edges = facts.where("part = 'edge'").select("id", "target", "kind", "line", "confidence")
        return nodes, resolved(nodes, edges), n

    def stale(self, files: DataFrame) -> DataFrame:
        """``file, change``: what a build of ``files`` would find added, changed or gone since the facts that were stored last for each file."""
        known = self._facts().groupBy("file").agg(F.collect_set("digest").alias("had"))
        both = files.select("file", "digest").join(known, "file", "full_outer")
        change = F.when(F.col("had").isNull(), "added").when(F.col("digest").isNull(), "gone").when(~F.array_contains("had", F.col("digest")), "changed")
        return both.select("file", change.alias("change")).where("change is not null")
