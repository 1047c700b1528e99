"""Look-ups of nodes and prices, documents' references, digests of a tree, and small projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def found(nodes: DataFrame, term: str) -> DataFrame:
    """Nodes whose name, qualified name or file holds the term, whatever its case."""
    t = F.lit(term.lower())
    return nodes.where(F.contains(F.lower("name"), t) | F.contains(F.lower("qname"), t) | F.contains(F.lower("file"), t))


def targets(nodes: DataFrame, target: str) -> DataFrame:
    """Nodes that a target names: by id, name, qualified name, file, or the end of the file's path."""
    return nodes.where(F.lit(target).isin(F.col("id"), F.col("name"), F.col("qname"), F.col("file")) | F.endswith("file", F.lit("/" + target)))


def priced(rows: DataFrame, prices: DataFrame, by: str) -> DataFrame:
    """Rows with the price whose key, or else whose tier, they name; ``prices``: ``key, tier, price``."""
    keys = prices.select(F.col("key").alias(by), F.col("price").alias("_k"))
    tiers = prices.groupBy(F.col("tier").alias(by)).agg(F.min_by("price", "key").alias("_t"))
    return rows.join(keys, by, "left").join(tiers, by, "left").withColumn("price", F.coalesce("_k", "_t")).drop("_k", "_t")


def slug(name: Column, size: int = 60) -> Column:
    dashed = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, size)


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def envelope(repo: Column, text: Column, vote: Column, strong: Column, lower_by: float = 0.2, floor: float = 0.4) -> Column:
    """The larger of two scores; a vote raises it freely, lowers it by at most ``lower_by``, and not below the floor where the topic is strong."""
    base = F.greatest(repo, text)
    lowest = F.greatest(base - lower_by, F.when(strong, F.least(base, F.lit(floor))).otherwise(0.0))
    return F.when(vote.isNull(), base).when(vote >= base, vote).otherwise(F.greatest(vote, lowest))


def interface(text: Column) -> Column:
    """``exports, imports``: distinct exported names, and names imported in braces without their aliases."""
    exports = F.regexp_extract_all(text, F.lit(r"export\s+(?:async\s+)?(?:function|const|class)\s+([A-Za-z_$][\w$]*)"), F.lit(1))
    lists = F.regexp_extract_all(text, F.lit(r"import\s*\{([^}]*)\}"), F.lit(1))
    names = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda n: F.regexp_replace(F.trim(n), r"\s+as\s+.*$", ""))
    return F.struct(F.array_distinct(exports).alias("exports"), F.array_distinct(F.filter(names, lambda n: n != "")).alias("imports"))


def added_lines(lines: DataFrame, by: str, order: str, line: str) -> DataFrame:
    """``by, order, text``: lines that a diff adds; a "+++" line is a header before the first hunk and content inside one."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.startswith(line, F.lit("@@")), True).when(F.startswith(line, F.lit("diff --git")), False)
    inside = F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False))
    return lines.withColumn("_in", inside).where(F.col("_in") & F.startswith(line, F.lit("+"))).select(by, order, F.expr(f"substr(`{line}`, 2)").alias("text"))


def tree_digest(files: DataFrame, by: str, path: str, digest: str) -> DataFrame:
    """``by, state``: one digest of a tree's files in path order; changed by any path or content.

    Files are digested by the first two characters of their path's hash first, so no list holds a whole tree.
    """
    def rolled(df, keys, x):
        return df.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(x)), "\n"), 256).alias("d"))

    leaf = files.select(by, F.substring(F.sha2(path, 256), 1, 2).alias("_s"), F.concat_ws("\n", path, digest).alias("_x"))
    return rolled(rolled(leaf, [by, "_s"], "_x"), [by], F.concat_ws(":", "_s", "d")).withColumnRenamed("d", "state")


def references(lines: DataFrame, entities: DataFrame, weight: float = 0.8, in_code: float = 0.05) -> DataFrame:
    """``entity, doc, line, confidence``: where documents name entities as whole words.

    ``lines``: ``doc, line, text, code boolean``; ``entities``: ``entity, code_only boolean``.  An
    entity known only from code counts inside code spans alone; a code span adds to the confidence.
    Words meet entities by equality.
    """
    words = lines.select("doc", "line", "code", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("entity"))
    hit = words.join(entities, "entity").where(~F.col("code_only") | F.col("code"))
    return hit.groupBy("entity", "doc", "line").agg(F.least(F.lit(1.0), weight + F.max(F.when(F.col("code"), in_code).otherwise(0.0))).alias("confidence"))


def ranked_references(refs: DataFrame, limit: int = 20) -> DataFrame:
    """The best references of each document: by confidence, then line, then entity."""
    w = Window.partitionBy("doc").orderBy(F.desc("confidence"), "line", "entity")
    return refs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def doc_status(refs: DataFrame, changed: DataFrame, removed: DataFrame, touched: DataFrame) -> DataFrame:
    """``doc, status``: stale where it names what was removed, or, untouched, what was changed; updated where it was touched."""
    gone = refs.join(removed.select("entity"), "entity", "left_semi").groupBy("doc").agg(F.lit(True).alias("_gone"))
    other = refs.join(changed.select("entity"), "entity", "left_semi").groupBy("doc").agg(F.lit(True).alias("_other"))
    docs = refs.select("doc").union(touched.select("doc")).distinct()
    t = touched.select("doc").distinct().withColumn("_touched", F.lit(True))
    all_ = docs.join(gone, "doc", "left").join(other, "doc", "left").join(t, "doc", "left")
    status = F.when(F.col("_gone"), "stale").when(F.col("_touched"), "updated").when(F.col("_other"), "stale").otherwise("unaffected")
    return all_.select("doc", status.alias("status"))


def suffix_targets(edges: DataFrame, nodes: DataFrame, unique: float = 0.9, shared: float = 0.7) -> DataFrame:
    """``src, target, dst, confidence``: the nodes whose dotted names end in the target, at the longest common ending.

    One such node costs a tenth of the confidence, several (the smallest name is taken) three tenths.
    """
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\."))), lambda i: F.array_join(F.slice(F.split(c, r"\."), i, F.size(F.split(c, r"\."))), "."))
    # an ending is one row, however many nodes have it, and a target is looked up once, however many edges name it
    by_end = nodes.select(F.col("id").alias("dst")).distinct().select("dst", F.explode(ends("dst")).alias("_end")).groupBy("_end").agg(F.min("dst").alias("dst"), F.count("*").alias("n"))
    e = edges.select("src", "target", "confidence").distinct()
    wanted = e.select("target").distinct().select("target", F.posexplode(ends("target")).alias("_k", "_end"))
    top = e.join(wanted.join(by_end, "_end").groupBy("target").agg(F.min_by(F.struct("dst", "n"), "_k").alias("b")), "target")
    return top.select("src", "target", F.col("b.dst").alias("dst"), (F.col("confidence") * F.when(F.col("b.n") == 1, unique).otherwise(shared)).alias("confidence"))


def addressed(files: DataFrame, id_col: str, raw: str) -> DataFrame:
    """Adds ``claim``: the raw text where its digest is the address it stands under, else null."""
    return files.withColumn("claim", F.when(F.sha2(F.col(raw), 256) == F.col(id_col), F.col(raw)))


def admitted(log: DataFrame, new: DataFrame, claims: DataFrame, id_col: str = "claim_id", digest: str = "h") -> DataFrame:
    """New sealed records of known claims that the log does not hold yet, each once."""
    sound = new.where(F.col(digest).isNotNull()).dropDuplicates([id_col, digest])
    return sound.join(claims.select(id_col), id_col, "left_semi").join(log.select(id_col, digest), [id_col, digest], "left_anti")


def index_lines(facts: DataFrame, by: str, name: str, cap: int = 5) -> DataFrame:
    """``by, line, place``: the index's lines, names in order, and one that counts what is left out."""
    w = Window.partitionBy(by)
    r = facts.withColumn("place", F.row_number().over(w.orderBy(name))).withColumn("_n", F.count("*").over(w))
    shown = r.where(F.col("place") <= cap).select(by, F.concat(F.lit("- "), name).alias("line"), "place")
    more = r.where((F.col("place") == cap + 1)).select(by, F.concat(F.lit("- (+"), (F.col("_n") - cap).cast("string"), F.lit(" more)")).alias("line"), "place")
    return shown.unionByName(more)
