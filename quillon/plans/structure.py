"""Queries on graphs of code, choke points and assembly under a budget, each with the SQL that states it where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import biconnected, context, diffs, graph
from ..sources import caches, code, replicas
from ..sources.rounds import Rounds
from ..streaming import drift
from ..streaming import events as live
from .catalog import query, r6, read, spread

_BUDGET = 2_000
_ITEM = """SELECT doc_id // 20 AS task, doc_id AS item, source, doc_id % 3 = 0 AS req, (doc_id * 37 % 101) / 100.0::DOUBLE AS score, CAST(ceil(length(text) / 3.6::DOUBLE) AS BIGINT) AS a,
  CAST(ceil(length(array_to_string(string_split(text, chr(10))[1:25], chr(10))) / 3.6::DOUBLE) AS BIGINT) AS b, 8::BIGINT AS c FROM documents"""


def _items(spark, sf):
    d = read(spark, sf, "documents")
    tokens = lambda t: F.ceil(F.length(t) / 3.6)
    level = lambda name, n: F.struct(F.lit(name).alias("level"), n.cast("long").alias("tokens"))
    return d.select(
        F.expr("doc_id div 20").alias("task"), F.col("doc_id").alias("item"), "source", F.col("doc_id").alias("ord"), (F.col("doc_id") * 37 % 101 / 100).alias("score"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))).alias("covers"),
        F.array(level("full", tokens("text")), level("head", tokens(F.substring_index("text", "\n", 25))), level("pointer", F.lit(8))).alias("ladder"),
    )


@query(f"""WITH RECURSIVE d AS ({_ITEM}), st AS (SELECT task, item, 0 AS step, a AS turn, a - b AS saved FROM d WHERE req UNION ALL SELECT task, item, 1, least(a, b), b - c FROM d WHERE req),
w AS (SELECT task, sum(a) AS whole FROM d WHERE req GROUP BY task),
r AS (SELECT st.*, whole, whole - sum(saved) OVER (PARTITION BY task ORDER BY turn DESC, item, step ROWS UNBOUNDED PRECEDING) AS upto FROM st JOIN w USING (task)),
q AS (SELECT *, least(whole, coalesce(min(upto) OVER (PARTITION BY task ORDER BY turn DESC, item, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), whole)) > {_BUDGET} AS goes FROM r),
dn AS (SELECT task, item, count(*) FILTER (goes) AS down FROM q GROUP BY task, item),
must AS (SELECT d.task, d.item, source, CASE down WHEN 0 THEN 'full' WHEN 1 THEN 'head' ELSE 'pointer' END AS level, CASE down WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS tokens FROM d JOIN dn USING (task, item)),
sp AS (SELECT task, CAST(sum(tokens) AS BIGINT) AS spent FROM must GROUP BY task),
o AS (SELECT task, item, source, a AS tokens, row_number() OVER (PARTITION BY task ORDER BY score DESC, item) AS n FROM d WHERE NOT req),
g AS (SELECT t.task, CAST(0 AS BIGINT) AS n, coalesce(spent, 0) AS used, false AS took FROM (SELECT DISTINCT task FROM o) t LEFT JOIN sp USING (task)
  UNION ALL SELECT g.task, o.n, CASE WHEN g.used + o.tokens <= {_BUDGET} THEN g.used + o.tokens ELSE g.used END, g.used + o.tokens <= {_BUDGET} FROM g JOIN o ON o.task = g.task AND o.n = g.n + 1),
k AS (SELECT o.*, row_number() OVER (PARTITION BY o.task, source ORDER BY o.n) AS nth FROM o JOIN g ON g.task = o.task AND g.n = o.n WHERE took),
e AS (SELECT task, min(n) AS last FROM k WHERE pow(0.7::DOUBLE, nth - 1) < 0.2 GROUP BY task)
SELECT task, item, source, level, tokens, true AS required FROM must UNION ALL SELECT k.task, item, source, 'full', tokens, false FROM k LEFT JOIN e ON e.task = k.task WHERE last IS NULL OR n <= last""")
def g9_assembled(spark, sf):
    return context.assembled(_items(spark, sf), _BUDGET)


@query("SELECT doc_id // 20 AS task, count(*) FILTER (doc_id % 30 = 0 OR doc_id % 60 = 1) = 0 AS ok, count(*) FILTER (doc_id % 30 = 0 OR doc_id % 60 = 1) AS missing, count(*) FILTER (doc_id % 30 = 0 OR doc_id % 60 = 1) AS questions FROM documents WHERE doc_id % 3 = 0 OR doc_id % 60 = 1 GROUP BY 1")
def g9_complete(spark, sf):
    items = _items(spark, sf)
    key = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    need = read(spark, sf, "documents").where("doc_id % 3 = 0 OR doc_id % 60 = 1").select(F.expr("doc_id div 20").alias("task"), key.alias("key"), (~((F.col("doc_id") % 30 == 0) | (F.col("doc_id") % 60 == 1))).alias("resolvable"))
    return context.complete(need, context.assembled(items, _BUDGET), items)


@query(None)
def g5_chokepoints(spark, sf):
    """Orders and parts, joined by every line; a part is a choke point for the orders of it alone.  Tests compare it with a depth-first search."""
    e = read(spark, sf, "lineitem").select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))  # orders are even, parts odd
    found = biconnected.chokepoints(None, e)
    return found.select(F.concat(F.when(F.col("id") % 2 == 0, "o").otherwise("p"), F.expr("id div 2").cast("string")).alias("id"), "splits")


# --- a code graph: every supplier is a file, and each of its lines a statement about a part ------

_LINE = "CASE l_linenumber WHEN 1 THEN concat('def p', l_partkey, '(x):') WHEN 2 THEN concat('    return p', l_partkey, '(x)') WHEN 3 THEN concat('class C', l_partkey, '(B', l_suppkey, '):') WHEN 4 THEN concat('import m', l_partkey % 9) WHEN 5 THEN concat('from s', l_partkey % 7, ' import p', l_partkey) ELSE concat('# ', l_partkey) END"
_CODE = f"SELECT l_suppkey AS s, {_LINE} AS text, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS line FROM lineitem"
_TREE = rf"""c AS ({_CODE}), df AS (SELECT *, regexp_extract(text, '^(def|class) ([A-Za-z]\w*)', 2) AS name FROM c WHERE regexp_matches(text, '^(def|class) ')),
 pl AS (SELECT c.*, last_value(CASE WHEN df.name IS NOT NULL THEN concat('s', c.s, '.py:', df.name, ':', c.line) END IGNORE NULLS) OVER w AS own, last_value(df.name IGNORE NULLS) OVER w AS own_name FROM c LEFT JOIN df USING (s, line) WINDOW w AS (PARTITION BY c.s ORDER BY c.line ROWS UNBOUNDED PRECEDING)),
 n AS (SELECT concat('module:s', s) AS id, CAST(NULL AS VARCHAR) AS qname, concat('s', s) AS name FROM c GROUP BY s UNION ALL SELECT concat('s', s, '.py:', name, ':', line), concat('s', s, '.', name), name FROM df),
 e AS (SELECT concat('module:s', s) AS source, concat('s', s, '.py:', name, ':', line) AS target, 'contains' AS kind, line, 1.0::DOUBLE AS confidence FROM df
  UNION ALL SELECT concat('s', s, '.py:', name, ':', line), concat('B', s), 'inherits', line, 0.9::DOUBLE FROM df WHERE starts_with(text, 'class')
  UNION ALL SELECT coalesce(own, concat('module:s', s)), regexp_extract(text, '^    return (p\d+)', 1), 'calls', line, 0.75::DOUBLE FROM pl WHERE starts_with(text, '    return') AND regexp_extract(text, '^    return (p\d+)', 1) <> coalesce(own_name, '')
  UNION ALL SELECT concat('s', s, '.py:', name, ':', line), concat('B', s), 'calls', line, 0.75::DOUBLE FROM df WHERE false
  UNION ALL SELECT coalesce(own, concat('module:s', s)), regexp_extract(text, '^import (m\d)', 1), 'imports', line, 0.85::DOUBLE FROM pl WHERE starts_with(text, 'import')
  UNION ALL SELECT coalesce(own, concat('module:s', s)), regexp_extract(text, '^from (s\d)', 1), 'imports', line, 0.85::DOUBLE FROM pl WHERE starts_with(text, 'from')
  UNION ALL SELECT coalesce(own, concat('module:s', s)), regexp_replace(text, '^from (s\d) import (p\d+)$', '\1.\2'), 'imports', line, 0.85::DOUBLE FROM pl WHERE starts_with(text, 'from')),
 q AS (SELECT qname, max(id) AS id FROM n WHERE qname IS NOT NULL GROUP BY qname), u AS (SELECT name, min(id) AS id FROM n GROUP BY name HAVING count(*) = 1),
 g AS (SELECT e.source, coalesce(i.id, q.id, u.id, e.target) AS target, e.kind, e.line, CASE WHEN i.id IS NULL AND q.id IS NULL AND u.id IS NOT NULL THEN confidence * 0.9 ELSE confidence END AS confidence, coalesce(i.id, q.id, u.id) IS NULL AS unresolved
  FROM e LEFT JOIN (SELECT DISTINCT id FROM n) i ON i.id = e.target LEFT JOIN q ON q.qname = e.target LEFT JOIN u ON u.name = list_extract(string_split(e.target, '.'), -1))"""


def _tree(spark, sf):
    """``file, text, digest`` of the suppliers' files."""
    l = read(spark, sf, "lineitem").withColumn("t", F.expr(_LINE))
    at = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "t")))
    f = l.groupBy("l_suppkey").agg(at.alias("r")).select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("file"), F.array_join("r.t", "\n").alias("text"))
    return f.withColumn("digest", F.sha2("text", 256))


def _graph(spark, sf):
    run = Rounds(spark, "code-graph")
    nodes, edges, _ = code.CodeGraph(spark, f"{run.folder}/facts").build(run.keep(_tree(spark, sf)))
    return run, nodes, edges


@query(f"WITH {_TREE} SELECT source, target, kind, line, round(confidence, 6) AS confidence, unresolved FROM g")
def g1_code_edges(spark, sf):
    run, _, edges = _graph(spark, sf)
    return run.result(edges.withColumn("confidence", r6("confidence")))


@query(f"WITH {_TREE} SELECT regexp_extract(source, '^(module:)?(s\\d+)', 2) AS file, kind, count(*) AS n, count(*) FILTER (unresolved) AS unresolved FROM g GROUP BY ALL")
def s9_code_graph(spark, sf):
    run, _, edges = _graph(spark, sf)
    g = edges.groupBy(F.regexp_extract("source", r"^(module:)?(s\d+)", 2).alias("file"), "kind")
    return run.result(g.agg(F.count("*").alias("n"), F.count_if("unresolved").alias("unresolved")))


@query("SELECT substr(h, 1, 2) AS shard, count(DISTINCT h) AS n, true AS same FROM (SELECT sha256(concat(event_id, ':', event_type)) AS h FROM events) GROUP BY 1")
def s18_synced(spark, sf):
    """Two replicas that have two thirds of the events each, after they met: records in each partition, and whether both have the same."""
    run = Rounds(spark, "replicas")
    e = read(spark, sf, "events").select("event_id", F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("line")).withColumn("h", replicas.sealed(F.col("line")))
    a, b = (replicas.Replica(spark, f"{run.folder}/{n}") for n in "ab")
    a.append(e.where("event_id % 3 <> 0").select("h", "line"))
    b.append(e.where("event_id % 3 <> 1").select("h", "line"))
    replicas.sync(a, b)
    x, y = (r.records().groupBy("shard").agg(F.count("*").alias(f"n{i}"), F.bit_xor(F.xxhash64("h")).alias(f"d{i}")) for i, r in enumerate((a, b)))
    same = F.coalesce((F.col("n0") == F.col("n1")) & (F.col("d0") == F.col("d1")), F.lit(False))
    return run.result(x.join(y, "shard", "full_outer").select("shard", F.coalesce("n0", "n1").alias("n"), same.alias("same")))


# --- diffs -----------------------------------------------------------------------------

_DIFF = r"concat('diff --git a/x b/x\n--- a/src/', p_brand, '.js\n+++ b/src/', p_brand, '.js\n@@ -', p_size, ',2 +', p_size + 1, ',3 @@\n same\n-export function old', p_partkey % 50, '() {}\n+export function fn', p_partkey % 40, '() {}\n+process.env.V', p_size, '\n')"
_KIND_PATH = "CASE p_partkey % 8 WHEN 0 THEN concat('src/', p_brand, '.js') WHEN 1 THEN concat('docs/', p_size, '.MD') WHEN 2 THEN concat('a/spec/', p_size, '.rb') WHEN 3 THEN '.github/workflows/x.yml' WHEN 4 THEN concat('p', p_size, '/package.json') WHEN 5 THEN concat('db/migrations/', p_size, '.sql') WHEN 6 THEN concat('conf/', p_brand, '.toml') ELSE concat('lib/', p_brand, '.test.ts') END"


def _hunks(spark, sf):
    d = spread(read(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey").select("p_partkey", F.expr(_DIFF).alias("d"))
    return diffs.hunk_lines(d, "p_partkey", "d")


@query("""SELECT p_partkey, concat('src/', p_brand, '.js') AS file, x.op, CASE x.i WHEN 0 THEN p_size WHEN 1 THEN p_size + 1 END AS old_line, CASE x.i WHEN 0 THEN p_size + 1 WHEN 2 THEN p_size + 2 WHEN 3 THEN p_size + 3 END AS new_line
 FROM part, (VALUES (0, ' '), (1, '-'), (2, '+'), (3, '+')) AS x(i, op)""")
def f10_hunk_lines(spark, sf):
    return _hunks(spark, sf).drop("text")


@query("""WITH cur AS (SELECT DISTINCT concat('fn', p_partkey % 40) AS name FROM part WHERE p_size % 2 = 0 AND p_partkey % 40 < 30)
 SELECT p_partkey, 'symbol' AS type, concat('fn', p_partkey % 40) AS name, concat('fn', p_partkey % 40) NOT IN (SELECT name FROM cur) AS removed FROM part
 UNION ALL SELECT p_partkey, 'symbol', concat('old', p_partkey % 50), true FROM part
 UNION ALL SELECT p_partkey, 'env', concat('V', p_size), true FROM part WHERE length(concat('V', p_size)) >= 2""")
def f34_changed_entities(spark, sf):
    now = read(spark, sf, "part").where("p_size % 2 = 0 AND p_partkey % 40 < 30").select(F.concat(F.lit("src/"), "p_brand", F.lit(".js")).alias("file"), F.concat(F.lit("export const fn"), (F.col("p_partkey") % 40).cast("string"), F.lit(" = 1")).alias("text"))
    return diffs.changed_entities(_hunks(spark, sf), "p_partkey", diffs.entities(now))


@query("SELECT p_partkey, CASE WHEN p_partkey % 8 IN (2, 7) THEN 'test' WHEN p_partkey % 8 = 1 THEN 'documentation' WHEN p_partkey % 8 = 3 THEN 'workflow' WHEN p_partkey % 8 = 4 THEN 'manifest' WHEN p_partkey % 8 = 5 THEN 'schema' WHEN p_partkey % 8 = 6 THEN 'config' ELSE 'source' END AS kind FROM part")
def p11_artifact_kind(spark, sf):
    return read(spark, sf, "part").select("p_partkey", diffs.artifact_kind(F.expr(_KIND_PATH)).alias("kind"))


@query(f"""WITH x AS (SELECT p_partkey, {_KIND_PATH} AS artifact, p_size FROM part)
 SELECT p_partkey, artifact, CASE WHEN p_partkey % 8 IN (2, 7) THEN 'test' WHEN p_partkey % 8 = 1 THEN 'docs' WHEN p_partkey % 8 = 3 THEN 'ci' WHEN p_partkey % 8 = 4 THEN 'dependency' WHEN p_partkey % 8 = 5 THEN 'schema' WHEN p_size % 3 = 0 THEN 'public_api' WHEN p_partkey % 8 = 6 THEN 'config' ELSE 'logic' END AS kind, 2 AS lines FROM x""")
def p11_changed_files(spark, sf):
    text = F.when(F.col("p_size") % 3 == 0, "export class A").otherwise("let b")
    h = read(spark, sf, "part").select("p_partkey", F.expr(_KIND_PATH).alias("file"), F.explode(F.array(F.lit("+"), F.lit("-"))).alias("op"), F.col("p_size").alias("new_line"), F.col("p_size").alias("old_line"), text.alias("t"))
    h = h.select("p_partkey", "file", "op", "new_line", "old_line", F.concat("t", F.when(F.col("op") == "+", " = 2").otherwise(" = 1")).alias("text"))
    return diffs.changed_files(h, "p_partkey").select("p_partkey", "artifact", "kind", "lines")


@query(None)
def g17_diff_impact(spark, sf):
    """What a change of all files that the newest order has lines in reaches in the suppliers' code graph."""
    run, nodes, edges = _graph(spark, sf)
    l = read(spark, sf, "lineitem")
    last = l.agg(F.max("l_orderkey").alias("l_orderkey"))  # one row
    diff = F.concat(F.lit("--- a/s"), F.col("l_suppkey").cast("string"), F.lit(".py\n+++ b/s"), F.col("l_suppkey").cast("string"), F.lit(".py\n@@ -1 +1 @@\n-def p1(x):\n+def p2(x, y):\n"))
    d = l.join(F.broadcast(last), "l_orderkey", "left_semi").select("l_suppkey", diff.alias("d")).distinct()
    _, hit = diffs.diff_impact(diffs.hunk_lines(d, "l_suppkey", "d"), "l_suppkey", run.keep(nodes), run.keep(edges))
    return run.result(hit.select("artifact", "kind", "changed", r6("overall").alias("overall")))


@query(None)
def g6_code_impact(spark, sf):
    """Definitions that depend on the newest order's suppliers' files, in the suppliers' code graph of the whole table."""
    run, _, edges = _graph(spark, sf)
    l = read(spark, sf, "lineitem")
    starts = l.join(F.broadcast(l.agg(F.max("l_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi").select(F.concat(F.lit("module:s"), F.col("l_suppkey").cast("string")).alias("id"))
    hit = graph.impact(edges.where("not unresolved").select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("confidence").alias("w")), starts)
    return run.result(hit.select("id", r6("strength").alias("strength"), "hops"))


@query("""WITH s AS (SELECT event_id, user_id, sum(coalesce(value / 100, 0) - 0.35) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)
SELECT event_id, round(s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), 6) AS c FROM s""")
def x8_stream_charts(spark, sf):
    """Drift charts of every user as keyed state, which goes when a user falls idle."""
    run = Rounds(spark, "charts")
    key, value = drift.STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        e = spark.readStream.schema(read(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
        rows = e.select(F.col("user_id").alias("sid"), F.col("event_id").alias("seq"), "ts", (F.col("value") / 100).alias("d"))
        live.run(drift.charted(rows), f"{run.folder}/out", f"{run.folder}/checkpoint")
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return run.result(spark.read.parquet(f"{run.folder}/out").where("not ended").select(F.col("seq").alias("event_id"), r6("c").alias("c")))


_CACHED = "SELECT vec_id AS k, vec_id % 3 AS turn, length(concat('{\"k\":\"', vec_id, '\",\"v\":[', vec_id % 7, '.0]}')) + 1 AS bytes FROM embeddings"


@query(f"""WITH c AS ({_CACHED}), r AS (SELECT *, sum(bytes) OVER (ORDER BY turn DESC, CAST(k AS VARCHAR) ROWS UNBOUNDED PRECEDING) AS upto, (SELECT sum(bytes) FROM c) AS whole FROM c)
 SELECT CAST(k AS VARCHAR) AS k, CAST(k % 7 AS DOUBLE) AS v FROM r WHERE upto <= (whole - 1) // 2""")
def s11_cache(spark, sf):
    """A cache that three appends fill to one byte more than it holds, so the last one cuts it to the newest half."""
    run = Rounds(spark, "cache-query")
    e = read(spark, sf, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("k"), F.array((F.col("vec_id") % 7).cast("double")).alias("v"))
    whole = e.agg(F.sum(F.length(F.to_json(F.struct("k", "v"))) + 1)).first()[0] or 1
    cache = caches.VectorCache(spark, f"{run.folder}/cache", whole - 1)
    for part in range(3):
        cache.append(e.where(f"vec_id % 3 = {part}"))
    return run.result(cache.read().select("k", F.col("v")[0].alias("v")))
