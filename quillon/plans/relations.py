"""Queries on joins, lines, scores, splits and cycles, each with the SQL that states it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour, scores
from ..operators import graph, learning, relations
from ..sources import lines
from .catalog import query, r6, read


@query("""WITH n AS (SELECT concat('n', n_nationkey) AS id, concat(n_regionkey, '.', n_name) AS qname, substr(n_name, 1, 3) AS name FROM nation),
 e AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN concat('n', n_nationkey) WHEN 1 THEN concat(n_regionkey, '.', n_name) WHEN 2 THEN substr(n_name, 1, 3) ELSE 'none' END AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 u AS (SELECT name, min(id) AS id FROM n GROUP BY name HAVING count(*) = 1)
 SELECT s_suppkey, target, coalesce(a.id, q.id, u.id) AS dst, CASE WHEN a.id IS NULL AND q.id IS NULL AND u.id IS NOT NULL THEN 0.72 ELSE 0.8 END::DOUBLE AS confidence
 FROM e LEFT JOIN n a ON a.id = target LEFT JOIN (SELECT qname, min(id) AS id FROM n GROUP BY qname) q ON q.qname = target LEFT JOIN u ON u.name = target""")
def j1_resolved_edges(spark, sf):
    n = read(spark, sf, "nation").selectExpr("n_nationkey", "concat('n', n_nationkey) AS id", "concat(n_regionkey, '.', n_name) AS qname", "substr(n_name, 1, 3) AS name")
    e = read(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    e = e.selectExpr("s_suppkey", "CASE s_suppkey % 4 WHEN 0 THEN id WHEN 1 THEN qname WHEN 2 THEN name ELSE 'none' END AS target", "0.8D AS confidence")
    return relations.resolved_edges(e, n).withColumn("confidence", r6("confidence"))


_PATH = "concat(p_brand, '/', p_size % 10, '.', p_size)"


@query(f"""WITH n AS (SELECT p_brand AS name FROM part UNION SELECT concat(p_brand, '/', p_size % 10) FROM part WHERE p_size > 25 UNION SELECT substr(p_brand, 1, 6) FROM part)
 SELECT p_partkey, arg_max(name, length(name)) AS name FROM part JOIN n ON {_PATH} = name OR starts_with({_PATH}, concat(name, '/')) OR starts_with({_PATH}, concat(name, '.')) GROUP BY p_partkey""")
def j6_longest_prefix(spark, sf):
    p = read(spark, sf, "part")
    names = p.selectExpr("p_brand AS name").union(p.where("p_size > 25").selectExpr("concat(p_brand, '/', p_size % 10)")).union(p.selectExpr("substr(p_brand, 1, 6)")).distinct()
    return relations.longest_prefix(p.selectExpr("p_partkey", f"{_PATH} AS path"), "p_partkey", "path", names, "name")


@query(r"""WITH g AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS g FROM part), w AS (SELECT DISTINCT p_partkey, unnest(string_split(concat(lower(p_type), ' ', substr(lower(p_name), 1, 5)), ' ')) AS w FROM part)
 SELECT p_partkey, count(DISTINCT g) AS hits FROM g JOIN w USING (p_partkey) WHERE g = w OR (length(g) >= 4 AND (starts_with(w, g) OR (length(w) >= 4 AND starts_with(g, w)))) GROUP BY p_partkey""")
def j7_prefix_hits(spark, sf):
    p = read(spark, sf, "part")
    goals = p.select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("token"))
    words = p.select("p_partkey", F.explode(F.split(F.expr("concat(lower(p_type), ' ', substr(lower(p_name), 1, 5))"), " ")).alias("token"))
    return relations.prefix_hits(goals, words, "p_partkey", "token")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j11_unreferenced(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


_MINE = "n_nationkey % 5 = 1"
_NEXT = "(n_nationkey * 3 + 1) % 25"


@query(f"""WITH mine AS (SELECT n_nationkey AS f FROM nation WHERE {_MINE}), near AS (SELECT DISTINCT {_NEXT} AS f FROM nation WHERE {_MINE} AND {_NEXT} NOT IN (SELECT f FROM mine)),
 s AS (SELECT DISTINCT user_id, event_id % 25 AS f FROM events)
 SELECT user_id AS session, count(*) FILTER (f IN (SELECT f FROM mine)) AS direct, count(*) FILTER (f IN (SELECT f FROM near)) AS coupled,
  round(least(1.0, (count(*) FILTER (f IN (SELECT f FROM mine)) + 0.5 * count(*) FILTER (f IN (SELECT f FROM near)))::DOUBLE / (SELECT count(*) FROM mine)), 4) AS strength
 FROM s WHERE f IN (SELECT f FROM mine) OR f IN (SELECT f FROM near) GROUP BY user_id""")
def j16_collisions(spark, sf):
    n, e = read(spark, sf, "nation"), read(spark, sf, "events")
    return relations.collisions(e.selectExpr("user_id AS session", "event_id % 25 AS file"), n.where(_MINE).selectExpr("n_nationkey AS file"), n.selectExpr("n_nationkey AS src", f"{_NEXT} AS dst"))


@query("SELECT l_suppkey, l_partkey, l_returnflag, max(l_discount) AS confidence FROM lineitem GROUP BY ALL")
def j17_strongest(spark, sf):
    return relations.strongest(read(spark, sf, "lineitem").withColumnRenamed("l_discount", "confidence"), ["l_suppkey", "l_partkey", "l_returnflag"])


@query("""WITH k AS (SELECT event_id, unnest([concat('u', user_id), concat('v', CAST(floor(value) AS BIGINT))]) AS k FROM events), f AS (SELECT k, min(event_id) AS first FROM k GROUP BY k)
 SELECT event_id, bool_or(first < event_id) AS recurred FROM k JOIN f USING (k) GROUP BY event_id""")
def j22_recurred(spark, sf):
    return relations.recurred(read(spark, sf, "events"), "event_id", F.expr("array(concat('u', user_id), concat('v', CAST(floor(value) AS BIGINT)))"))


@query("""WITH e AS (SELECT l_suppkey % 25 AS src, l_partkey % 25 AS dst, count(*) AS n FROM lineitem WHERE l_suppkey % 25 <> l_partkey % 25 GROUP BY ALL),
 t AS (SELECT d FROM (SELECT src AS d, n FROM e UNION ALL SELECT dst, n FROM e) GROUP BY d ORDER BY sum(n) DESC, d LIMIT 9) SELECT * FROM e WHERE src IN (FROM t) AND dst IN (FROM t)""")
def a18_directory_edges(spark, sf):
    return relations.directory_edges(read(spark, sf, "lineitem").selectExpr("l_suppkey % 25 AS src", "l_partkey % 25 AS dst"), "src", "dst")


@query("SELECT p_brand, round(sum(p_retailprice), 2) AS score FROM (SELECT DISTINCT p_partkey, p_brand, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY p_brand")
def a17_centrality(spark, sf):
    seen = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf, "part").join(seen, "p_partkey", "left_semi").groupBy("p_brand").agg(F.round(F.sum("p_retailprice"), 2).alias("score"))


@query("""SELECT n_name, CASE WHEN ok IS NULL THEN 'UNAVAILABLE' WHEN ok THEN 'ACTIVE' ELSE 'DEGRADED' END AS state FROM nation
 LEFT JOIN (SELECT s_nationkey, bool_and(s_acctbal > 0) AS ok FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def a39_states(spark, sf):
    n = read(spark, sf, "nation").select("n_nationkey", "n_name")
    checks = read(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("n_name", "s_acctbal > 0 AS ok")
    return relations.states(n.select("n_name"), checks, "n_name")


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F', o_orderdate DESC, o_orderkey) = 1""")
def w10_preferred(spark, sf):
    o = read(spark, sf, "orders").selectExpr("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus = 'F' AS retired")
    return relations.preferred(o, "o_custkey", "retired", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("""SELECT event_id, n <= floor(c * 0.8::DOUBLE) AS train, (n - 1) % 5 = 0 AS held_out FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events)""")
def w11_splits(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id")
    return learning.strided(learning.prequential(e, "user_id", "event_id"), "user_id", "event_id").select("event_id", "train", "held_out")


_MD = r"concat('# ', p_brand, '\n', p_name, '\n```\n# not a heading\n```\n## ', p_type, '\n#none\nend')"


@query(f"""WITH l AS (SELECT p_partkey, unnest(string_split({_MD.replace(chr(92) + 'n', "', chr(10), '")}, chr(10))) AS text, generate_subscripts(string_split({_MD.replace(chr(92) + 'n', "', chr(10), '")}, chr(10)), 1) AS line FROM part),
 c AS (SELECT *, sum(CASE WHEN starts_with(text, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY line) % 2 = 1 AS in_code FROM l),
 h AS (SELECT *, CASE WHEN NOT in_code AND regexp_matches(text, '^#{{1,6}}\\s+\\S') THEN trim(regexp_replace(text, '^#{{1,6}}\\s+', '')) END AS h FROM c)
 SELECT p_partkey, line, in_code, last_value(h IGNORE NULLS) OVER (PARTITION BY p_partkey ORDER BY line) AS section FROM h""".replace("\\\\", "\\"))
def w8_sections(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.expr(_MD).alias("md"))
    return lines.sections(p, "p_partkey", "md").select("p_partkey", "line", "in_code", "section")


@query("""SELECT p_partkey, concat('src/', p_brand, '.js') AS file, CAST(2 + p_size % 2 AS BIGINT) AS added, 1::BIGINT AS removed FROM part""")
def f9_diff_footprint(spark, sf):
    diff = r"concat('diff --git a/x b/x\n--- a/x\n+++ b/src/', p_brand, '.js\n@@ -1 +1 @@\n-', p_name, '\n+++ not a file\n+', p_type, if(p_size % 2 = 1, '\n+odd', ''), '\n same')"
    return lines.diff_footprint(read(spark, sf, "part").select("p_partkey", F.expr(diff).alias("d")), "p_partkey", "d")


@query("""WITH c AS (SELECT p_partkey, p_partkey * 37 % 256 / 255.0::DOUBLE AS r, p_partkey * 91 % 256 / 255.0::DOUBLE AS g, p_size * 5 % 256 / 255.0::DOUBLE AS b FROM part),
 m AS (SELECT *, greatest(r, g, b) AS x, greatest(r, g, b) - least(r, g, b) AS d, (greatest(r, g, b) + least(r, g, b)) / 2 AS k FROM c)
 SELECT p_partkey, CAST(floor(60 * CASE WHEN d = 0 THEN 0 WHEN x = r THEN ((g - b) / d + 6) % 6 WHEN x = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END + 0.5) AS BIGINT) % 360 AS h,
  CAST(floor(CASE WHEN d = 0 THEN 0 ELSE d / (1 - abs(2 * k - 1)) END * 100 + 0.5) AS BIGINT) AS s, CAST(floor(k * 100 + 0.5) AS BIGINT) AS l FROM m""")
def f40_hsl(spark, sf):
    p = read(spark, sf, "part")
    return p.select("p_partkey", colour.hsl(F.expr("p_partkey * 37 % 256"), F.expr("p_partkey * 91 % 256"), F.expr("p_size * 5 % 256")).alias("c")).select("p_partkey", "c.*")


def _miss(u):
    return f"list_sum(list_transform(v, lambda s: abs(s - floor(s / {u} + 0.5) * {u})))"


@query(f"""WITH c AS (SELECT o_custkey, list(CAST(floor(o_totalprice) AS BIGINT) % 64 // (1 + o_custkey % 3) * (1 + o_custkey % 8)) AS v FROM orders GROUP BY o_custkey),
 b AS (SELECT *, CAST(CASE WHEN {_miss(8)} <= 0.5 * len(v) THEN 8 WHEN {_miss(4)} <= 0.5 * len(v) THEN 4 WHEN {_miss(2)} <= 0.5 * len(v) THEN 2
  WHEN {_miss(2)} <= least({_miss(4)}, {_miss(8)}) THEN 2 WHEN {_miss(4)} <= {_miss(8)} THEN 4 ELSE 8 END AS INTEGER) AS base FROM c)
 SELECT o_custkey, base, round(len(list_filter(v, lambda s: abs(s - floor(s / base + 0.5) * base) <= 0.5))::DOUBLE / len(v), 6) AS on_scale FROM b""")
def f42_spacing(spark, sf):
    v = read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.expr("CAST(floor(o_totalprice) AS BIGINT) % 64 div (1 + o_custkey % 3) * (1 + o_custkey % 8)")).alias("v"))
    v = v.withColumn("base", scores.spacing_base(F.col("v")))
    return v.select("o_custkey", "base", r6(scores.on_scale(F.col("v"), F.col("base"))).alias("on_scale"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_discount * l_quantity = 0 THEN 50 ELSE least(50, greatest(1, ceil(l_extendedprice / (l_discount * l_quantity * 100)))) END AS BIGINT) AS steps FROM lineitem""")
def f26_cadence(spark, sf):
    x = read(spark, sf, "lineitem")
    return x.select("l_orderkey", "l_linenumber", scores.checkpoint_cadence(F.col("l_discount"), F.col("l_quantity"), F.lit(100), F.col("l_extendedprice")).alias("steps"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_tax, 1 + 0.22 * least(1.0, log2(1 + greatest(1, l_quantity)) / 8) AS k, l_discount AS d FROM lineitem),
 g AS (SELECT *, least(1.0, 5 * d * k) AS a, least(1.0, 3 * l_tax * k) AS b FROM s), m AS (SELECT *, least(1.0, 0.7 * greatest(a, b) + 0.3 * (0.22 * a + 0.1 * b)) AS base FROM g)
 SELECT l_orderkey, l_linenumber, round(1 - (1 - base) * (1 - 0.28 * least(1.0, 10 * l_tax) * base), 6)::DOUBLE AS risk FROM m""")
def f28_overall(spark, sf):
    k = scores.change_scale(F.col("l_quantity"))
    signal = {"runtime": F.expr("5 * l_discount") * k, "docs": F.expr("3 * l_tax") * k}
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(scores.overall(signal, F.expr("10 * l_tax"))).alias("risk"))


@query("SELECT doc_id, CAST(floor(n_chars / 3.6::DOUBLE * CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 ELSE 0.5 END::DOUBLE + 0.5) AS BIGINT) AS saved FROM documents")
def f31_saved(spark, sf):
    return read(spark, sf, "documents").select("doc_id", scores.saved_estimate(F.col("n_chars"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'near' ELSE 'adapt' END")).alias("saved"))


def _grams(t):
    return f"list_distinct(list_transform(range(1, length({t})), lambda i: substr(lower({t}), i, 2)))"


@query(f"""WITH n AS (SELECT n_nationkey, n_name, {_grams("n_name")} AS b FROM nation), q AS (SELECT s_suppkey, {_grams("substr(n_name, 2, 5)")} AS a FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 s AS (SELECT s_suppkey, n_nationkey, n_name, len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) AS score FROM q, n WHERE len(a) > 0)
 SELECT s_suppkey, n_name AS suggestion FROM s WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, n_nationkey) = 1""")
def t8_suggest(spark, sf):
    n = read(spark, sf, "nation").select("n_nationkey", "n_name", scores.char_bigrams(F.col("n_name")).alias("b"))
    q = read(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", scores.char_bigrams(F.expr("substr(n_name, 2, 5)")).alias("a"))
    pairs = q.select("s_suppkey", "a", F.explode("a").alias("g")).join(n.select("n_nationkey", "n_name", "b", F.explode("b").alias("g")), "g")  # a score above 0 needs a common pair
    best = pairs.withColumn("score", scores.set_overlap(F.col("a"), F.col("b"))).where("score >= 0.4").groupBy("s_suppkey").agg(F.max_by("n_name", F.struct("score", F.expr("-n_nationkey"))).alias("suggestion"))
    return best


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS src, (s_suppkey * s_suppkey + 3) % m AS dst FROM supplier, (SELECT count(*) AS m FROM supplier)),
 r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
 SELECT a.src AS id, max(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src HAVING count(DISTINCT a.dst) > 1""")
def g4_cycles(spark, sf):
    s = read(spark, sf, "supplier")
    return graph.strong_components(s.selectExpr("s_suppkey AS src", f"(s_suppkey * s_suppkey + 3) % {s.count()} AS dst"))
