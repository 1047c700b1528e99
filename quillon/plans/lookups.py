"""Queries on look-ups, references, digests and projections, each with the SQL that states it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups as L
from .catalog import query, r6, read

_NODE = "SELECT p_partkey AS id, p_name AS name, concat(p_type, '.', p_name) AS qname, concat('src/', lower(p_brand), '/', p_partkey % 50) AS file FROM part"


def _nodes(spark, sf):
    read(spark, sf, "part").createOrReplaceTempView("_lookups_part")
    return spark.sql(_NODE.replace("FROM part", "FROM _lookups_part"))


@query(f"SELECT id FROM ({_NODE}) WHERE contains(lower(name), 'ring') OR contains(lower(qname), 'ring') OR contains(lower(file), 'ring')")
def p13_found(spark, sf):
    return L.found(_nodes(spark, sf), "RING").select("id")


@query(f"SELECT id FROM ({_NODE}) WHERE '7' IN (CAST(id AS VARCHAR), name, qname, file) OR ends_with(file, '/7')")
def p13_targets(spark, sf):
    return L.targets(_nodes(spark, sf).withColumn("id", F.col("id").cast("string")), "7").select(F.col("id").cast("long").alias("id"))


@query("""SELECT o_orderkey, coalesce(k.price, t.price) AS price FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'big' WHEN 2 THEN 'c' ELSE 'zz' END AS m FROM orders) o
 LEFT JOIN (VALUES ('a', 1.5::DOUBLE), ('b', 2.5), ('c', 4.0)) AS k(key, price) ON m = k.key LEFT JOIN (VALUES ('big', 2.5::DOUBLE), ('small', 1.5)) AS t(tier, price) ON m = t.tier""")
def p21_priced(spark, sf):
    p = spark.createDataFrame([("a", "small", 1.5), ("b", "big", 2.5), ("c", "big", 4.0)], "key string, tier string, price double")
    o = read(spark, sf, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'big' WHEN 2 THEN 'c' ELSE 'zz' END AS m")
    return L.priced(o, p, "m").select("o_orderkey", "price")


@query(r"SELECT p_partkey, left(regexp_replace(regexp_replace(lower(concat('--', p_name, ' & ', p_brand, '!')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug, replace(concat('a\', p_type, '\b'), '\', '/') AS path FROM part")
def p20_slug(spark, sf):
    return read(spark, sf, "part").select("p_partkey", L.slug(F.concat(F.lit("--"), "p_name", F.lit(" & "), "p_brand", F.lit("!"))).alias("slug"), L.posix(F.concat(F.lit("a\\"), "p_type", F.lit("\\b"))).alias("path"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 8 AS r, l_tax * 10 AS t, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE (l_partkey % 11) / 10.0::DOUBLE END AS v, l_returnflag = 'A' AS strong FROM lineitem), b AS (SELECT *, greatest(r, t) AS b FROM s)
 SELECT l_orderkey, l_linenumber, round(CASE WHEN v IS NULL THEN b WHEN v >= b THEN v ELSE greatest(v, b - 0.2, CASE WHEN strong THEN least(b, 0.4) ELSE 0 END) END, 6) AS score FROM b""")
def p25_envelope(spark, sf):
    l = read(spark, sf, "lineitem")
    v = F.when(F.col("l_partkey") % 3 != 0, F.expr("(l_partkey % 11) / 10.0D"))
    return l.select("l_orderkey", "l_linenumber", r6(L.envelope(F.col("l_discount") * 8, F.col("l_tax") * 10, v, F.col("l_returnflag") == "A")).alias("score"))


_CODE = "concat('import { a as b, ', replace(p_name, ' ', '_'), ' } from \"x\"; export function ', lower(p_type), '() {} export const K', p_size, ' = 1; export class ', replace(p_name, ' ', '_'), ' {}')"


@query(f"SELECT p_partkey, concat(lower(p_type), ',K', p_size, ',', replace(p_name, ' ', '_')) AS exports, concat('a,', replace(p_name, ' ', '_')) AS imports FROM (SELECT *, {_CODE} AS code FROM part)")
def f13_interface(spark, sf):
    p = read(spark, sf, "part").withColumn("i", L.interface(F.expr(_CODE)))
    return p.select("p_partkey", F.array_join("i.exports", ",").alias("exports"), F.array_join("i.imports", ",").alias("imports"))


_DIFF = "SELECT o_custkey, o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'diff --git a b' WHEN 1 THEN '+++ b/x' WHEN 2 THEN '@@ -1 +1 @@' WHEN 3 THEN concat('+', o_orderpriority) WHEN 4 THEN '-gone' WHEN 5 THEN '+' ELSE ' same' END AS line FROM orders"


@query(f"""SELECT o_custkey, o_orderkey, substr(line, 2) AS text FROM (SELECT *, coalesce(last_value(CASE WHEN starts_with(line, '@@') THEN true WHEN starts_with(line, 'diff --git') THEN false END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), false) AS i FROM ({_DIFF})) WHERE i AND starts_with(line, '+')""")
def f36_added_lines(spark, sf):
    read(spark, sf, "orders").createOrReplaceTempView("_lookups_orders")
    return L.added_lines(spark.sql(_DIFF.replace("FROM orders", "FROM _lookups_orders")), "o_custkey", "o_orderkey", "line")


@query("""WITH f AS (SELECT p_type AS t, concat('f', p_partkey) AS path, sha256(p_name) AS d FROM part), s AS (SELECT t, substr(sha256(path), 1, 2) AS s, sha256(string_agg(concat(path, chr(10), d), chr(10) ORDER BY concat(path, chr(10), d))) AS d FROM f GROUP BY ALL)
 SELECT t, sha256(string_agg(concat(s, ':', d), chr(10) ORDER BY concat(s, ':', d))) AS state FROM s GROUP BY t""")
def f37_tree_digest(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_type").alias("t"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.sha2("p_name", 256).alias("d"))
    return L.tree_digest(p, "t", "path", "d")


_ENT = [("red", False), ("ring", True), ("blue", False), ("PROMO", True), ("gear", False)]
_LINES = "SELECT p_partkey % 60 AS doc, p_partkey AS line, concat(p_name, ' ', p_type, ' (', p_name, ')') AS text, p_size % 3 = 0 AS code FROM part"
_REFS = f"""SELECT entity, doc, line, least(1.0, 0.8 + CASE WHEN bool_or(code) THEN 0.05 ELSE 0 END)::DOUBLE AS confidence FROM (SELECT doc, line, code, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))) AS entity FROM ({_LINES})) w
 JOIN (VALUES {", ".join(f"('{e}', {str(c).lower()})" for e, c in _ENT)}) AS e(entity, code_only) USING (entity) WHERE NOT code_only OR code GROUP BY ALL"""


def _references(spark, sf):
    read(spark, sf, "part").createOrReplaceTempView("_lookups_part")
    return L.references(spark.sql(_LINES.replace("FROM part", "FROM _lookups_part")), spark.createDataFrame(_ENT, "entity string, code_only boolean"))


@query(_REFS)
def f19_references(spark, sf):
    return _references(spark, sf)


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY confidence DESC, line, entity) AS rank FROM ({_REFS})) WHERE rank <= 3")
def t10_ranked_references(spark, sf):
    return L.ranked_references(_references(spark, sf), 3).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH r AS ({_REFS}), d AS (SELECT doc FROM r UNION SELECT p_size AS doc FROM part WHERE p_size % 4 = 0)
 SELECT doc, CASE WHEN doc IN (SELECT doc FROM r WHERE entity = 'gear') THEN 'stale' WHEN doc IN (SELECT p_size FROM part WHERE p_size % 4 = 0) THEN 'updated' WHEN doc IN (SELECT doc FROM r WHERE entity IN ('blue', 'PROMO')) THEN 'stale' ELSE 'unaffected' END AS status FROM d""")
def f35_doc_status(spark, sf):
    one = lambda *e: spark.createDataFrame([(x,) for x in e], "entity string")
    touched = read(spark, sf, "part").where("p_size % 4 = 0").selectExpr("p_size AS doc")
    return L.doc_status(_references(spark, sf), one("blue", "PROMO"), one("gear"), touched)


@query("""WITH n AS (SELECT DISTINCT concat('m', p_size % 5, '.', p_type, '.f', p_size % 9) AS id FROM part), e AS (SELECT p_partkey AS src, CASE p_partkey % 3 WHEN 0 THEN concat('x.', p_type, '.f', p_size % 9) WHEN 1 THEN concat('f', p_size % 9) ELSE concat('m1.', p_type, '.f', p_size % 9) END AS target FROM part),
 c AS (SELECT src, target, id, CASE WHEN target = id THEN 3 WHEN ends_with(target, concat('.', split_part(id, '.', 2), '.', split_part(id, '.', 3))) OR target = concat(split_part(id, '.', 2), '.', split_part(id, '.', 3)) THEN 2 WHEN ends_with(concat('.', target), concat('.', split_part(id, '.', 3))) THEN 1 ELSE 0 END AS common FROM e JOIN n ON ends_with(concat('.', target), concat('.', split_part(id, '.', 3)))),
 b AS (SELECT *, max(common) OVER (PARTITION BY src) AS top FROM c) SELECT src, target, min(id) AS dst, CASE WHEN count(*) = 1 THEN 0.45 ELSE 0.35 END::DOUBLE AS confidence FROM b WHERE common = top GROUP BY src, target""")
def j19_suffix_targets(spark, sf):
    p = read(spark, sf, "part")
    n = p.selectExpr("concat('m', p_size % 5, '.', p_type, '.f', p_size % 9) AS id").distinct()
    e = p.selectExpr("p_partkey AS src", "CASE p_partkey % 3 WHEN 0 THEN concat('x.', p_type, '.f', p_size % 9) WHEN 1 THEN concat('f', p_size % 9) ELSE concat('m1.', p_type, '.f', p_size % 9) END AS target", "0.5D AS confidence")
    return L.suffix_targets(e, n).withColumn("confidence", r6("confidence"))


@query("SELECT p_partkey, p_size % 6 <> 0 AS held FROM part")
def s3_addressed_claims(spark, sf):
    f = read(spark, sf, "part").withColumn("id", F.when(F.col("p_size") % 6 == 0, F.lit("forged")).otherwise(F.sha2("p_name", 256)))
    return L.addressed(f, "id", "p_name").select("p_partkey", F.col("claim").isNotNull().alias("held"))


@query("SELECT DISTINCT o_custkey AS claim_id, o_orderpriority AS h FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) AND (o_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderstatus = 'P')")
def s8_admitted_records(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("claim_id"), F.col("o_orderpriority").alias("h"), "o_orderstatus")
    c = read(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("claim_id"))
    return L.admitted(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'F'"), c).select("claim_id", "h")


@query("""WITH r AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS place, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
 SELECT s_nationkey, concat('- ', s_name) AS line, place FROM r WHERE place <= 2 UNION ALL SELECT s_nationkey, concat('- (+', n - 2, ' more)'), place FROM r WHERE place = 3""")
def s17_index_lines(spark, sf):
    i = L.index_lines(read(spark, sf, "supplier"), "s_nationkey", "s_name", cap=2)
    return i.withColumn("place", F.col("place").cast("long"))


@query("SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'ECONOMY')")
def j15_kind_in_set(spark, sf):
    kinds = spark.createDataFrame([("PROMO",), ("ECONOMY",)], "p_type string")
    return read(spark, sf, "part").join(F.broadcast(kinds), "p_type", "left_semi").select("p_partkey", "p_type")


@query("""SELECT user_id, round(sum(value * pow(0.5, date_diff('hour', ts, (SELECT max(ts) FROM events)) / 24.0)), 4) AS weight FROM events GROUP BY user_id""")
def x11_decayed_weight(spark, sf):
    e = read(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    hours = F.expr("(unix_seconds(date_trunc('hour', now)) - unix_seconds(date_trunc('hour', ts))) / 3600")
    return e.join(F.broadcast(now)).groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.pow(F.lit(0.5), hours / 24.0)), 4).alias("weight"))
