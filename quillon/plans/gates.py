"""Queries on gates, consensus, promotion, upkeep and merge impact, each with the SQL that states it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import ledger, merge, metrics
from ..operators import upkeep as K
from .catalog import _CONF, CLAIMS, EVIDENCE, NOW, WEIGHTS, _conf_sql, claims, evidence, query, r6, read

_PATH = "CASE p_partkey % 9 WHEN 0 THEN concat('src/', p_brand, '.js') WHEN 1 THEN concat('docs/', p_partkey, '.md') WHEN 2 THEN 'test/a.test.js' WHEN 3 THEN 'ci/x.yml' WHEN 4 THEN '.ledger/tmp' WHEN 5 THEN '.ledger/state.md' WHEN 6 THEN 'AGENTS.md' WHEN 7 THEN 'lib/test_b.py' ELSE concat('bin/', p_name) END"
_CLASS = f"CASE WHEN path IN {tuple(G.STATE_FOLDER + f for f in G.STATE_FILES)} THEN 'docs' WHEN starts_with(path, '.ledger/') OR regexp_matches(path, '(?i)(^|/)(agents|claude|gemini)\\.md$') THEN 'internal' WHEN ends_with(path, '.md') THEN 'docs' WHEN regexp_matches(path, '{G.TESTS}') THEN 'test' WHEN regexp_matches(path, '{G.CONFIGS}') THEN 'config' WHEN regexp_matches(path, '{G.CODE}') THEN 'code' ELSE 'other' END"
_PARTS = f"SELECT p_partkey, CAST(floor(p_partkey / 4) AS BIGINT) AS g, p_size, {_PATH} AS path, p_partkey % 13 = 0 AS flag FROM part"


def _parts(spark, sf):
    read(spark, sf, "part").createOrReplaceTempView("_gates_part")
    return spark.sql(_PARTS.replace("FROM part", "FROM _gates_part"))


@query(f"SELECT p_partkey, {_CLASS} AS class FROM ({_PARTS})")
def p10_path_class(spark, sf):
    return _parts(spark, sf).select("p_partkey", G.path_class(F.col("path")).alias("class"))


@query(f"""WITH c AS (SELECT g, {_CLASS} AS c, flag, path FROM ({_PARTS})), n AS (SELECT g, count(*) FILTER (c = 'code') AS code, count(*) FILTER (c = 'test') AS test, count(*) FILTER (c = 'config') AS config, count(*) FILTER (c = 'docs') AS docs, count(*) FILTER (c = 'internal') AS internal, count(*) AS a, bool_or(flag) AS v FROM c GROUP BY g),
 r AS (SELECT g, CASE WHEN a = internal THEN 'no-changes' WHEN code > 0 AND NOT v AND test = 0 THEN 'code-without-test-evidence' WHEN code > 0 AND docs = 0 THEN 'code-without-docs' WHEN code > 0 THEN 'code-with-evidence' WHEN test > 0 AND config = 0 THEN 'test-only' WHEN config > 0 AND docs = 0 THEN 'config-without-docs' WHEN docs > 0 THEN 'docs-touched' ELSE 'no-code-class' END AS row FROM n)
 SELECT g, row NOT IN ('code-without-test-evidence', 'code-without-docs', 'config-without-docs') AS allow, row FROM r""")
def p14_stop_gate(spark, sf):
    return G.stop_gate(_parts(spark, sf).withColumn("state", F.lit(False)), "g", "path", "flag", "state")


@query(f"""SELECT g, CASE WHEN bool_or(flag) OR (count(*) FILTER (c = 'code') > 0 AND count(*) FILTER (c = 'docs') = 0) THEN 'blocked' ELSE 'clean' END AS row FROM (SELECT g, flag, {_CLASS} AS c FROM ({_PARTS})) GROUP BY g""")
def p14_commit_gate(spark, sf):
    return G.commit_gate(_parts(spark, sf), "g", "path", "flag", mode="block")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'underspecified' WHEN o_orderkey % 5 = 0 AND o_custkey % 3 > 0 THEN 'context' WHEN o_custkey % 40 >= 25 AND o_orderkey % 2 = 0 THEN 'blast' END AS reason FROM orders")
def p15_enforced(spark, sf):
    o = read(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select("o_orderkey", G.enforced(k % 17 == 0, k % 5 != 0, c % 3, k % 2 == 0, c % 40).alias("reason"))


_LENS = "SELECT user_id, CASE event_id % 8 WHEN 0 THEN 'tests' WHEN 1 THEN 'symbols' WHEN 2 THEN 'impact' WHEN 3 THEN 'docsdrift' WHEN 4 THEN 'secrets' WHEN 5 THEN 'speclock' WHEN 6 THEN 'reviewer' ELSE 'odd' END AS lens, event_id % 3 <> 0 AS ran, CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END * CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.5 END AS s FROM events"
_LENS_TABLE = "(VALUES " + ", ".join(f"('{k}', {w}::DOUBLE, '{f}', {str(solo).lower()})" for k, (w, f, solo) in G.LENSES.items()) + ") AS t(lens, w, fam, solo)"


@query(f"""WITH e AS (SELECT user_id, w, fam, solo, CAST(s AS DOUBLE) AS s FROM ({_LENS}) JOIN {_LENS_TABLE} USING (lens) WHERE ran), g AS (SELECT user_id, 1 - product(1 - w * s) AS p, count(DISTINCT CASE WHEN s > 0 THEN fam END) AS families, product(1 - w) AS residual, bool_or(s > 0 AND solo) AS solo FROM e GROUP BY user_id)
 SELECT user_id, round(p, 6) AS p, families, round(residual, 9) AS residual, CASE WHEN (families >= 2 OR solo) AND p >= 0.5 THEN 'block' WHEN p > 0 THEN 'advise' ELSE 'pass' END AS status FROM g""")
def m5_consensus(spark, sf):
    read(spark, sf, "events").createOrReplaceTempView("_gates_events")
    e = spark.sql(_LENS.replace("FROM events", "FROM _gates_events")).withColumn("s", F.col("s").cast("double"))
    c = G.consensus(e, "user_id")
    return c.select("user_id", r6("p").alias("p"), "families", F.round("residual", 9).alias("residual"), "status")


@query("SELECT event_id, 'tests' AS lens, event_type IN ('error', 'click') AS ran, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END::DOUBLE AS s FROM events")
def p24_lens_rows(spark, sf):
    e = read(spark, sf, "events")
    row = G.lens_row("tests", F.col("event_type").isin("error", "click"), F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
    return e.select("event_id", row.alias("r")).select("event_id", "r.*")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 AND value >= 70 THEN 'distill' WHEN value >= 40 THEN 'accumulate' ELSE 'discard' END AS class FROM events")
def p17_mistake_class(spark, sf):
    return read(spark, sf, "events").select("event_id", G.mistake_class(F.col("value") / 100, F.col("event_id") % 3 == 0).alias("class"))


_WORDS = "len(list_filter(string_split(p_name || ' ' || p_type, ' '), lambda w: w <> ''))"


@query(f"""WITH s AS (SELECT p_partkey, p_size % 3 AS c, p_partkey % 2 AS sp, p_size % 2 AS v, {_WORDS} + p_size AS w FROM part), z AS (SELECT *, 1 / (1 + exp(-(-0.858 + 1.44 * c + 0.5 * sp - 1.3 * v + 0.6 * tanh((w - 12) / 12)))) AS z FROM s)
 SELECT p_partkey, round(z, 6) AS completeness, z < 0.6 OR (c = 0 AND (w <= 10 OR (v >= 1 AND sp = 0))) AS ask, CASE WHEN z < 0.45 THEN 'high' WHEN z < 0.7 THEN 'medium' ELSE 'low' END AS risk FROM z""")
def f21_completeness(spark, sf):
    p = read(spark, sf, "part").withColumn("w", F.size(F.filter(F.split(F.concat_ws(" ", "p_name", "p_type"), " "), lambda w: w != "")) + F.col("p_size"))
    c, sp, v, w = F.col("p_size") % 3, F.col("p_partkey") % 2, F.col("p_size") % 2, F.col("w")
    p = p.withColumn("z", G.completeness({"concreteness": c, "specifics": sp, "vagueness": v, "length": G.length_signal(w)}))
    z = F.col("z")
    return p.select("p_partkey", r6("z").alias("completeness"), G.must_ask(z, c, w, v, sp).alias("ask"), F.when(z < 0.45, "high").when(z < 0.7, "medium").otherwise("low").alias("risk"))


@query("SELECT l_orderkey, l_linenumber, round(least(1, l_quantity / 10), 6)::DOUBLE AS caller_fanout, round(least(1, l_linenumber / 10), 6)::DOUBLE AS churn, CASE WHEN l_returnflag = 'A' THEN 0.0 ELSE 1.0 END::DOUBLE AS test_coverage_gap, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS signature_change, CASE WHEN l_linestatus = 'F' AND l_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS no_caller_update FROM lineitem")
def f29_edit_features(spark, sf):
    l = read(spark, sf, "lineitem")
    f = G.edit_features(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_returnflag") == "A", F.col("l_linestatus") == "F", F.col("l_partkey") % 2 != 0)
    return l.select("l_orderkey", "l_linenumber", f.alias("f")).select("l_orderkey", "l_linenumber", r6("f.caller_fanout").alias("caller_fanout"), r6("f.churn").alias("churn"), "f.test_coverage_gap", "f.signature_change", "f.no_caller_update")


@query("""WITH m AS (SELECT o_custkey, count(*) AS n, avg(abs(o_totalprice - 150000)) AS b, avg(abs(o_totalprice - 140000 - 1000 * (o_custkey % 30))) AS c FROM orders GROUP BY o_custkey)
 SELECT o_custkey, CASE WHEN n >= 12 AND c <= b - 100 THEN 'candidate' ELSE 'baseline' END AS mode FROM m""")
def m3_promotion(spark, sf):
    p = F.col("o_totalprice")
    m = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg(F.abs(p - 150000)).alias("b"), F.avg(F.abs(p - 140000 - 1000 * (F.col("o_custkey") % 30))).alias("c"))
    return m.select("o_custkey", G.promoted(F.col("n"), F.col("b"), F.col("c"), margin=100, least=12).alias("mode"))


_AP = "SELECT user_id, count(*) AS n, sum(CASE WHEN y THEN hits / k END) / sum(CASE WHEN y THEN 1 ELSE 0 END) AS ap FROM (SELECT user_id, y, sum(CASE WHEN y THEN 1 ELSE 0 END) OVER w AS hits, row_number() OVER w AS k FROM (SELECT user_id, event_id, event_type = 'error' AS y, {s} AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s DESC, event_id ROWS UNBOUNDED PRECEDING)) GROUP BY user_id"


@query(f"""SELECT user_id, CASE WHEN h.n < 20 THEN 'heuristic' WHEN round(h.ap, 9) < 0.2 THEN 'disabled' WHEN round(l.ap, 9) >= round(h.ap, 9) + 0.05 THEN 'learned' ELSE 'heuristic' END AS mode FROM ({_AP.format(s="value")}) h JOIN ({_AP.format(s="event_id * 7919 % 1000")}) l USING (user_id)""")
def m2_kill_criteria(spark, sf):
    e = read(spark, sf, "events").select("user_id", F.col("event_id").alias("ord"), F.col("value").alias("h"), (F.col("event_id") * 7919 % 1000).alias("l"), (F.col("event_type") == "error").cast("int").alias("label"))
    ap = {c: metrics.average_precision(e.withColumn("score", F.col(c)), "user_id").select("user_id", F.round("ap", 9).alias(c)) for c in "hl"}
    g = e.groupBy("user_id").agg(F.count("*").alias("n")).join(ap["h"], "user_id").join(ap["l"], "user_id")
    return g.select("user_id", G.kill_criteria(F.col("n"), F.col("h"), F.col("l"), floor=0.2).alias("mode"))


@query("SELECT CAST(floor(event_id / 4) AS BIGINT) AS run, bool_and(event_type <> 'error') AS ok FROM events GROUP BY 1")
def a29_all_ok(spark, sf):
    e = read(spark, sf, "events").select(F.floor(F.col("event_id") / 4).alias("run"), (F.col("event_type") != "error").alias("good"))
    return G.all_ok(e, "run", "good")


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS warnings, count(*) FILTER (event_type = 'error') = 0 AS ok FROM events GROUP BY user_id")
def a38_docs_roll_up(spark, sf):
    e = read(spark, sf, "events").withColumn("severity", F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "warning").otherwise("info"))
    return G.roll_up(e, "user_id", "severity")


@query("SELECT * FROM (SELECT user_id, event_type, k, row_number() OVER (PARTITION BY user_id ORDER BY f) AS rank FROM (SELECT user_id, event_type, CAST(floor(value / 10) AS BIGINT) AS k, min(event_id) AS f FROM events GROUP BY ALL)) WHERE rank <= 5")
def a31_first_assumptions(spark, sf):
    e = read(spark, sf, "events").withColumn("k", F.floor(F.col("value") / 10))
    return G.first_distinct(e, "user_id", "event_id", ["event_type", "k"]).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT o_orderkey, (SELECT max(o_orderkey) + 1 FROM orders) AS next_id FROM orders ORDER BY o_orderkey DESC LIMIT 20")
def a32_latest_decisions(spark, sf):
    return G.latest(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 20)


@query("SELECT count(*) FILTER (t AND s) AS tp, count(*) FILTER (NOT t AND s) AS fp, count(*) FILTER (t AND NOT s) AS fn, count(*) FILTER (NOT t AND NOT s) AS tn, round(1 - sum(c) / sum(p), 6) AS saved FROM (SELECT o_orderstatus = 'F' AS t, o_totalprice > 200000 AS s, o_orderkey % 7 + 1 AS c, 9 AS p FROM orders)")
def a34_confusion(spark, sf):
    o = read(spark, sf, "orders").selectExpr("o_orderstatus = 'F' AS t", "o_totalprice > 200000 AS s", "o_orderkey % 7 + 1 AS c", "9 AS p")
    return G.confusion(o, "t", "s", "c", "p").withColumn("saved", r6("saved"))


@query("SELECT s_nationkey, CASE WHEN max(lines) > 800 OR count(*) > 50 THEN 'high' WHEN max(lines) > 300 OR count(*) > 15 THEN 'medium' ELSE 'low' END AS band FROM (SELECT s_nationkey, s_suppkey * 131 % 900 AS lines FROM supplier) GROUP BY s_nationkey")
def a35_size_risk(spark, sf):
    g = read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.max(F.col("s_suppkey") * 131 % 900).alias("m"), F.count("*").alias("n"))
    return g.select("s_nationkey", G.size_risk(F.col("m"), F.col("n")).alias("band"))


@query("SELECT k, CASE WHEN a IS NULL THEN 'undocumented' WHEN b IS NULL THEN 'phantom' ELSE 'ok' END AS state FROM (SELECT DISTINCT o_custkey AS k, 1 AS a FROM orders) FULL JOIN (SELECT DISTINCT c_custkey * 2 AS k, 1 AS b FROM customer) USING (k)")
def j18_reconciled(spark, sf):
    return G.reconciled(read(spark, sf, "orders").selectExpr("o_custkey AS k"), read(spark, sf, "customer").selectExpr("c_custkey * 2 AS k"), "k")


@query("SELECT k, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT p_partkey AS k, sha256(p_name) AS x FROM part WHERE p_partkey % 5 <> 0) FULL JOIN (SELECT p_partkey AS k, sha256(CASE WHEN p_size > 40 THEN p_type ELSE p_name END) AS y FROM part WHERE p_partkey % 7 <> 0) USING (k) WHERE x IS DISTINCT FROM y")
def g2_stale(spark, sf):
    p = read(spark, sf, "part").withColumnRenamed("p_partkey", "k")
    new = F.when(F.col("p_size") > 40, F.col("p_type")).otherwise(F.col("p_name"))
    return G.stale(p.where("k % 5 <> 0").withColumn("d", F.sha2("p_name", 256)), p.where("k % 7 <> 0").withColumn("d", F.sha2(new, 256)), "k", "d")


@query(r"""WITH t AS (SELECT p_partkey, concat('f(a,b,', p_name, ')') AS a, concat('f( a, b, ', CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END, ', )') AS b FROM part), u AS (SELECT p_partkey, regexp_replace(regexp_replace(a, '\s+', '', 'g'), ',([)\]}])', '\1', 'g') AS a, regexp_replace(regexp_replace(b, '\s+', '', 'g'), ',([)\]}])', '\1', 'g') AS b FROM t) SELECT p_partkey, a = b AND a <> '' AS same FROM u""")
def f11_formatting_only(spark, sf):
    p = read(spark, sf, "part").selectExpr("p_partkey", "concat('f(a,b,', p_name, ')') AS a", "concat('f( a, b, ', CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END, ', )') AS b")
    return p.select("p_partkey", G.formatting_only(F.col("a"), F.col("b")).alias("same"))


@query(r"""SELECT p_partkey, replace(regexp_replace(lower(trim(concat(' ', p_name, ' & <', p_brand, '> '))), '[^a-z0-9 _-]', '', 'g'), ' ', '-') AS slug, replace(replace(replace(concat(p_name, ' & <', p_brand, '>'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html,
 array_to_string(list_sort(list_distinct(regexp_extract_all(concat('use `', replace(p_name, ' ', '_'), '()` or `', p_type, '` and `a b`'), '`([A-Za-z_][A-Za-z0-9_]*)(?:\(\))?`', 1))), ',') AS names FROM part""")
def f16_slugs(spark, sf):
    p = read(spark, sf, "part")
    text = F.expr("concat('use `', replace(p_name, ' ', '_'), '()` or `', p_type, '` and `a b`')")
    names = F.array_join(F.array_sort(G.quoted_names(text)), ",")
    return p.select("p_partkey", G.slug(F.expr("concat(' ', p_name, ' & <', p_brand, '> ')")).alias("slug"), G.escaped(F.expr("concat(p_name, ' & <', p_brand, '>')")).alias("html"), names.alias("names"))


@query("SELECT l_returnflag, round(sum((l_quantity * 1000 * 3 + l_linenumber * 100 * 15) / 1e6), 4) AS cost FROM lineitem GROUP BY l_returnflag")
def f32_token_cost(spark, sf):
    c = G.token_cost(F.col("l_quantity") * 1000, F.col("l_linenumber") * 100, F.lit(3.0), F.lit(15.0))
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(c), 4).alias("cost"))


# --- upkeep ---------------------------------------------------------------------


@query(f"""WITH v AS (SELECT c.claim_id, coalesce(val, 0.5) AS val FROM ({CLAIMS}) c LEFT JOIN {_conf_sql(NOW)} USING (claim_id))
 SELECT CASE claim_id % 3 WHEN 0 THEN 'lesson' WHEN 1 THEN 'fact' ELSE 'summary' END AS kind, CASE WHEN val < 0.35 THEN 'dormant' WHEN val < 0.65 THEN 'uncertain' ELSE 'trusted' END AS bucket, count(*) AS n, count(*) FILTER (claim_id % 11 = 0) AS tombstoned FROM v GROUP BY ALL""")
def a7_ledger_stats(spark, sf):
    v = ledger.confidence(evidence(spark, sf), NOW, claims=claims(spark, sf))
    return K.stats(v.selectExpr("CASE claim_id % 3 WHEN 0 THEN 'lesson' WHEN 1 THEN 'fact' ELSE 'summary' END AS kind", "val", "claim_id % 11 = 0 AS tombstone"))


@query(f"""SELECT c.claim_id, round(coalesce(val, 0.5), 6) AS val FROM ({CLAIMS}) c LEFT JOIN {_conf_sql(NOW)} USING (claim_id)
 WHERE c.claim_id % 11 <> 0 AND coalesce(val, 0.5) BETWEEN 0.4 AND 0.6 AND c.claim_id IN (SELECT claim_id FROM ({EVIDENCE}) JOIN {WEIGHTS} USING (oracle) WHERE result = 'contradict')""")
def a15_contested(spark, sf):
    c = claims(spark, sf).withColumn("tombstone", F.col("claim_id") % 11 == 0)
    return K.contested(c, evidence(spark, sf), NOW).select("claim_id", r6("val").alias("val"))


_RATES = f"""SELECT c.author, greatest(0.5, (coalesce(sum(CASE WHEN result = 'confirm' THEN w WHEN w IS NULL THEN NULL ELSE 0 END), 0) + 2) / (coalesce(sum(w), 0) + 2)) AS trust
 FROM ({CLAIMS}) c LEFT JOIN (SELECT e.claim_id, e.author AS by, result, w FROM ({EVIDENCE}) e JOIN {WEIGHTS} USING (oracle)) x ON c.claim_id = x.claim_id AND c.author <> x.by GROUP BY c.author"""
_TRUSTED = _CONF.replace("CASE WHEN resolved THEN 1.0 ELSE 0.5 END AS d", "CASE WHEN resolved THEN 1.0 ELSE 0.5 END * coalesce(rates.trust, 1.0) AS d").replace("{where}", f"LEFT JOIN ({_RATES}) rates ON rates.author = e.author").format(day=NOW, src=EVIDENCE, weights=WEIGHTS)


@query(f"""SELECT c.claim_id, c.author, round(coalesce(a.val, 0.5), 6) AS val, round(coalesce(b.val, 0.5), 6) AS trusted_val, coalesce(n, 0) AS records FROM ({CLAIMS}) c LEFT JOIN {_conf_sql(NOW)} a USING (claim_id) LEFT JOIN {_TRUSTED} b USING (claim_id)
 LEFT JOIN (SELECT claim_id, count(*) AS n FROM ({EVIDENCE}) GROUP BY claim_id) USING (claim_id)""")
def a36_blame(spark, sf):
    return K.blamed(claims(spark, sf), evidence(spark, sf), NOW).select("claim_id", "author", r6("val").alias("val"), r6("trusted_val").alias("trusted_val"), "records")


@query("""WITH p AS (SELECT o_custkey AS claim_id, o_orderkey AS t, o_orderpriority AS author, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, sha256(CAST(o_orderkey AS VARCHAR))) AS n FROM orders)
 SELECT c_custkey AS claim_id, t AS minted, author, retracted FROM customer LEFT JOIN p ON claim_id = c_custkey AND n = 1 LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS retracted FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) x ON x.o_custkey = c_custkey""")
def j2_live_view(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("t"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h"), F.col("o_orderpriority").alias("author"), "o_orderstatus")
    return K.live_view(read(spark, sf, "customer").select(F.col("c_custkey").alias("claim_id")), o, o.where("o_orderstatus = 'P'"))


_BODY = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'lesson' WHEN 2 THEN 'odd' ELSE 'summary' END AS kind, CASE WHEN p_size = 7 THEN NULL WHEN p_size = 8 THEN concat('token: ', p_name) ELSE p_name END AS body, p_type AS note FROM part"


@query(rf"""WITH b AS ({_BODY}), r AS (SELECT *, CASE WHEN kind = 'odd' THEN 'unknown claim kind: odd' WHEN body IS NULL THEN 'claim body must be an object' WHEN regexp_matches(body, '(?i)(token|secret|password)\s*[:=]') THEN 'refused: looks like a secret' END AS reason FROM b)
 SELECT p_partkey, reason, CASE WHEN reason IS NULL THEN sha256(concat(kind, chr(10), body)) END AS id FROM r""")
def p3_minted(spark, sf):
    read(spark, sf, "part").createOrReplaceTempView("_gates_part")
    return K.minted(spark.sql(_BODY.replace("FROM part", "FROM _gates_part"))).select("p_partkey", "reason", "id")


@query(f"SELECT p_partkey, CASE kind WHEN 'lesson' THEN concat_ws(' ', nullif(body, ''), note) WHEN 'fact' THEN concat_ws(' ', 'n', body) ELSE coalesce(body, note) END AS text FROM ({_BODY})")
def p7_claim_text(spark, sf):
    read(spark, sf, "part").createOrReplaceTempView("_gates_part")
    b = spark.sql(_BODY.replace("FROM part", "FROM _gates_part"))
    return b.select("p_partkey", K.claim_text(F.col("kind"), F.lit("n"), F.col("body"), F.col("note")).alias("text"))


@query("""WITH c AS (SELECT sha256(CAST(c_custkey AS VARCHAR)) AS id, c_custkey % 300 AS minted, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 310 END AS retracted FROM customer)
 SELECT * FROM (SELECT minted AS day, 'mint' AS type, substr(id, 1, 8) AS id8 FROM c UNION ALL SELECT retracted, 'retract', substr(id, 1, 8) FROM c WHERE retracted IS NOT NULL) ORDER BY day DESC, id8, type LIMIT 60""")
def t7_timeline(spark, sf):
    c = read(spark, sf, "customer")
    return K.timeline(c.select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("id"), (F.col("c_custkey") % 300).alias("minted"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") % 310).alias("retracted")))


@query(f"SELECT event_id AS id, CASE WHEN event_id % 19 = 0 THEN 'missing hash' WHEN event_id % 23 = 0 THEN 'content hash mismatch' ELSE 'invalid outcome' END AS issue FROM ({EVIDENCE}) WHERE event_id % 19 = 0 OR event_id % 23 = 0 OR oracle = 'typecheck'")
def u7_issues(spark, sf):
    digest = F.sha2(F.concat_ws("|", "id", "result"), 256)
    log = evidence(spark, sf).withColumnRenamed("event_id", "id")
    log = log.withColumn("h", F.when(F.col("id") % 19 == 0, F.lit(None)).when(F.col("id") % 23 == 0, "bad").otherwise(digest))
    return K.issues(log, digest, [o for o in ledger.ORACLE_WEIGHTS if o != "typecheck"])


@query(f"WITH e AS (SELECT claim_id, event_id FROM ({EVIDENCE})), r AS (SELECT DISTINCT claim_id AS b, claim_id + 100000 AS a FROM e WHERE claim_id % 10 = 0) SELECT claim_id, count(*) AS n FROM (FROM e UNION SELECT a, event_id FROM e JOIN r ON claim_id = b) GROUP BY claim_id")
def u9_rekeyed(spark, sf):
    e = evidence(spark, sf).select("claim_id", "event_id")
    r = e.where("claim_id % 10 = 0").select(F.col("claim_id").alias("before"), (F.col("claim_id") + 100000).alias("after")).distinct()
    return K.rekeyed(e, r)[0].groupBy("claim_id").agg(F.count("*").alias("n"))


@query(f"SELECT claim_id FROM ({CLAIMS}) WHERE author = 'a3' AND claim_id NOT IN (SELECT o_custkey FROM orders)")
def u10_unbacked(spark, sf):
    c = claims(spark, sf).withColumn("name", F.col("claim_id"))
    return K.unbacked(c, read(spark, sf, "orders").select(F.col("o_custkey").alias("name")), "a3").select("claim_id")


@query("SELECT c_custkey, 500 - n AS t FROM customer, range(6) AS r(n) WHERE n < c_custkey % 7 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def u11_imported(spark, sf):
    c = read(spark, sf, "customer").selectExpr("c_custkey", "c_custkey % 7 AS k", "500 AS day")
    return K.imported(c, read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "k", "day").withColumn("t", F.col("t").cast("long"))


@query(f"SELECT DISTINCT claim_id, t FROM ({EVIDENCE}) WHERE event_id % 3 <> 1 AND (claim_id, t) NOT IN (SELECT (claim_id, t) FROM ({EVIDENCE}) WHERE event_id % 3 <> 0)")
def u12_ratified(spark, sf):
    e = evidence(spark, sf).select("event_id", "claim_id", "t")
    return K.appended(e.where("event_id % 3 <> 0"), e.where("event_id % 3 <> 1"), ["claim_id", "t"]).select("claim_id", F.col("t").cast("long").alias("t"))


_HOOK = "SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN 'Edit' WHEN 1 THEN 'Bash' WHEN 2 THEN 'Write' WHEN 3 THEN NULL ELSE 'Read' END AS tool, CASE WHEN event_id % 15 = 3 THEN 'UserPromptSubmit' END AS hook, CASE WHEN event_id % 20 = 8 THEN concat('ask  ', event_type) END AS prompt, concat('f', event_id % 12) AS file FROM events"


@query(f"SELECT event_id, CASE WHEN tool IN ('Edit', 'Write') THEN 'edit' WHEN tool = 'Bash' THEN 'bash' WHEN hook = 'UserPromptSubmit' OR prompt IS NOT NULL THEN 'prompt' END AS type FROM ({_HOOK})")
def x3_event_kind(spark, sf):
    read(spark, sf, "events").createOrReplaceTempView("_gates_events")
    return spark.sql(_HOOK.replace("FROM events", "FROM _gates_events")).select("event_id", K.event_kind(F.col("tool"), F.col("hook"), F.col("prompt")).alias("type"))


@query(rf"""WITH e AS (SELECT *, CASE WHEN tool IN ('Edit', 'Write') THEN 'edit' WHEN tool = 'Bash' THEN 'bash' WHEN prompt IS NOT NULL THEN 'prompt' END AS type FROM ({_HOOK})),
 g AS (SELECT user_id AS sid, arg_min(regexp_replace(prompt, '\s+', ' ', 'g'), event_id) FILTER (type = 'prompt') AS gist, list_sort(list(DISTINCT file) FILTER (type = 'edit')) AS files, bool_or(type = 'bash' AND event_id % 2 = 0) AS tested FROM e GROUP BY user_id)
 SELECT sid, coalesce(gist, concat('touched ', array_to_string(files, ', '))) AS text, coalesce(array_to_string(files, ','), '') AS files, coalesce(tested, false) AS tested FROM g WHERE gist IS NOT NULL OR len(files) > 0""")
def x9_session_summary(spark, sf):
    read(spark, sf, "events").createOrReplaceTempView("_gates_events")
    e = spark.sql(_HOOK.replace("FROM events", "FROM _gates_events"))
    e = e.withColumn("type", K.event_kind(F.col("tool"), F.lit(None).cast("string"), F.col("prompt")))
    return K.session_summaries(e.select(F.col("user_id").alias("sid"), F.col("event_id").alias("seq"), "type", "file", F.col("prompt").alias("text"), ((F.col("type") == "bash") & (F.col("event_id") % 2 == 0)).alias("tested")))


@query("SELECT user_id, max(ts) AS last FROM events GROUP BY user_id HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def x10_retained(spark, sf):
    e = read(spark, sf, "events")
    s = e.groupBy("user_id").agg(F.max("ts").alias("last")).join(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    return K.retained(s, "last", F.col("now")).drop("now")


@query("SELECT l_returnflag, l_orderkey, l_linenumber, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n IN (250, 500, 1000, 2000)")
def x12_checkpoint_calls(spark, sf):
    c = K.checkpoint_calls(read(spark, sf, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"])
    return c.select("l_returnflag", "l_orderkey", "l_linenumber", F.col("n").cast("long").alias("n"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def w14_newest(spark, sf):
    return K.newest(read(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j10_semi(spark, sf):
    o = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def u5_intersect(spark, sf):
    o = read(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


# --- merge impact -----------------------------------------------------------------

_KINDS = ("imports", "calls", "verified_by", "documented_by", "configures", "publishes")
_REL = f"SELECT concat('n', n_nationkey) AS src, concat('n', (n_nationkey * 3 + 1) % 25) AS dst, CASE n_nationkey % 6 {' '.join(f'WHEN {i} THEN {chr(39)}{k}{chr(39)}' for i, k in enumerate(_KINDS))} END AS kind, 0.5 + 0.02 * n_nationkey AS confidence FROM nation UNION ALL SELECT concat('n', n_nationkey), concat('n', (n_nationkey * 7 + 2) % 25), 'calls', 0.9 FROM nation"
_SEEDS = [("n0", "runtime", 0.8), ("n0", "contract", 0.5), ("n7", "config", 0.9), ("n7", "contract", 0.3)]
_FIELD = f"""m AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{t}', '{s}', {w}::DOUBLE)" for k, t, s, w in merge.CARRIES)}) AS m(kind, dim2, dim, w)),
 st AS (SELECT src, dst, dim, dim2, max(w * CAST(confidence AS DOUBLE) * 0.9) AS w FROM ({_REL}) JOIN m USING (kind) GROUP BY ALL),
 sg AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{d}', {v}::DOUBLE)" for a, d, v in _SEEDS)}) AS s(seed, dim, v)),
 r AS (SELECT seed, seed AS artifact, dim, v, 0 AS hops FROM sg UNION ALL SELECT seed, dst, dim2, max(v * st.w), hops + 1 FROM r JOIN st ON r.artifact = st.src AND r.dim = st.dim WHERE hops < 30 GROUP BY seed, dst, dim2, hops),
 f AS (SELECT seed, artifact, dim, max(v) AS v FROM r GROUP BY ALL HAVING max(v) > 0.001)"""


def _merge_field(spark, sf):
    read(spark, sf, "nation").createOrReplaceTempView("_gates_nation")
    rel = spark.sql(_REL.replace("FROM nation", "FROM _gates_nation")).withColumn("confidence", F.col("confidence").cast("double"))
    signals = spark.createDataFrame(_SEEDS, "seed string, dim string, v double")
    return signals, rel, merge.field(signals, rel)


@query(f"WITH RECURSIVE {_FIELD} SELECT seed, artifact, dim, round(v, 3) AS v FROM f WHERE v > 0.01")
def g7_merge_field(spark, sf):
    return _merge_field(spark, sf)[2].where("v > 0.01").withColumn("v", F.round("v", 3))


@query(None)
def a20_merge_summary(spark, sf):
    signals, rel, found = _merge_field(spark, sf)
    artifacts = read(spark, sf, "nation").selectExpr("concat('n', n_nationkey) AS artifact", "CASE n_nationkey % 4 WHEN 0 THEN 'source' WHEN 1 THEN 'test' WHEN 2 THEN 'documentation' ELSE 'config' END AS kind", "n_nationkey / 25 AS criticality")
    s = merge.summary(merge.impacted(found, artifacts), signals, rel)
    return s.select(*[F.round(c, 4).alias(c) for c in ("peak", "breadth", "uncertainty", "gap", "risk")], "level")


@query("""WITH e AS (SELECT concat('a.b.s', l_suppkey) AS src, CASE WHEN l_linenumber % 2 = 0 THEN concat('s', (l_partkey + 1) % 50) ELSE concat('a.b.s', (l_partkey + 1) % 50) END AS dst, l_discount AS w FROM lineitem)
 SELECT src, d AS dst, max(w) AS w FROM (SELECT src, CASE WHEN starts_with(dst, 's') THEN concat('a.b.', dst) ELSE dst END AS d, w FROM e) WHERE src <> d GROUP BY ALL""")
def g16_phantoms(spark, sf):
    e = read(spark, sf, "lineitem").selectExpr("concat('a.b.s', l_suppkey) AS src", "CASE WHEN l_linenumber % 2 = 0 THEN concat('s', (l_partkey + 1) % 50) ELSE concat('a.b.s', (l_partkey + 1) % 50) END AS dst", "l_discount AS w")
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("phantom", F.col("id").startswith("s"))
    return merge.phantom_merged(nodes, e)
