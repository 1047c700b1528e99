"""Queries on retrieval, votes, lessons and ranks, each with the SQL that states it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import retrieval as R
from .catalog import NOW, query, r6, read

STOP = ("the", "of", "small")
BANK = [("hard", 0.9, "red rings promo"), ("easy", 0.1, "blue widget economy"), ("mid", 0.5, "small ring standard"), ("hard", 0.8, "green gear of brand"), ("easy", 0.2, "the widget")]
_TASK = "concat(p_name, ' ', lower(p_type), ' brands', CASE p_partkey % 5 WHEN 0 THEN ' must ensure step 2' WHEN 1 THEN ' ```x``` and then' ELSE '' END)"


def _grams_sql(text: str) -> str:
    words = f"list_transform(list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN {STOP}), lambda t: CASE WHEN length(t) > 3 AND ends_with(t, 's') THEN left(t, length(t) - 1) ELSE t END)"
    return f"(SELECT list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) FROM (SELECT {words} AS w))"


_OVERLAP = "CASE WHEN least(len({a}), len({b})) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / least(len({a}), len({b})) END"
_NEAR = f"""b AS (SELECT i, label, y, {_grams_sql("txt")} AS g FROM (VALUES {", ".join(f"({i}, '{x}', {y}::DOUBLE, '{t}')" for i, (x, y, t) in enumerate(BANK))}) AS v(i, label, y, txt)),
 p AS (SELECT p_partkey, {_TASK} AS task, {_grams_sql(_TASK)} AS own FROM part),
 s AS (SELECT p_partkey, task, own, i, label, y, {_OVERLAP.format(a="own", b="g")} AS sim FROM p, b),
 n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY sim DESC, i) AS k FROM s) WHERE k <= 3)"""


def _bank(spark):
    rows = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(BANK)], "i int, t string")
    found = {r.i: r.g for r in rows.select("i", R.grams(F.col("t"), set(STOP)).alias("g")).collect()}  # the bank's own few rows
    return [(label, y, found[i]) for i, (label, y, _) in enumerate(BANK)]


def _tasks(spark, sf):
    return read(spark, sf, "part").selectExpr("p_partkey", f"{_TASK} AS task").withColumn("own", R.grams(F.col("task"), set(STOP)))


@query(f"WITH p AS (SELECT p_partkey, {_grams_sql(_TASK)} AS own FROM part) SELECT p_partkey, array_to_string(list_sort(own), ',') AS grams FROM p")
def r5_grams(spark, sf):
    return _tasks(spark, sf).select("p_partkey", F.array_join(F.array_sort("own"), ",").alias("grams"))


@query(rf"""WITH {_NEAR}, t AS (SELECT p_partkey, any_value(task) AS task, 0.15 + (coalesce(sum(sim * y) FILTER (sim > 0) / sum(sim) FILTER (sim > 0), 0.15) - 0.15) * least(1, max(sim) / 0.5) AS topic FROM n GROUP BY p_partkey),
 u AS (SELECT p_partkey, topic, CASE WHEN contains(task, '```') THEN 0.05 ELSE 0 END + 0.1 * least(1, greatest(1, floor(length(task) / 4)) / 150) + 0.05 * least(1, len(regexp_extract_all(task, '(?im)(^\s*[-*\d.]|\b(must|should|ensure|require|constraint)\b)')) / 5)
  + 0.05 * least(1, (len(regexp_extract_all(task, '(?m)^\s*\d+[.)]\s')) + len(regexp_extract_all(task, '(?i)\b(and then|after that|step \d)\b'))) / 3) AS extra FROM t)
 SELECT p_partkey, round(topic + extra * (1 - topic), 6) AS score, CASE WHEN topic + extra * (1 - topic) < 0.3 THEN 'cheap' WHEN topic + extra * (1 - topic) <= 0.6 THEN 'mid' ELSE 'premium' END AS band FROM u""")
def r1_rubric(spark, sf):
    s = _tasks(spark, sf).withColumn("s", R.rubric(F.col("task"), F.col("own"), _bank(spark)))
    return s.select("p_partkey", r6("s").alias("score"), R.rubric_band(F.col("s")).alias("band"))


def _vote_sql(fallback: str, least: float) -> str:
    return f"""WITH {_NEAR}, v AS (SELECT p_partkey, label, sum(sim) AS total, min(k) AS k FROM n GROUP BY ALL),
 w AS (SELECT p_partkey, label FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(total, 12) DESC, k) AS r FROM v) WHERE r = 1)
 SELECT p_partkey, CASE WHEN len(any_value(own)) > 0 AND max(sim) >= {least} THEN any_value(w.label) ELSE '{fallback}' END AS label, round(max(sim), 6) AS confidence FROM n JOIN w USING (p_partkey) GROUP BY p_partkey"""


@query(_vote_sql("none", 0.25))
def r2_intent(spark, sf):
    v = _tasks(spark, sf).withColumn("v", R.voted(F.col("own"), _bank(spark)))
    return v.select("p_partkey", "v.label", r6("v.confidence").alias("confidence"))


@query(_vote_sql("ledger-fact", 0.6))
def r3_fact_home(spark, sf):
    v = _tasks(spark, sf).withColumn("v", R.voted(F.col("own"), _bank(spark), fallback="ledger-fact", least=0.6))
    return v.select("p_partkey", "v.label", r6("v.confidence").alias("confidence"))


_CLAIM = """SELECT c_custkey AS id, (c_custkey * 37 % 101) / 100.0::DOUBLE AS rel, pow(0.5, (c_custkey % 90) / 45.0) AS rec, (c_custkey * 53 % 97) / 96.0::DOUBLE AS val,
 CASE c_custkey % 6 WHEN 0 THEN 'symbol' WHEN 1 THEN 'dir' WHEN 2 THEN 'repo' WHEN 3 THEN 'global' ELSE 'odd' END AS scope, c_custkey % 11 = 0 AS tombstone, CASE c_custkey % 3 WHEN 0 THEN 'lesson' WHEN 1 THEN 'fact' ELSE 'summary' END AS kind FROM customer"""
_WEIGHT = "CASE scope WHEN 'symbol' THEN 1.0 WHEN 'dir' THEN 0.8 WHEN 'repo' THEN 0.6 WHEN 'global' THEN 0.4 ELSE 0.5 END"
_SCORED = f"SELECT *, {_WEIGHT} / (1 + exp(-(0.55 * rel + 0.15 * rec + 0.3 * val))) AS score FROM ({_CLAIM})"


def _claims(spark, sf):
    read(spark, sf, "customer").createOrReplaceTempView("_recall_customer")
    return spark.sql(_CLAIM.replace("FROM customer", "FROM _recall_customer").replace("100.0::DOUBLE", "100.0D").replace("96.0::DOUBLE", "96.0D").replace("/ 45.0)", "/ 45.0D)"))


@query(f"SELECT id, round(score, 6) AS score, val < 0.35 AS dormant FROM ({_SCORED})")
def t2_score(spark, sf):
    c = _claims(spark, sf)
    return c.select("id", r6(R.score(F.col("rel"), F.col("rec"), F.col("val"), F.col("scope"))).alias("score"), R.dormant(F.col("val")).alias("dormant"))


@query(f"SELECT id, round(score, 6) AS score FROM ({_SCORED}) WHERE NOT tombstone AND val >= 0.35 ORDER BY score DESC, id LIMIT 12")
def t1_retrieve(spark, sf):
    return R.retrieved(_claims(spark, sf)).select("id", r6("score").alias("score"))


@query(f"SELECT id, round(score, 6) AS score FROM (SELECT * FROM ({_SCORED}) x WHERE NOT tombstone AND val >= 0.35 ORDER BY x.score DESC, id LIMIT 24) y WHERE kind = 'fact' ORDER BY y.score DESC, id LIMIT 12")
def t6_browse(spark, sf):
    return R.browsed(_claims(spark, sf), "fact").select("id", r6("score").alias("score"))


@query("SELECT l_orderkey, l_linenumber, round(least(1, 0.22 * least(1, l_linenumber / 5) + 0.22 * least(1, l_quantity / 15) + 0.12 * least(1, (l_partkey % 20) / 12) + 0.18 * least(1, (l_suppkey % 4) / 3) + 0.12 * l_discount + 0.14 * least(1, (l_orderkey % 90) / 60)), 6) AS score FROM lineitem")
def f22_complexity(spark, sf):
    l = read(spark, sf, "lineitem")
    signals = {"files": F.col("l_linenumber"), "fanout": F.col("l_quantity"), "churn": F.col("l_partkey") % 20, "mistakes": F.col("l_suppkey") % 4, "ambiguity": F.col("l_discount"), "size": F.col("l_orderkey") % 90}
    return l.select("l_orderkey", "l_linenumber", r6(R.complexity(signals)).alias("score"))


@query("SELECT c_custkey, CASE WHEN s < 0.25 THEN 0 WHEN s < 0.55 THEN 1 WHEN s < 0.8 THEN 2 ELSE 3 END AS tier FROM (SELECT c_custkey, (c_custkey * 7 % 101) / 100.0::DOUBLE AS s FROM customer)")
def p16_tier(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", R.recommended(F.expr("(c_custkey * 7 % 101) / 100.0D")).alias("tier"))


_LESSON = "SELECT s_suppkey AS id, s_nationkey, CASE WHEN s_suppkey % 7 = 0 THEN 'retired' ELSE 'active' END AS status, s_suppkey % 5 AS confirmed, s_suppkey % 3 AS contradicted, 19760 - s_suppkey % 60 AS last_day, 45 AS half_life, CASE s_suppkey % 3 WHEN 0 THEN 'dir' WHEN 1 THEN 'repo' ELSE 'x' END AS scope, 0.1 * (s_suppkey % 10) AS match FROM supplier"
_FRESH, _VALID = f"pow(0.5, greatest(0, {NOW} - last_day) / 45.0)", "(1 + confirmed) / (2 + confirmed + contradicted)"


def _lessons(spark, sf):
    read(spark, sf, "supplier").createOrReplaceTempView("_recall_supplier")
    return spark.sql(_LESSON.replace("FROM supplier", "FROM _recall_supplier").replace("0.1 *", "0.1D *"))


@query(f"SELECT id, round({_VALID}, 6) AS validity, round({_FRESH}, 6) AS freshness, round({_FRESH} * {_VALID}, 6) AS confidence FROM ({_LESSON})")
def f23_confidence(spark, sf):
    v, f = R.validity(F.col("confirmed"), F.col("contradicted")), R.freshness(F.col("last_day"), F.col("half_life"), NOW)
    return _lessons(spark, sf).select("id", r6(v).alias("validity"), r6(f).alias("freshness"), r6(f * v).alias("confidence"))


@query(f"""WITH s AS (SELECT *, round(CAST(match AS DOUBLE) * {_FRESH} * {_VALID} * CASE scope WHEN 'dir' THEN 0.8 WHEN 'repo' THEN 0.6 ELSE 0.5 END * CASE WHEN {NOW} - last_day <= 14 THEN 1.2 ELSE 1.0 END, 9) AS score FROM ({_LESSON}) WHERE status = 'active' AND match > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY score DESC, id) AS rank, greatest(0, count(*) OVER (PARTITION BY s_nationkey) - 2) AS overflow FROM s) SELECT s_nationkey, rank, id, round(score, 6) AS score, overflow FROM r WHERE rank <= 2""")
def t4_injected(spark, sf):
    got = R.injected(_lessons(spark, sf), NOW, ["s_nationkey"], budget=2)
    return got.select("s_nationkey", F.col("rank").cast("long").alias("rank"), "id", r6("score").alias("score"), "overflow")


@query(f"""SELECT p_partkey, round(CASE WHEN p_size % 9 = 3 THEN 1.0 WHEN p_brand = 'Brand#7' THEN 0.6 ELSE 0.3 * ({_OVERLAP.format(a="string_split(lower(p_name), ' ')", b="['red', 'ring', 'gear']")}) END, 6) AS match FROM part""")
def f24_match(spark, sf):
    p = read(spark, sf, "part")
    m = R.match_score(F.array((F.col("p_size") % 9).cast("string")), F.array(F.lit("3"), F.lit("x")), F.col("p_brand") == "Brand#7", F.split(F.lower("p_name"), " "), F.array(F.lit("red"), F.lit("ring"), F.lit("gear")))
    return p.select("p_partkey", r6(m).alias("match"))


_GLOBS = ("Brand#1*/ECON*", "**/1?", "Brand#2/*", "**/PROMO/*")
_FILE = "concat(p_brand, '/', p_type, '/', p_size)"


@query(f"""SELECT p_partkey, pat FROM part, (VALUES {", ".join(f"('{g}', '{p}')" for g, p in zip(_GLOBS, ("^Brand#1[^/]*/ECON[^/]*$", "^.*/1[?]$", "^Brand#2/[^/]*$", "^.*/PROMO/[^/]*$")))}) AS g(pat, re) WHERE regexp_matches({_FILE}, re)""")
def j5_glob_hits(spark, sf):
    g = spark.createDataFrame([(x,) for x in _GLOBS], "pat string").withColumn("re", R.glob_pattern(F.col("pat")))  # a handful of patterns
    return read(spark, sf, "part").selectExpr("p_partkey", f"{_FILE} AS file").join(F.broadcast(g), F.expr("file rlike re")).select("p_partkey", "pat")


@query("""WITH c AS (SELECT l_suppkey AS file, sum(l_quantity)::DOUBLE AS score FROM lineitem GROUP BY l_suppkey), h AS (SELECT s_suppkey AS file, coalesce(sum(v), 0)::DOUBLE AS weight, count(v) AS hits FROM supplier LEFT JOIN (SELECT event_id % 97 AS f, round(value / 100, 4) AS v FROM events WHERE event_type = 'error') ON f = s_suppkey GROUP BY s_suppkey)
 SELECT file, score, hits AS incidents, round(score / (SELECT max(score) FROM c) * (1 + weight), 6) AS hazard FROM c JOIN h USING (file) ORDER BY hazard DESC, file LIMIT 15""")
def t3_rank_report(spark, sf):
    c = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("file")).agg(F.sum("l_quantity").cast("double").alias("score"))
    e = read(spark, sf, "events").where("event_type = 'error'").selectExpr("event_id % 97 AS file", "CAST(round(value / 100, 4) AS DOUBLE) AS val")
    return R.rank_report(c, R.history(read(spark, sf, "supplier").selectExpr("s_suppkey AS file"), e))


@query("SELECT s_suppkey AS file, round(coalesce(sum(v), 0), 4)::DOUBLE AS weight, count(v) AS hits FROM supplier LEFT JOIN (SELECT event_id % 97 AS f, round(value / 100, 4) AS v FROM events WHERE event_type = 'error') ON f = s_suppkey GROUP BY s_suppkey")
def r15_history(spark, sf):
    e = read(spark, sf, "events").where("event_type = 'error'").selectExpr("event_id % 97 AS file", "CAST(round(value / 100, 4) AS DOUBLE) AS val")
    h = R.history(read(spark, sf, "supplier").selectExpr("s_suppkey AS file"), e)
    return h.select("file", F.round("weight", 4).alias("weight"), "hits")


@query(f"""WITH m AS (SELECT p_partkey, string_split(lower(concat(p_name, ' ', p_type)), ' ') AS w, f FROM part, (VALUES ('red'), ('ring'), ('promo')) AS f(f))
 SELECT p_partkey, f AS family, round(CASE WHEN list_contains(w, f) THEN {_OVERLAP.format(a="[f, 'ring']", b="list_distinct(w)").replace("[f, 'ring']", "list_distinct([f, 'ring'])")} ELSE 0 END, 6) AS score FROM m""")
def f39_family(spark, sf):
    p = read(spark, sf, "part").withColumn("w", F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))).withColumn("family", F.explode(F.array(F.lit("red"), F.lit("ring"), F.lit("promo"))))
    return p.select("p_partkey", "family", r6(R.family_score(F.col("w"), F.col("family"), F.array_distinct(F.array("family", F.lit("ring"))))).alias("score"))


@query("SELECT p_type, arg_min(p_partkey, (-s, p_size, p_partkey)) AS p_partkey FROM (SELECT *, (p_partkey * 31 % 7) / 7.0 AS s FROM part) WHERE s > 0 GROUP BY p_type")
def t9_best_per_group(spark, sf):
    return R.best_per_group(read(spark, sf, "part").withColumn("s", F.expr("(p_partkey * 31 % 7) / 7.0D")), "p_type", "s", "p_size", "p_partkey")


@query("""WITH h AS (SELECT p_partkey, p_type, len(list_filter(string_split(lower(p_name), ' '), lambda w: w IN ('red', 'ring'))) AS hits FROM part)
 SELECT p_type, count(*) FILTER (1 - pow(0.4, hits) < 0.6 OR hits = 0) AS off, round((count(*) FILTER (1 - pow(0.4, hits) < 0.6 OR hits = 0)) / count(*), 6) AS drift FROM h GROUP BY p_type""")
def f38_goal_drift(spark, sf):
    hits = F.size(F.filter(F.split(F.lower("p_name"), " "), lambda w: w.isin("red", "ring")))
    d = R.goal_drift(read(spark, sf, "part").withColumn("g", R.on_goal(hits)), "p_type", "g")
    return d.select("p_type", "off", r6("drift").alias("drift"))


@query("SELECT s_suppkey, s_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal - 100 * s_nationkey), s_suppkey) AS n FROM supplier) WHERE n = 1")
def t12_nearest(spark, sf):
    s = read(spark, sf, "supplier").withColumn("d", F.abs(F.col("s_acctbal") - 100 * F.col("s_nationkey")))
    return s.groupBy("s_nationkey").agg(F.min_by("s_suppkey", F.struct("d", "s_suppkey")).alias("s_suppkey"))
