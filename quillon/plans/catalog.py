"""Queries of the core operators on the given tables, each with the SQL that states it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from ..operators import graph, lanes, ledger, metrics, sequences
from ..sources.rounds import Rounds

NOW = 19_760  # an epoch day inside the events
_ORACLE = {"click": "test.run", "view": "ci.run", "purchase": "human.accept", "signup": "typecheck", "error": "human.revert"}
_STAGE = {"click": "gate", "view": "cache", "purchase": "context", "signup": "route", "error": "gate"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """``df`` dealt over all cores: a small file that much is made of is one task's work as it is read.

    With ``key`` the rows are dealt by it, in smaller parts, so that windows and groups by the key that follow need no shuffle of what was made.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(16 * cores, key) if key else df.repartition(4 * cores)


def _case(col: str, table: dict[str, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


#: Events seen as ledger evidence and as metric rows, in both dialects.
EVIDENCE = f"""SELECT event_id, user_id AS claim_id, concat('a', CAST(event_id % 7 AS VARCHAR)) AS author, {_case("event_type", _ORACLE)} AS oracle,
  CASE WHEN event_type = 'error' THEN 'contradict' ELSE 'confirm' END AS result, event_id % 3 <> 0 AS resolved,
  date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS t FROM events"""
METRICS = f"""SELECT event_id, ts, user_id, {_case("event_type", _STAGE)} AS stage,
  CASE WHEN event_type = 'error' THEN 'halt' WHEN event_type = 'view' THEN CASE event_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'near' WHEN 2 THEN 'adapt' ELSE 'miss' END ELSE 'pass' END AS outcome,
  value AS saved, value * 2 AS used FROM events"""
WEIGHTS = "(VALUES " + ", ".join(f"('{k}', CAST({w} AS DOUBLE))" for k, w in ledger.ORACLE_WEIGHTS.items()) + ") AS o(oracle, w)"


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    table = F.create_map(*[F.lit(x) for kv in _ORACLE.items() for x in kv])
    return e.select(
        "event_id", F.col("user_id").alias("claim_id"), F.concat(F.lit("a"), (F.col("event_id") % 7).cast("string")).alias("author"), table[F.col("event_type")].alias("oracle"),
        F.when(F.col("event_type") == "error", "contradict").otherwise("confirm").alias("result"), (F.col("event_id") % 3 != 0).alias("resolved"), F.unix_date(F.to_date("ts")).alias("t"),
    )


def metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    table = F.create_map(*[F.lit(x) for kv in _STAGE.items() for x in kv])
    four = F.col("event_id") % 4
    cache = F.when(four == 0, "exact").when(four == 1, "near").when(four == 2, "adapt").otherwise("miss")
    outcome = F.when(F.col("event_type") == "error", "halt").when(F.col("event_type") == "view", cache).otherwise("pass")
    return e.select("event_id", "ts", "user_id", table[F.col("event_type")].alias("stage"), outcome.alias("outcome"), F.col("value").alias("saved"), (F.col("value") * 2).alias("used"))


def r6(c):
    return F.round(c, 6)


_CONF = """(SELECT claim_id, CASE WHEN bool_or(result = 'confirm' AND resolved) THEN (1 + sum(CASE WHEN result = 'confirm' THEN d ELSE 0 END)) / (2 + sum(d))
   ELSE least((1 + sum(CASE WHEN result = 'confirm' THEN d ELSE 0 END)) / (2 + sum(d)), 0.55) END AS val
  FROM (SELECT e.*, o.w * pow(0.5, greatest(0, {day} - t) / 45.0) * CASE WHEN resolved THEN 1.0 ELSE 0.5 END AS d FROM ({src}) e JOIN {weights} USING (oracle) {where}) GROUP BY claim_id)"""


def _conf_sql(day: int, where: str = "") -> str:
    return _CONF.format(day=day, src=EVIDENCE, weights=WEIGHTS, where=where)


#: Customers' ids seen as claims, minted on days around the events; about a third have no evidence.
CLAIMS = f"SELECT c_custkey AS claim_id, concat('a', CAST(c_custkey % 9 AS VARCHAR)) AS author, {NOW - 40} + c_custkey % 60 AS t FROM customer"


def claims(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").selectExpr("c_custkey AS claim_id", "concat('a', c_custkey % 9) AS author", f"CAST({NOW - 40} + c_custkey % 60 AS INT) AS t")


@query(f"SELECT claim_id, round(coalesce(val, 0.5), 6) AS val FROM ({CLAIMS}) LEFT JOIN {_conf_sql(NOW)} USING (claim_id)")
def a1_confidence(spark, sf):
    return ledger.confidence(evidence(spark, sf), NOW, claims=claims(spark, sf)).select("claim_id", r6("val").alias("val"))


@query(f"SELECT claim_id, round(pow(0.5, greatest(0, {NOW} - max(t)) / 45.0), 6) AS rec FROM (SELECT claim_id, t FROM ({EVIDENCE}) UNION ALL SELECT claim_id, t FROM ({CLAIMS})) GROUP BY claim_id")
def a2_recency(spark, sf):
    return ledger.recency(evidence(spark, sf), NOW, claims=claims(spark, sf)).select("claim_id", r6("rec").alias("rec"))


@query(f"""WITH e AS ({EVIDENCE}), c AS ({CLAIMS} UNION ALL SELECT -1, 'unheard', 0)
SELECT c.author, round(greatest(0.5, (coalesce(sum(CASE WHEN result = 'confirm' THEN w WHEN w IS NULL THEN NULL ELSE 0 END), 0) + 2) / (coalesce(sum(w), 0) + 2)), 6) AS trust
FROM c LEFT JOIN (SELECT e.claim_id, e.author AS by, result, w FROM e JOIN {WEIGHTS} USING (oracle)) x ON c.claim_id = x.claim_id AND c.author <> x.by GROUP BY c.author""")
def a3_author_trust(spark, sf):
    known = claims(spark, sf).union(spark.createDataFrame([(-1, "unheard", 0)], "claim_id long, author string, t int"))
    return ledger.author_trust(known, evidence(spark, sf)).select("author", r6("trust").alias("trust"))


@query(f"""WITH e AS (SELECT *, sha256(concat_ws('|', claim_id, author, oracle, result, t)) AS h FROM ({EVIDENCE}))
SELECT DISTINCT claim_id, h FROM e""")
def a5_merge_replicas(spark, sf):
    e = evidence(spark, sf).withColumn("h", F.sha2(F.concat_ws("|", "claim_id", "author", "oracle", "result", "t"), 256))
    return ledger.merged(e.where("event_id % 3 <> 0"), e.where("event_id % 3 <> 1")).select("claim_id", "h")


@query(f"""WITH e AS (SELECT *, sha256(CAST(event_id AS VARCHAR)) AS h FROM ({EVIDENCE}))
SELECT claim_id, author, t FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY t, h) AS n FROM e) WHERE n = 1""")
def a6_live_claims(spark, sf):
    e = evidence(spark, sf).withColumn("h", F.sha2(F.col("event_id").cast("string"), 256))
    return ledger.earliest(e).select("claim_id", "author", F.col("t").cast("long").alias("t"))


@query(f"SELECT oracle, result, count(*) AS n FROM ({EVIDENCE}) GROUP BY ALL")
def a7_stats(spark, sf):
    return evidence(spark, sf).groupBy("oracle", "result").agg(F.count("*").alias("n"))


@query(f"SELECT claim_id, round(coalesce(val, 0.5), 6) AS val FROM (SELECT claim_id FROM ({CLAIMS}) WHERE t <= {NOW - 8}) LEFT JOIN {_conf_sql(NOW - 8, f'WHERE t <= {NOW - 8}')} USING (claim_id)")
def a8_state_at(spark, sf):
    return ledger.state_at(claims(spark, sf), evidence(spark, sf), NOW - 8).select("claim_id", r6("val").alias("val"))


@query(f"""SELECT claim_id, round(a.val, 6) AS before, round(b.val, 6) AS after,
  CASE WHEN a.val IS NULL THEN 'appeared' WHEN b.val IS NULL THEN 'vanished' WHEN b.val - a.val > 0.01 THEN 'rose' WHEN b.val - a.val < -0.01 THEN 'fell' ELSE 'same' END AS change
FROM {_conf_sql(NOW - 9, f'WHERE t <= {NOW - 9}')} a FULL JOIN {_conf_sql(NOW, f'WHERE t <= {NOW}')} b USING (claim_id)""")
def j4_belief_diff(spark, sf):
    return ledger.belief_diff(evidence(spark, sf), NOW - 9, NOW).select("claim_id", r6("before").alias("before"), r6("after").alias("after"), "change")


@query("""WITH l AS (SELECT sha256(concat_ws('|', event_id, user_id, event_type)) AS id FROM events),
s AS (SELECT substr(id, 1, 2) AS shard, sha256(string_agg(x, chr(10) ORDER BY x)) AS d FROM (SELECT id, sha256(id) AS x FROM l) GROUP BY shard)
SELECT sha256(string_agg(x, chr(10) ORDER BY x)) AS root FROM (SELECT concat_ws(':', shard, d) AS x FROM s)""")
def a14_state_root(spark, sf):
    e = read(spark, sf, "events").select(F.sha2(F.concat_ws("|", "event_id", "user_id", "event_type"), 256).alias("id"))
    return ledger.state_root(e, "id", "id")


@query(f"""SELECT (count(*) FILTER (stage = 'gate' AND outcome = 'halt')) / (count(*) FILTER (stage = 'gate')) AS gate,
 round(avg(CASE outcome WHEN 'exact' THEN 1.0 WHEN 'near' THEN 0.85 WHEN 'adapt' THEN 0.5 ELSE 0.0 END) FILTER (stage = 'cache'), 6) AS cache,
 round(sum(saved) FILTER (stage = 'context') / (sum(saved) FILTER (stage = 'context') + sum(used) FILTER (stage = 'context')), 6) AS context,
 round(1 - (sum(saved) FILTER (stage = 'route' AND event_id % 5 <> 0)) / (sum(3 * saved + 1) FILTER (stage = 'route' AND event_id % 5 <> 0)), 6) AS route FROM ({METRICS})""")
def a9_stage_factors(spark, sf):
    m = metric_rows(spark, sf).withColumn("premium", 3 * F.col("saved") + 1).withColumn("cost", F.when(F.col("event_id") % 5 != 0, F.col("saved")))
    return metrics.stage_factors(m).select("gate", r6("cache").alias("cache"), r6("context").alias("context"), r6("route").alias("route"))


@query("SELECT round(1 - product(1 - f), 6) AS reduction FROM (SELECT avg(l_discount) AS f FROM lineitem GROUP BY l_returnflag)")
def a10_composed_reduction(spark, sf):
    f = read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("factor"))
    return metrics.composed_reduction(f).select(r6("reduction").alias("reduction"))


@query(f"SELECT stage, outcome, count(*) AS n, round(sum(saved), 4) AS saved FROM ({METRICS}) GROUP BY stage, outcome")
def a12_summarise(spark, sf):
    return metrics.summarised(metric_rows(spark, sf)).withColumn("saved", F.round("saved", 4))


@query("SELECT l_orderkey % 97 AS g, round(1 - product(1 - l_discount), 6) AS p FROM lineitem GROUP BY g")
def a13_noisy_or(spark, sf):
    return read(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 97).alias("g")).agg(r6(S.noisy_or(F.col("l_discount"))).alias("p"))


@query("SELECT l_returnflag AS g, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY g")
def a25_median_p95(spark, sf):
    return metrics.median_p95(read(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "g"), "g", "l_extendedprice").withColumn("median", F.round("median", 4))


_SCORED = "SELECT event_type AS g, event_id AS ord, value AS score, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS label FROM events"


def _scored(spark, sf):
    return read(spark, sf, "events").select(F.col("event_type").alias("g"), F.col("event_id").alias("ord"), F.col("value").alias("score"), F.when(F.col("event_id") % 5 == 0, 1).otherwise(0).alias("label"))


@query(f"""SELECT g, round(sum(p) FILTER (label = 1) / sum(label), 6) AS ap FROM (
 SELECT *, sum(label) OVER w / row_number() OVER w AS p FROM ({_SCORED}) WINDOW w AS (PARTITION BY g ORDER BY score DESC, ord ROWS UNBOUNDED PRECEDING)) GROUP BY g""")
def a22_average_precision(spark, sf):
    return metrics.average_precision(_scored(spark, sf), "g").select("g", r6("ap").alias("ap"))


@query(f"SELECT g, round(avg(abs(score - label)), 6) AS mae FROM ({_SCORED}) GROUP BY g")
def a23_mean_absolute_error(spark, sf):
    return _scored(spark, sf).groupBy("g").agg(r6(F.avg(F.abs(F.col("score") - F.col("label")))).alias("mae"))


@query("SELECT l_linestatus AS g, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY g")
def a24_line_fit(spark, sf):
    f = metrics.line_fit(read(spark, sf, "lineitem").withColumnRenamed("l_linestatus", "g"), "g", "l_extendedprice", "l_quantity")
    return f.select("g", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("""WITH p AS (SELECT DISTINCT o_custkey % 50 AS g, l_partkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
t AS (SELECT DISTINCT o_custkey % 50 AS g, l_partkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount > 0.05),
j AS (SELECT g, count(p.g) AS np, count(t.g) AS nt, count(*) FILTER (p.g IS NOT NULL AND t.g IS NOT NULL) AS tp FROM p FULL JOIN t USING (g, i) GROUP BY g),
r AS (SELECT g, CASE WHEN np = 0 THEN CASE WHEN nt = 0 THEN 1.0 ELSE 0.0 END ELSE tp / np END AS pr, CASE WHEN nt = 0 THEN 1.0 ELSE tp / nt END AS rc FROM j)
SELECT g, round(pr, 6) AS "precision", round(rc, 6) AS recall, round(CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1 FROM r""")
def a21_precision_recall(spark, sf):
    rows = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") % 50).alias("g"), F.col("l_partkey").alias("i"), "l_returnflag", "l_discount")
    out = metrics.precision_recall(rows.where("l_returnflag = 'R'"), rows.where("l_discount > 0.05"), "g", "i")
    return out.select("g", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events")
def w1_nth_edit(spark, sf):
    return sequences.nth_occurrence(read(spark, sf, "events"), ["user_id", "event_type"], "event_id").select("event_id", F.col("nth").cast("long").alias("nth"))


@query("""SELECT event_id, len(list_filter(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS 49 PRECEDING), lambda x: x = event_type)) AS hits FROM events""")
def w2_ring_recurrence(spark, sf):
    return sequences.ring_recurrence(read(spark, sf, "events"), "user_id", "event_id", "event_type").select("event_id", F.col("hits").cast("long").alias("hits"))


@query("""SELECT event_id, len(list_filter(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS 7 PRECEDING), lambda x: x = event_type)) >= 4 AS stuck FROM events""")
def w3_repeated_action(spark, sf):
    return sequences.ring_recurrence(read(spark, sf, "events"), "user_id", "event_id", "event_type", 8).select("event_id", (F.col("hits") >= 4).alias("stuck"))


@query("""WITH s AS (SELECT event_id, user_id, sum(coalesce(value / 100, 0) - 0.35) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)
SELECT event_id, round(s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), 6) AS c FROM s""")
def w4_cusum(spark, sf):
    return sequences.cusum(read(spark, sf, "events"), "user_id", "event_id", F.col("value") / 100).select("event_id", r6("c").alias("c"))


@query("""SELECT user_id, island, count(*) AS n FROM (SELECT user_id, CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS island FROM events) GROUP BY ALL""")
def w5_islands(spark, sf):
    return sequences.islands(read(spark, sf, "events"), "user_id", "event_id", F.col("event_type") == "error").groupBy("user_id", "island").agg(F.count("*").alias("n"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_click FROM events""")
def w6_last_before(spark, sf):
    e = read(spark, sf, "events")
    return sequences.last_before(e, "user_id", "event_id", F.when(F.col("event_type") == "click", F.col("event_id")), "prior_click").select("event_id", "prior_click")


@query("""SELECT event_id, o.o_orderkey FROM (SELECT event_id, ts, user_id AS k FROM events) e ASOF LEFT JOIN
 (SELECT o_custkey AS k, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.k = o.k AND e.ts >= o.o_orderdate""")
def j9_as_of(spark, sf):
    e = read(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("k"))
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", "o_orderkey")
    return sequences.as_of_join(e, o, "k", "ts", "o_orderdate", ["o_orderkey"]).select("event_id", "o_orderkey")


_PRICES = "('F', 2, '1990-01-01', '1997-12-31', 1.0, 9.0), ('F', 1, '1996-01-01', '1996-12-31', 2.0, 9.0), ('O', 1, '1997-01-01', NULL, 3.0, NULL), ('P', 1, '1996-01-01', '1999-01-01', 4.0, 7.0)"


@query(f"""WITH w AS (SELECT key, ord, CAST(a AS DATE) AS from_day, CAST(b AS DATE) AS until_day, price, flat FROM (VALUES {_PRICES}) AS w(key, ord, a, b, price, flat)), o AS (SELECT o_orderkey, o_orderstatus AS key, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT key, CAST(sum(coalesce(p, flat)) AS DOUBLE) AS total, count(*) AS n FROM (SELECT o.o_orderkey, o.key, any_value(f.flat) AS flat, arg_min(w.price, w.ord) AS p FROM o JOIN (SELECT key, max(flat) AS flat FROM w GROUP BY key) f USING (key)
 LEFT JOIN w ON o.key = w.key AND day >= from_day AND (until_day IS NULL OR day <= until_day) GROUP BY ALL) GROUP BY key""")
def j8_price_windows(spark, sf):
    w = spark.sql(f"SELECT key, ord, to_date(a) AS from_day, to_date(b) AS until_day, CAST(price AS DOUBLE) AS price, CAST(flat AS DOUBLE) AS flat FROM VALUES {_PRICES} AS w(key, ord, a, b, price, flat)")
    o = read(spark, sf, "orders").select(F.col("o_orderstatus").alias("key"), F.to_date("o_orderdate").alias("day"))
    return sequences.price_windows(o, w, "day").groupBy("key").agg(F.sum("price").alias("total"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0), d AS (SELECT c_custkey AS id, concat('new ', c_name) AS name FROM customer WHERE c_custkey % 3 <> 1)
SELECT * FROM c UNION ALL SELECT * FROM d WHERE id NOT IN (SELECT id FROM c)""")
def u3_left_wins(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return ledger.left_wins(c.where("id % 3 <> 0"), c.where("id % 3 <> 1").withColumn("name", F.concat(F.lit("new "), "name")), "id")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def u4_except(spark, sf):
    return read(spark, sf, "customer").select("c_custkey").exceptAll(read(spark, sf, "orders").where("o_totalprice > 300000").select("o_custkey").distinct())


@query("""SELECT c_custkey, CASE WHEN bal < 0 THEN 'low' WHEN bal < 2000 THEN 'mid' WHEN bal < 6000 THEN 'high' ELSE 'top' END AS band FROM (SELECT c_custkey, c_acctbal AS bal FROM customer)""")
def p16_bands(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", S.band(F.col("c_acctbal"), (0, 2000, 6000), ("low", "mid", "high", "top")).alias("band"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, vec_id, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 3""")
def t13_knn(spark, sf):
    """Every row whose id is divisible by 50 against all rows but its own."""
    return metrics.nearest(read(spark, sf, "embeddings"), k=3, every=50).select("query_id", "vec_id", r6("sim").alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def t1_top_per_group(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf, "orders").withColumn("n", F.row_number().over(w)).where("n <= 3").select("o_custkey", "o_orderkey")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS s, 100000000 + l_partkey % 400 AS p FROM lineitem),
b AS (SELECT s AS a, p AS b FROM e UNION SELECT p, s FROM e), n AS (SELECT DISTINCT a AS id FROM b),
r AS (SELECT id, id AS c FROM n UNION SELECT b.b, r.c FROM r JOIN b ON b.a = r.id WHERE r.c < b.b)
SELECT id, min(c) AS component FROM r GROUP BY id""")
def g11_components(spark, sf):
    e = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (100_000_000 + F.col("l_partkey") % 400).alias("dst")).distinct()
    return graph.components(e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))), e)


@query(None)
def g3_page_rank(spark, sf):
    l, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    e = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), (F.col("o_custkey") % 200).cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), (1 - F.col("l_discount")).alias("w"))
    run = Rounds(spark, "page-rank-edges")
    e = run.keep(e.groupBy("src", "dst").agg(F.sum("w").alias("w")))  # the join of lines and orders is made once
    nodes = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id")))
    ranked = graph.page_rank(nodes, e.union(e.select("dst", "src", "w")), rounds=20, tol=1e-7)
    run.close()
    return ranked.select("id", F.round("rank", 8).alias("rank"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT concat('n', n_nationkey) AS src, concat('n', (n_nationkey * 3 + 1) % 25) AS dst, CAST(0.9 AS DOUBLE) - CAST(0.01 AS DOUBLE) * n_nationkey AS w FROM nation UNION SELECT concat('n', n_nationkey), concat('n', (n_nationkey * 7 + 2) % 25), CAST(0.8 AS DOUBLE) FROM nation),
r AS (SELECT 'n0' AS id, CAST(1.0 AS DOUBLE) AS strength, 0 AS hops UNION SELECT e.src, r.strength * e.w * CAST(0.85 AS DOUBLE), hops + 1 FROM r JOIN e ON e.dst = r.id WHERE hops < 6 AND e.src <> 'n0' AND r.strength * e.w * CAST(0.85 AS DOUBLE) >= 0.1)
SELECT id, round(max(strength), 9) AS strength FROM r WHERE id <> 'n0' GROUP BY id""")
def g6_impact(spark, sf):
    n = read(spark, sf, "nation")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    k = F.col("n_nationkey")
    e = n.select(name(k).alias("src"), name((k * 3 + 1) % 25).alias("dst"), (0.9 - 0.01 * k).alias("w")).union(n.select(name(k), name((k * 7 + 2) % 25), F.lit(0.8)))
    return graph.impact(e, spark.createDataFrame([("n0",)], "id string")).select("id", F.round("strength", 9).alias("strength"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def a_rollup(spark, sf):
    return read(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def a11_daily_buckets(spark, sf):
    return read(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""SELECT doc_id, len(list_distinct(CASE WHEN len(t) >= 4 THEN list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END)) AS n
FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents)""")
def r6_shingles(spark, sf):
    return lanes.shingle_counts(read(spark, sf, "documents"), "doc_id", "text")
