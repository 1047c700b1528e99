"""Queries on texts, decisions, sessions, stores and streams, each with the SQL that states it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import colour, texts
from ..operators import decisions, lanes, ledger, sessions
from ..sources import logs
from ..sources.rounds import shared_folder
from ..streaming import events as live
from .catalog import _CONF, EVIDENCE, METRICS, NOW, WEIGHTS, evidence, metric_rows, query, r6, read

ERROR_TEXT = "concat('Error at /srv/app', user_id, '/job.js:', event_id, ':5 line ', event_id, ' 0x', user_id, 'ff took ', event_id, '.5ms at ', CAST(ts AS VARCHAR))"


def _folder(spark, name: str) -> str:
    """A new folder that all executors see."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _java(pattern: str) -> str:
    return pattern.replace("'", "''")


def _scrub_sql(text: str) -> str:
    for pattern, to in texts.ERROR_PARTS:
        text = f"regexp_replace({text}, '{_java(pattern)}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return f"trim({text})"


@query(f"SELECT event_id, {_scrub_sql(ERROR_TEXT)} AS norm FROM events")
def f6_scrubbed_error(spark, sf):
    e = read(spark, sf, "events").withColumn("text", F.expr(ERROR_TEXT.replace("VARCHAR", "STRING")))
    return e.select("event_id", texts.scrubbed(F.col("text")).alias("norm"))


@query("""SELECT c_custkey, round(-sum(p * log2(p)), 6) AS bits FROM (SELECT c_custkey, count(*) / any_value(length(c_name)) AS p
 FROM (SELECT c_custkey, c_name, unnest(string_split(c_name, '')) AS ch FROM customer) GROUP BY c_custkey, ch) GROUP BY c_custkey""")
def f1_entropy(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", r6(texts.entropy(F.col("c_name"))).alias("bits"))


@query(r"""SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(regexp_replace(concat('src/', p_brand, 'getTotal', p_type), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: length(t) >= 3), ' ') AS tokens FROM part""")
def f7_concept_tokens(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.array_join(texts.concept_tokens(F.concat(F.lit("src/"), "p_brand", F.lit("getTotal"), "p_type")), " ").alias("tokens"))


@query("SELECT doc_id, CAST(ceil(length(text) / 3.6) AS BIGINT) AS tokens, regexp_matches(text, '(?i)\\bcurl\\b[^\\n|]*\\|\\s*(sh|bash|zsh)\\b') AS curl FROM documents".replace("\\\\", "\\"))
def f17_token_estimate(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", texts.token_estimate(F.col("text")).alias("tokens"), F.array_contains(texts.red_flags(F.col("text")), "curl_to_shell").alias("curl"))


_SHAPE = "CASE " + " ".join(f"WHEN regexp_matches(t, '{_java(p)}') THEN '{n}'" for n, p in texts.TOKEN_SHAPES) + " ELSE lower(t) END"
_SPEC = "concat('add ', p_name, ' to \"', p_brand, '\" in src/Part.js with maxSize ', p_size, ', see p_type.')"


@query(rf"""SELECT p_partkey, array_to_string(list_transform(list_filter(list_transform(string_split_regex({_SPEC}, '\s+'), lambda x: regexp_replace(x, '{_java(texts.TOKEN_EDGE)}', '', 'g')), lambda x: x <> ''), lambda t: {_SHAPE}), ' ') AS shape FROM part""")
def p9_spec_shape(spark, sf):
    return read(spark, sf, "part").select("p_partkey", texts.spec_shape(F.expr(_SPEC.replace('"', '\\"'))).alias("shape"))


@query("""WITH l AS (SELECT *, (p_partkey * 2654435) % 16777216 AS n FROM part),
c AS (SELECT p_partkey, unnest([(n >> 16) & 255, (n >> 8) & 255, n & 255]) / 255 AS s, unnest([0.2126, 0.7152, 0.0722]) AS w FROM l),
y AS (SELECT p_partkey, sum(w * CASE WHEN s <= 0.03928 THEN s / 12.92 ELSE pow((s + 0.055) / 1.055, 2.4) END) AS y FROM c GROUP BY p_partkey)
SELECT p_partkey, round(1.05 / (y + 0.05), 6) AS ratio, CASE WHEN 1.05 / (y + 0.05) >= 7 THEN 'AAA' WHEN 1.05 / (y + 0.05) >= 4.5 THEN 'AA' ELSE 'fail' END AS level FROM y""")
def f47_contrast(spark, sf):
    hex6 = F.lpad(F.hex((F.col("p_partkey") * 2654435) % 16777216), 6, "0")
    p = read(spark, sf, "part").select("p_partkey", colour.contrast(hex6, F.lit("ffffff")).alias("ratio"))
    return p.select("p_partkey", r6("ratio").alias("ratio"), colour.contrast_level(F.col("ratio")).alias("level"))


_DEPS = """SELECT p_partkey AS k, CASE WHEN p_partkey % 9 <> 0 THEN concat('^', p_size % 5, '.2.0') END AS installed, CASE WHEN p_partkey % 8 <> 0 THEN concat(p_size % 7, '.0.1') END AS latest,
 CASE WHEN p_partkey % 6 <> 0 THEN 19760 - p_partkey % 2000 END AS published_day, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 11 = 0 END AS deprecated,
 CASE p_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' WHEN 2 THEN 'High' WHEN 3 THEN 'other' END AS severity FROM part"""


@query(f"""WITH s AS (SELECT *, 1 - pow(0.5, greatest(0, 19760 - published_day) / 540.0) * CASE WHEN published_day IS NULL THEN NULL ELSE 1 END AS s1,
 least(1.0, greatest(0, CAST(regexp_extract(latest, '\\d+') AS INT) - CAST(regexp_extract(installed, '\\d+') AS INT)) / 3.0) * CASE WHEN latest IS NULL OR installed IS NULL THEN NULL ELSE 1 END AS s2,
 CASE lower(severity) WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.7 WHEN 'moderate' THEN 0.4 WHEN 'low' THEN 0.2 WHEN 'other' THEN 0.0 END AS s3, CAST(deprecated AS INT) AS s4 FROM ({_DEPS})),
t AS (SELECT *, CAST((s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT + (s4 IS NOT NULL)::INT AS INT) AS kinds,
 coalesce((coalesce(0.35 * s1, 0) + coalesce(0.3 * s2, 0) + coalesce(0.9 * s3, 0) + coalesce(s4, 0)) / nullif(0.35 * (s1 IS NOT NULL)::INT + 0.3 * (s2 IS NOT NULL)::INT + 0.9 * (s3 IS NOT NULL)::INT + (s4 IS NOT NULL)::INT, 0), 0) AS score FROM s)
SELECT k, kinds, round(CAST(score AS DOUBLE), 6) AS score, CASE WHEN coalesce(deprecated, false) OR coalesce(severity = 'critical', false) THEN 'hold' WHEN kinds < 2 THEN 'assess' WHEN score < 0.25 THEN 'adopt' WHEN score < 0.5 THEN 'trial' ELSE 'assess' END AS ring FROM t""")
def f25_dependency_rings(spark, sf):
    read(spark, sf, "part").createOrReplaceTempView("quillon_part")
    d = spark.sql(_DEPS.replace("FROM part", "FROM quillon_part")).withColumn("severities", F.when(F.col("severity").isNotNull(), F.array("severity")))
    return decisions.dependency_rings(d, 19760).select("k", "kinds", r6("score").alias("score"), "ring")


@query("""SELECT l_orderkey, l_linenumber, round(r, 6) AS risk, CASE WHEN r >= 0.66 THEN 'high' WHEN r >= 0.4 THEN 'med' ELSE 'low' END AS band
FROM (SELECT *, 1 / (1 + exp(-(-1.5 + 0.9 * (l_quantity / 50) + 0.5 * (l_discount * 10) + 0.7 * (l_linenumber % 2) + 1.1 * (l_linenumber % 3 // 2)))) AS r FROM lineitem)""")
def f20_heuristic_risk(spark, sf):
    risk = decisions.heuristic_risk({"caller_fanout": F.col("l_quantity") / 50, "churn": F.col("l_discount") * 10, "test_coverage_gap": F.col("l_linenumber") % 2, "no_caller_update": F.floor(F.col("l_linenumber") % 3 / 2)})
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(risk).alias("risk"), decisions.risk_band(risk).alias("band"))


_REF = "CASE event_id % 6 WHEN 0 THEN 'git:abc' WHEN 1 THEN 'file:a.js' WHEN 2 THEN 'test:' WHEN 3 THEN 'run-7' WHEN 4 THEN 'ci:' END"


@query(f"""SELECT event_id, CASE WHEN regexp_matches({_REF}, '^(file|test):') THEN 'format' ELSE 'resolved' END AS strength, NOT coalesce(regexp_matches({_REF}, '^(git|file|test|ci|human):$'), false) AS ok FROM events""")
def p4_references(spark, sf):
    ref = F.expr(_REF)
    return read(spark, sf, "events").select("event_id", decisions.ref_strength(ref).alias("strength"), decisions.valid_ref(ref).alias("ok"))


@query(f"""SELECT claim_id, CASE WHEN claim_id % 13 = 0 THEN 'retired' WHEN val >= 0.6 THEN 'active' WHEN val < 0.45 AND bad >= 1 THEN 'quarantined' ELSE 'candidate' END AS status
FROM {_CONF.format(day=NOW, src=EVIDENCE, weights=WEIGHTS, where="")} JOIN (SELECT claim_id, count(*) FILTER (result = 'contradict') AS bad FROM ({EVIDENCE}) GROUP BY claim_id) USING (claim_id)""")
def p8_lifecycle(spark, sf):
    e = evidence(spark, sf)
    bad = e.groupBy("claim_id").agg(F.count_if(F.col("result") == "contradict").alias("bad"))
    both = ledger.confidence(e, NOW).join(bad, "claim_id")
    return both.select("claim_id", decisions.lifecycle(F.col("val"), F.col("bad"), F.col("claim_id") % 13 == 0).alias("status"))


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'FAIL' WHEN bool_or(o_orderstatus = 'O') THEN 'INCOMPLETE' ELSE 'PASS' END AS verdict FROM orders GROUP BY o_custkey")
def a28_verdicts(spark, sf):
    status = F.when(F.col("o_orderstatus") == "P", "FAIL").when(F.col("o_orderstatus") == "O", "INCOMPLETE").otherwise("PASS")
    return decisions.verdicts(read(spark, sf, "orders").withColumn("status", status), "o_custkey", "status")


@query("""SELECT user_id, count(d) >= ceil(count(*) / 2) AS ran, CASE WHEN count(d) >= ceil(count(*) / 2) THEN round(avg(d), 6) END AS s
FROM (SELECT user_id, CASE WHEN event_id % 5 < 3 THEN CAST(event_type = 'error' AS INT) END AS d FROM events) GROUP BY user_id""")
def a37_majority(spark, sf):
    v = read(spark, sf, "events").withColumn("d", F.when(F.col("event_id") % 5 < 3, F.col("event_type") == "error"))
    return decisions.majority(v, "user_id", "d").select("user_id", "ran", r6("s").alias("s"))


@query("""SELECT id, concat('superseded-by:', last) AS reason FROM (SELECT o_orderkey AS id, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS last FROM orders) WHERE id <> last""")
def u8_superseded(spark, sf):
    return decisions.superseded(read(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT event_id, round(value * pow(0.7, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1), 6) AS value FROM events")
def w13_discounted(spark, sf):
    return decisions.discounted(read(spark, sf, "events").select("event_id", "user_id", F.col("value").alias("score")), "user_id", "score", "event_id").select("event_id", r6("value").alias("value"))


@query(r"SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')")
def a30_consolidated(spark, sf):
    key = F.sha2(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " "), 256)
    return read(spark, sf, "documents").where("text is not null").groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


#: Events seen as session rows, in both dialects.
SESSIONS = """SELECT user_id AS sid, event_id AS seq, CASE WHEN event_type IN ('click', 'purchase') THEN 'edit' WHEN event_type = 'signup' THEN 'prompt' ELSE 'bash' END AS type,
 CASE WHEN event_type IN ('click', 'purchase') THEN concat('f', event_id % 4) END AS file,
 CASE event_type WHEN 'view' THEN 'npm run test' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'git revert HEAD' ELSE 'make' END END AS command,
 CASE event_type WHEN 'view' THEN event_id % 2 WHEN 'error' THEN 1 END AS exit_code, CASE WHEN event_type = 'error' OR event_type = 'view' AND event_id % 2 = 1 THEN concat('s', event_id % 3) ELSE '' END AS output_sig,
 CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'please undo that' ELSE 'fine' END END AS text FROM events"""


def _sessions(spark, sf):
    read(spark, sf, "events").createOrReplaceTempView("quillon_events")
    return spark.sql(SESSIONS.replace("FROM events", "FROM quillon_events"))


@query(f"""WITH e AS (SELECT *, command = 'npm run test' AND exit_code = 0 AS ok, command = 'npm run test' AND exit_code <> 0 AS bad FROM ({SESSIONS})),
r AS (SELECT *, (SELECT count(*) FROM e p WHERE p.sid = e.sid AND p.seq < e.seq AND p.ok) AS run FROM e),
s1 AS (SELECT DISTINCT x.sid, x.file, 'S1' AS signal FROM r x JOIN r f ON f.sid = x.sid AND f.run = x.run AND f.bad AND f.seq < x.seq JOIN r p ON p.sid = x.sid AND p.run = x.run AND p.ok WHERE x.type = 'edit'),
c AS (SELECT sid, file, count(*) AS n FROM e WHERE type = 'edit' GROUP BY ALL),
s5 AS (SELECT DISTINCT p.sid, (SELECT max_by(x.file, x.seq) FROM e x WHERE x.sid = p.sid AND x.seq < p.seq AND x.type = 'edit') AS file, 'S5' AS signal FROM e p WHERE text LIKE '%undo%')
SELECT * FROM s1 UNION ALL SELECT sid, file, 'S2' FROM c WHERE n >= 2 UNION ALL SELECT sid, file, 'S3' FROM c WHERE n >= 3 UNION ALL SELECT * FROM s5 WHERE file IS NOT NULL""")
def x4_signals(spark, sf):
    return sessions.signals(_sessions(spark, sf))


@query(f"""WITH e AS ({SESSIONS}) SELECT sid, seq, array_to_string((SELECT list(file ORDER BY seq) FROM (SELECT x.file, x.seq FROM e x WHERE x.sid = r.sid AND x.seq < r.seq AND x.type = 'edit' ORDER BY x.seq DESC LIMIT 3)), ',') AS files FROM e r WHERE command LIKE 'git revert%'""")
def x4_contradictions(spark, sf):
    c = sessions.contradictions(_sessions(spark, sf))
    return c.select("sid", "seq", F.when(F.size("files") > 0, F.array_join("files", ",")).alias("files"))


@query(f"""WITH e AS (SELECT *, first_value(CASE WHEN type = 'bash' AND output_sig <> '' THEN output_sig END IGNORE NULLS) OVER (PARTITION BY sid ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM ({SESSIONS})),
g AS (SELECT sid, nxt AS signature, count(*) FILTER (output_sig <> '') AS n, min(seq) FILTER (output_sig <> '') AS f, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM e WHERE nxt IS NOT NULL GROUP BY ALL)
SELECT sid, signature, n, coalesce(files, '') AS files FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY n DESC, f) AS k FROM g WHERE n >= 3) WHERE k = 1""")
def x5_doom_loops(spark, sf):
    return sessions.doom_loops(_sessions(spark, sf)).withColumn("files", F.array_join("files", ","))


@query(f"""SELECT d.day, count(m.event_id) AS n, round(coalesce(sum(saved), 0), 4) AS saved FROM (SELECT unnest(range({NOW - 89}, {NOW + 1}))::INT AS day) d
LEFT JOIN ({METRICS}) m ON date_diff('day', DATE '1970-01-01', CAST(m.ts AS DATE)) = d.day GROUP BY d.day""")
def x2_daily_history(spark, sf):
    m = metric_rows(spark, sf).withColumn("day", F.unix_date(F.to_date("ts")))
    return sessions.daily_history(m, NOW).withColumn("saved", F.round("saved", 4))


@query(f"SELECT outcome, count(*) AS n FROM ({METRICS}) WHERE stage = 'cache' GROUP BY outcome")
def s1_metric_log(spark, sf):
    path = _folder(spark, "log")
    logs.append_log(metric_rows(spark, sf).select("event_id", "stage", "outcome"), path)
    spark.createDataFrame([('{"event_id": 1, "stage": "cac',), ("not json",)], "value string").write.mode("append").text(path)
    return logs.read_log(spark, path, "event_id long, stage string, outcome string", F.col("stage") == "cache").groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) FILTER (event_id % 10 <> 0) AS good, count(*) FILTER (event_id % 10 = 0) AS forged FROM events GROUP BY user_id")
def s4_verified_log(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type").withColumn("h", logs.seal("event_id", "user_id", "event_type"))
    e = e.withColumn("event_type", F.when(F.col("event_id") % 10 == 0, "forged").otherwise(F.col("event_type")))
    good, forged = logs.verified(e)
    both = good.withColumn("ok", F.lit(True)).unionByName(forged.withColumn("ok", F.lit(False)))
    return both.groupBy("user_id").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("forged"))


@query("SELECT id, event_type FROM (SELECT sha256(CAST(event_id AS VARCHAR)) AS id, event_type FROM events) WHERE id LIKE 'a1%' ORDER BY id LIMIT 1")
def s6_by_prefix(spark, sf):
    path = _folder(spark, "claims")
    logs.write_claims(read(spark, sf, "events").select(F.sha2(F.col("event_id").cast("string"), 256).alias("id"), "event_type").repartition(8, F.substring("id", 1, 2)), path)
    return logs.by_prefix(spark, path, "a1").select("id", "event_type")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def x1_stream_windows(spark, sf):
    out = _folder(spark, "windows")
    stream = spark.readStream.schema(read(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    live.run(live.windowed(stream, "ts", "1 hour", ["event_type"]), out, f"{out}-checkpoint", "complete")
    return spark.read.parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT event_id, len(list_filter(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS 49 PRECEDING), lambda x: x = event_type)) AS hits FROM events""")
def x7_stream_ring(spark, sf):
    out = _folder(spark, "rings")
    stream = spark.readStream.schema(read(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    live.run(live.ring_counts(stream, "user_id", "event_id", "event_type"), out, f"{out}-checkpoint")
    return spark.read.parquet(out)


@query(None)
def r10_reuse_ladder(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return lanes.reuse_ladder(d.where("id % 50 = 0"), d)


@query(None)
def r11_clusters(spark, sf):
    """Groups of documents whose sketches agree in 0.7 of the lanes, exactly."""
    return lanes.clusters(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(None)
def r9_band_keys(spark, sf):
    """Digest of every document's sketch, and its first band key."""
    return lanes.digests(read(spark, sf, "documents"), "doc_id", "text")
