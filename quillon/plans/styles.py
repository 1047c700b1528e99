"""Queries on styles, requests, lesson states, calibration and impact baselines, each with the SQL that states it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import css, gates, graph, metrics
from ..operators import retrieval as R
from ..operators import styles as Y
from .catalog import CLAIMS, NOW, _conf_sql, claims, evidence, query, r6, read, spread

_FP = "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN ARR() ELSE ARR((p_partkey * 7 % 360) * 1.0, (p_size * 13 % 360) * 1.0) END AS hues, p_size % 7 AS palette, CASE WHEN p_size % 6 = 1 THEN ARR() ELSE ARR(4.0, 8.0, p_size * 1.0) END AS spacing, CASE WHEN p_size % 2 = 0 THEN 8.0 ELSE 4.0 END AS base, ARR(p_type) AS fonts, CASE WHEN p_size % 4 = 1 THEN ARR() ELSE ARR(p_size % 20 * 1.0) END AS radii, p_size % 3 AS radius_levels, p_size % 4 AS shadow_levels FROM part"
_DUCK = "SELECT p_partkey, hues::DOUBLE[] AS hues, palette, spacing::DOUBLE[] AS spacing, base::DOUBLE AS base, fonts, radii::DOUBLE[] AS radii, radius_levels, shadow_levels FROM (" + _FP.replace("ARR(", "list_value(") + ")"
_HD = "list_min(list_transform({z}, lambda z: least(abs(h - z) % 360, 360 - abs(h - z) % 360)))"


def _prints(spark, sf):
    read(spark, sf, "part").createOrReplaceTempView("_styles_part")
    df = spark.sql(_FP.replace("ARR(", "array(").replace("FROM part", "FROM _styles_part"))
    return df.withColumns({c: F.col(c).cast("array<double>") for c in ("hues", "spacing", "radii")} | {"base": F.col("base").cast("double")})


def _template_sql() -> str:
    out = []
    for i, (name, (hues, base, steps, fonts, radii, levels, shadows)) in enumerate(Y.TEMPLATES.items()):
        near = _HD.format(z=list(map(float, hues)))
        parts = [
            f"CASE WHEN palette > 0 THEN round(CASE WHEN len(hues) > 0 THEN list_sum(list_transform(hues, lambda h: {near})) / len(hues) / 180 ELSE 1.0 END, 3) END",
            f"CASE WHEN len(spacing) > 0 THEN round((CASE WHEN base = {base} THEN 0.0 ELSE 1.0 END + least(1.0, abs(len(spacing) - {steps}) / 8)) / 2, 3) END",
            f"CASE WHEN len(fonts) > 0 THEN round(least(1.0, abs(len(fonts) - {fonts}) / 2), 3) END",
            f"CASE WHEN len(radii) > 0 THEN round((list_min(list_transform(radii, lambda r: least(1.0, abs(r - {radii[0]}) / 16))) + least(1.0, abs(radius_levels - {levels}) / 3)) / 2, 3) END",
            f"round(least(1.0, abs(shadow_levels - {shadows}) / 3), 3)",
        ]
        out.append(f"SELECT p_partkey, {i} AS i, '{name}' AS name, round(list_sum(p) / len(p), 3) AS d FROM (SELECT p_partkey, list_filter([{', '.join(f'({x})::DOUBLE' for x in parts)}], lambda x: x IS NOT NULL) AS p FROM ({_DUCK}))")
    return " UNION ALL ".join(out)


@query(f"SELECT p_partkey, d AS distance, name FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, i) AS k FROM ({_template_sql()})) WHERE k = 1")
def f44_slop(spark, sf):
    n = _prints(spark, sf).withColumn("n", Y.nearest_template())
    return n.select("p_partkey", "n.distance", "n.name")


@query(None)
def f45_conformance(spark, sf):
    """Every part's style against that of the part with the smallest key; tested by hand."""
    p = _prints(spark, sf)
    f = F.struct(*[c for c in p.columns if c != "p_partkey"])
    project = p.agg(F.min_by(f, "p_partkey").alias("b"))  # one row
    both = p.select("p_partkey", f.alias("a"), Y.slop_distance().alias("slop")).join(F.broadcast(project)).withColumn("conform", Y.conformance("a", "b"))
    return both.select("p_partkey", "conform", Y.gate(F.col("slop"), F.col("conform")).alias("violation"))


_CSS = """concat(':root{--s:', p_size, 'px;--c:rgb(', p_partkey * 37 % 256, ', ', p_partkey * 91 % 256, ', ', p_size * 5 % 256, ');--r:var(--s)} .x{padding:var(--s) 8px;gap:1rem;color:var(--c);border-radius:var(--r);font-family:"', p_type, '",serif;box-shadow:0 1px ', p_size % 3, 'px var(--no, red)}')"""
_HSL = """WITH c AS (SELECT *, p_partkey * 37 % 256 / 255.0::DOUBLE AS r, p_partkey * 91 % 256 / 255.0::DOUBLE AS g, p_size * 5 % 256 / 255.0::DOUBLE AS b FROM part),
 m AS (SELECT *, greatest(r, g, b) AS x, greatest(r, g, b) - least(r, g, b) AS d, (greatest(r, g, b) + least(r, g, b)) / 2 AS k FROM c),
 f AS (SELECT p_partkey, p_size, p_type, CAST(floor(60 * CASE WHEN d = 0 THEN 0 WHEN x = r THEN ((g - b) / d + 6) % 6 WHEN x = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END + 0.5) AS BIGINT) % 360 AS h,
  CAST(floor(CASE WHEN d = 0 THEN 0 ELSE d / (1 - abs(2 * k - 1)) END * 100 + 0.5) AS BIGINT) AS s, list_sort(list_distinct([p_size::DOUBLE, 8.0::DOUBLE, 16.0::DOUBLE])) AS v FROM m)"""


@query(f"""{_HSL} SELECT p_partkey, CASE WHEN s >= 10 THEN CAST(h AS VARCHAR) ELSE '' END AS hues, 1 AS palette, array_to_string(list_transform(v, lambda z: CAST(CAST(z AS INTEGER) AS VARCHAR)), ',') AS spacing,
 CASE WHEN list_sum(list_transform(v, lambda z: abs(z - floor(z / 8 + 0.5) * 8))) <= 0.5 * len(v) THEN 8 WHEN list_sum(list_transform(v, lambda z: abs(z - floor(z / 4 + 0.5) * 4))) <= 0.5 * len(v) THEN 4 ELSE 2 END AS base,
 lower(p_type) AS fonts, CAST(p_size AS VARCHAR) AS radii, 1 AS shadow_levels FROM f""")
def f43_fingerprints(spark, sf):
    """Fingerprints of a stylesheet for each part, read from its text."""
    p = spread(read(spark, sf, "part").select("p_partkey", "p_size", "p_type")).select("p_partkey", F.expr(_CSS).alias("css"))
    whole = lambda c: F.array_join(F.transform(c, lambda z: z.cast("int").cast("string")), ",")
    f = css.fingerprints(p, "p_partkey", "css")
    return f.select("p_partkey", whole("hues").alias("hues"), "palette", whole("spacing").alias("spacing"), F.col("base").cast("int").alias("base"), F.array_join("fonts", ",").alias("fonts"), whole("radii").alias("radii"), "shadow_levels")


@query(f"SELECT p_partkey, concat('.x{{padding:', p_size, 'px 8px;gap:1rem;color:rgb(', p_partkey * 37 % 256, ', ', p_partkey * 91 % 256, ', ', p_size * 5 % 256, ');border-radius:', p_size, 'px;') AS css FROM part")
def f18_resolved(spark, sf):
    """The use of custom properties in a stylesheet for each part, up to the font."""
    p = css.resolved(spread(read(spark, sf, "part").select("p_partkey", "p_size", "p_type")).select("p_partkey", F.expr(_CSS).alias("css")), "css")
    return p.select("p_partkey", F.regexp_extract("css", r"(\.x\{.*;)font-family", 1).alias("css"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 100 / 100.0 < 0.25 THEN 'slop' WHEN p_size / 50.0 > 0.5 THEN 'conform' END AS violation FROM part")
def f46_ui_gate(spark, sf):
    return read(spark, sf, "part").select("p_partkey", Y.gate(F.expr("p_partkey % 100 / 100.0D"), F.expr("p_size / 50.0D")).alias("violation"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
def f49_latest_live(spark, sf):
    return Y.latest_live(read(spark, sf, "orders").withColumn("gone", F.col("o_orderstatus") == "P"), "o_custkey", "o_orderdate", "gone", "o_orderkey")


_ASK = "concat('Some', CASE p_size % 3 WHEN 0 THEN 'how' WHEN 1 THEN '' ELSE ' few' END, ' fix ', p_name, CASE p_size % 4 WHEN 0 THEN ' and so on' WHEN 1 THEN ' properly, etc.' WHEN 2 THEN ' as needed; handle the errors' ELSE ' and more' END, ' in src/', p_type, '.js and util.py, x.', p_size)"
_OPEN = "list_filter([" + ", ".join(f"lower(trim(regexp_extract({_ASK}, '(?i)({p})', 1)))" for p in Y.OPEN_WORDS) + "], lambda h: h <> '')"


@query(f"SELECT p_partkey, array_to_string({_OPEN}, ',') AS markers FROM part")
def f5_open_words(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.array_join(Y.open_words(F.expr(_ASK)), ",").alias("markers"))


@query("SELECT p_partkey, concat('src/', p_type, '.js,util.py') AS files FROM part")
def f4_named_files(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.array_join(Y.named_files(F.expr(_ASK)), ",").alias("files"))


@query(None)
def x6_lesson_states(spark, sf):
    """State of every user's lesson after all its events, errors against it and all others for it; an order-dependent fold, tested by a plain loop."""
    e = read(spark, sf, "events").withColumn("e", F.struct(F.unix_date(F.to_date("ts")).alias("day"), "event_id", (F.col("event_type") != "error").alias("confirm")))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return g.select("user_id", Y.lesson_state(F.col("es")).alias("s")).select("user_id", "s.status", "s.confirmed", "s.contradicted")


@query("""WITH s AS (SELECT c_nationkey AS g, c_acctbal / 10000 AS x, ((c_custkey * 13) % 100) / 100.0::DOUBLE AS y, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer),
 t AS (SELECT g, coalesce(regr_slope(y, x), 1) AS a, avg(y) - coalesce(regr_slope(y, x), 1) * avg(x) AS b FROM s WHERE i % 5 <> 0 GROUP BY g),
 m AS (SELECT g, (SELECT count(*) FROM s z WHERE z.g = s.g) AS n, avg(abs(x - y)) AS base, avg(abs(least(1, greatest(0, a * x + b)) - y)) AS cand FROM s JOIN t USING (g) WHERE i % 5 = 0 GROUP BY g)
 SELECT g, CASE WHEN n >= 20 AND cand <= base - 0.01 THEN 'candidate' ELSE 'baseline' END AS mode FROM m""")
def m4_calibration(spark, sf):
    from pyspark.sql.window import Window

    from ..functions.scores import clamp01

    s = read(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), (F.col("c_acctbal") / 10000).alias("x"), F.expr("((c_custkey * 13) % 100) / 100.0D").alias("y"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).alias("i"))
    fit = s.where("i % 5 <> 0").groupBy("g").agg(F.coalesce(F.regr_slope("y", "x"), F.lit(1.0)).alias("a"), F.avg("y").alias("my"), F.avg("x").alias("mx"))
    n = s.groupBy("g").agg(F.count("*").alias("n"))
    t = s.where("i % 5 = 0").join(fit, "g").withColumn("p", clamp01(F.col("a") * F.col("x") + F.col("my") - F.col("a") * F.col("mx")))
    m = t.groupBy("g").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("base"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("cand")).join(n, "g")
    return m.select("g", gates.promoted(F.col("n"), F.col("base"), F.col("cand"), margin=0.01).alias("mode"))


_VALS = f"SELECT claim_id, author, coalesce(val, 0.5) AS val, claim_id % 13 = 0 AS gone FROM ({CLAIMS}) LEFT JOIN {_conf_sql(NOW)} USING (claim_id)"


@query(f"SELECT CASE WHEN gone THEN 'retired' WHEN round(val, 9) >= 0.6 THEN 'active' ELSE 'candidate' END AS status, count(*) AS n FROM ({_VALS}) GROUP BY ALL")
def a16_lessons_by_status(spark, sf):
    from ..operators import decisions, ledger

    v = ledger.confidence(evidence(spark, sf), NOW, claims=claims(spark, sf)).withColumn("val", F.round("val", 9))
    return v.groupBy(decisions.lifecycle(F.col("val"), F.lit(0), F.col("claim_id") % 13 == 0).alias("status")).agg(F.count("*").alias("n"))


@query(f"SELECT claim_id, round(val, 6) AS val, (SELECT greatest(0, count(*) - 8) FROM ({_VALS}) WHERE NOT gone AND round(val, 9) >= 0.6) AS overflow FROM ({_VALS}) x WHERE NOT gone AND round(x.val, 9) >= 0.6 ORDER BY round(x.val, 9) DESC, claim_id LIMIT 8")
def t5_startup_block(spark, sf):
    from ..operators import ledger

    v = ledger.confidence(evidence(spark, sf), NOW, claims=claims(spark, sf)).withColumn("val", F.round("val", 9)).where("claim_id % 13 <> 0 and val >= 0.6")
    more = v.agg(F.greatest(F.lit(0), F.count("*") - 8).alias("overflow"))  # one row
    return v.orderBy(F.desc("val"), "claim_id").limit(8).join(F.broadcast(more)).select("claim_id", r6("val").alias("val"), "overflow")


_EDGES = "SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey * 7 + 2) % 25 FROM nation"


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT s_nationkey % 25 AS c, s_nationkey % 25 AS id, 1.0::DOUBLE AS v, 0 AS hops FROM (SELECT DISTINCT s_nationkey FROM supplier) UNION SELECT r.c, e.src, r.v * 0.9::DOUBLE * 0.85::DOUBLE, hops + 1 FROM r JOIN e ON e.dst = r.id WHERE hops < 2 AND e.src <> r.c),
 p AS (SELECT DISTINCT c, id FROM r WHERE hops > 0), t AS (SELECT DISTINCT s_nationkey AS c, s_suppkey % 25 AS id FROM supplier),
 g AS (SELECT c, (SELECT count(*) FROM p WHERE p.c = k.c) AS np, (SELECT count(*) FROM t WHERE t.c = k.c) AS nt, (SELECT count(*) FROM p JOIN t USING (c, id) WHERE c = k.c) AS tp FROM (SELECT DISTINCT s_nationkey AS c FROM supplier) k)
 SELECT round(avg(tp / np), 4) AS precision, round(avg(tp / nt), 4) AS recall, round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (np + nt) END), 4) AS f1 FROM g""")
def g12_eval_impact(spark, sf):
    """Predicted against expected impact over labelled cases: two hops back from each, the means over the cases."""
    read(spark, sf, "nation").createOrReplaceTempView("_styles_nation")
    e = spark.sql(_EDGES.replace("FROM nation", "FROM _styles_nation"))
    s = read(spark, sf, "supplier")
    one = s.select(F.col("s_nationkey").alias("c")).distinct().join(e, F.col("c") == F.col("dst")).where("src <> c").select("c", F.col("src").alias("id"))
    two = one.join(e, one["id"] == e["dst"]).where("src <> c").select("c", F.col("src").alias("id"))
    m = metrics.precision_recall(one.union(two), s.select(F.col("s_nationkey").alias("c"), (F.col("s_suppkey") % 25).alias("id")), "c", "id")
    return m.agg(*[F.round(F.avg(x), 4).alias(x) for x in ("precision", "recall", "f1")])


@query("SELECT o_custkey, least(1, count(DISTINCT o_orderkey % 9) / 5)::DOUBLE AS s FROM orders GROUP BY o_custkey")
def g13_impact_strength(spark, sf):
    n = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct(F.col("o_orderkey") % 9).alias("n"))
    return n.select("o_custkey", gates.lens_row("impact", F.lit(True), F.col("n") / 5)["s"].alias("s"))


@query("SELECT p_brand, round(sum(c), 4) AS risk FROM (SELECT p_brand, p_type, max(l_discount)::DOUBLE AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) GROUP BY p_brand")
def a19_imagined(spark, sf):
    j = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    best = j.groupBy("p_brand", "p_type").agg(F.max("l_discount").cast("double").alias("c"))
    return best.groupBy("p_brand").agg(F.round(F.sum("c"), 4).alias("risk"))


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45)")
def j20_risky_importers(spark, sf):
    risky = read(spark, sf, "part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, sf, "lineitem").select("l_suppkey", "l_partkey").join(risky, "l_partkey", "left_semi").select("l_suppkey").distinct()


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 48)")
def j21_unresolved_links(spark, sf):
    known = read(spark, sf, "part").where("p_size < 48").select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(known, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY CUBE (p_type, p_brand)")
def a_cube(spark, sf):
    return read(spark, sf, "part").cube("p_type", "p_brand").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after, ntile(4) OVER w AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def w_lag_lead_ntile(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = F.col("o_totalprice")
    return read(spark, sf, "orders").select("o_orderkey", F.lag(p).over(w).alias("before"), F.lead(p).over(w).alias("after"), F.ntile(4).over(w).cast("long").alias("quarter"))


_OFF = "list_filter(spacing, lambda v: abs(v - floor(v / base + 0.5) * base) > 0.5)"


@query(f"""WITH f AS (SELECT p_partkey, palette, spacing, base, radius_levels, shadow_levels, {_OFF} AS off FROM ({_DUCK}))
 SELECT p_partkey, 'spacing-scale' AS id, CASE WHEN len(spacing) > 0 THEN 1 - len(off)::DOUBLE / len(spacing) ELSE 1 END >= 0.9 AS pass, round(CASE WHEN len(spacing) > 0 THEN 1 - len(off)::DOUBLE / len(spacing) ELSE 1 END, 6) AS found, len(off) AS n_off FROM f
 UNION ALL SELECT p_partkey, 'radius-levels', radius_levels <= 3, radius_levels::DOUBLE, 0 FROM f UNION ALL SELECT p_partkey, 'shadow-levels', shadow_levels <= 3, shadow_levels::DOUBLE, 0 FROM f
 UNION ALL SELECT p_partkey, 'palette-size', palette <= 8, palette::DOUBLE, 0 FROM f""")
def p18_scale_checks(spark, sf):
    c = Y.scale_checks(_prints(spark, sf), "p_partkey")
    return c.select("p_partkey", "id", "pass", r6("found").alias("found"), F.size("off").alias("n_off"))
