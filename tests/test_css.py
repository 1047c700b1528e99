"""Fingerprints of small stylesheets, by hand."""

import pytest

from quillon.operators import css, styles


def prints(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, css string")
    return [r for r in css.fingerprints(df, "id", "css").orderBy("id").collect()]


def resolve(spark, *texts):
    return [r.css for r in css.resolved(spark.createDataFrame([(t,) for t in texts], "css string"), "css").collect()]


def test_custom_properties_go_in(spark):
    got = resolve(
        spark,
        ":root{--s:16px} .a{padding:var(--s)} .b{margin:var( --s ) var(--t, 4px) var(--u)}",
        ":root{--a:var(--b);--b:var(--c);--c:9px} x{gap:var(--a)}",
        ":root{--a:var(--b);--b:var(--a)} x{gap:var(--a)}",
        "x{color:var(--no, rgba(1,2,3,.5));gap:var(--no,var(--m, 3px))} :root{--s:1px;--s:2px} y{gap:var(--s)}",
        "no properties here",
    )
    assert ".a{padding:16px} .b{margin:16px 4px var(--u)}" in got[0]
    assert "x{gap:9px}" in got[1]
    assert "var(" in got[2]
    assert "color:rgba(1,2,3,.5);gap:3px" in got[3] and "y{gap:2px}" in got[3]
    assert got[4] == "no properties here"


def test_a_stylesheet(spark):
    text = """:root{--s4:16px;--ink:#1a2b3c} .card{padding:var(--s4) 8px;margin:-0.5rem auto 0;color:var(--ink);background:rgb(255, 0, 0);border-radius:999px;
      font-family:"Inter", Arial;box-shadow:0 1px  2px #0003} .x{scroll-padding:3px;border-top-left-radius:4px;fill:hsl(120deg 50% 25%);box-shadow:none;font-family:var(--f), x}"""
    (r,) = prints(spark, text)
    assert [tuple(c) for c in r.colours] == [(0, 0, 0), (0, 100, 50), (120, 50, 25), (210, 40, 17)]
    assert r.hues == [0.0, 120.0, 210.0] and r.hue_buckets == [1, 0, 0, 0, 1, 0, 0, 1, 0, 0, 0, 0] and r.palette == 4
    assert (r.spacing, r.base, r.on_scale) == ([8.0, 16.0], 8.0, 1.0)
    assert (r.fonts, r.radii, r.radius_levels, r.shadow_levels) == (["inter"], [4.0, 9999.0], 2, 1)


def test_utility_classes(spark):
    (r, empty, null) = prints(spark, '<div class="p-4 -mt-2 gap-x-px top-4 rounded-tl-lg rounded shadow shadow-lg shadow-none bg-indigo-500 text-white font-mono border-slate-50">', "", None)
    assert [tuple(c) for c in r.colours] == [(0, 0, 100), (215, 5, 95), (239, 84, 50)] and r.hues == [239.0]
    assert (r.spacing, r.fonts, r.radii, r.shadow_levels) == ([1.0, 8.0, 16.0], ["monospace"], [4.0, 8.0], 2)
    for e in (empty, null):
        assert (e.colours, e.spacing, e.base, e.on_scale, e.fonts, e.radii, e.shadow_levels) == ([], [], None, 1.0, [], [], 0)


def test_a_stock_template_is_told_from_text(spark):
    stock = "a{color:#3b82f6;background:#6366f1;padding:8px 16px 32px;font-family:Inter;border-radius:12px;box-shadow:0 1px 2px #0000}"
    own = "a{color:#8a5a12;background:#12708a;padding:5px 10px 25px;font-family:Fraunces;border-radius:3px} b{font-family:Karla;border-radius:0.5rem;margin:35px}"
    df = css.fingerprints(spark.createDataFrame([(0, stock), (1, own)], "id int, css string"), "id", "css").withColumn("slop", styles.slop_distance())
    got = [r.slop for r in df.orderBy("id").collect()]
    assert got[0] < 0.25 < got[1]
    assert got[0] == pytest.approx(min(got))
