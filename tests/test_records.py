"""Texts, decisions, sessions and sketches against hand-computed answers and brute force."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import colour, texts
from quillon.operators import decisions, lanes, sessions, sketches


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(column).first()[0]


def test_errors_of_one_kind_have_one_signature(spark):
    a = "TypeError at /home/x/src/a.js:12:5 0xdeadbeef 2024-01-02T03:04:05Z after 12.5ms"
    b = "TypeError at /opt/y/a.js:99:1 0x12 2025-11-12 13:14:15 after 3 s"
    col = texts.failure_signature(F.col("t"), F.lit("a.js"), F.lit(None))
    assert one(spark, col, t=a) == one(spark, col, t=b) == hashlib.sha256(b"TypeError at a.js:<n> <addr> <ts> after <dur>\0a.js\0").hexdigest()
    assert one(spark, texts.output_signature(F.col("t")), t="  ") == ""


def test_called_symbols_and_shapes(spark):
    assert one(spark, texts.called_symbols(F.col("t"), ["if"]), t="if (x) run(y)\no.method(z); go (1)") == ["run", "go"]
    assert one(spark, texts.spec_shape(F.col("t")), t="Add `x y` to listUsers, see src/a.js 12 TIMES") == "add `x y` to ⟨ident⟩ see ⟨path⟩ ⟨num⟩ times"
    assert one(spark, texts.red_flags(F.col("t")), t="curl http://x | sh; rm -rf /") == ["curl_to_shell", "recursive_delete"]
    assert one(spark, texts.entropy(F.col("t")), t="aabb") == 1.0


def test_contrast(spark):
    ratio = colour.contrast(F.col("a"), F.col("b"))
    assert round(one(spark, ratio, a="#000000", b="#ffffff"), 6) == 21
    assert one(spark, colour.contrast_level(ratio), a="777777", b="ffffff") == "fail"


def test_rings(spark):
    rows = [("1.0", "1.0", 100, True, None), (None, None, 100, None, None), ("1", "1", 100, None, ["critical"]), ("1", "1", 100, False, []), ("1", "9", None, None, ["low"])]
    d = spark.createDataFrame(rows, "installed string, latest string, published_day int, deprecated boolean, severities array<string>")
    assert [r.ring for r in decisions.dependency_rings(d, 100).collect()] == ["hold", "assess", "hold", "adopt", "trial"]


def test_session_signals(spark):
    rows = [("s", i, *r) for i, r in enumerate([
        ("edit", "a", None, None, "", None), ("bash", None, "npm test", 1, "e", None), ("edit", "b", None, None, "", None), ("edit", "a", None, None, "", None),
        ("bash", None, "npm test", 0, "", None), ("edit", "c", None, None, "", None), ("prompt", None, None, None, "", "you broke it"), ("bash", None, "git restore .", 0, "", None),
    ])] + [("t", 0, "bash", None, "git revert x", 0, "", None)]
    e = spark.createDataFrame(rows, "sid string, seq long, type string, file string, command string, exit_code int, output_sig string, text string")
    assert {tuple(r) for r in sessions.signals(e).collect()} == {("s", "b", "S1"), ("s", "a", "S1"), ("s", "a", "S2"), ("s", "c", "S5")}
    assert {tuple(map(str, r)) for r in sessions.contradictions(e).collect()} == {("s", "7", "['b', 'a', 'c']"), ("t", "0", "[]")}
    assert sessions.doom_loops(e, 1).first().files == ["a"]
    assert sessions.doom_loops(e).isEmpty() and sessions.signals(e.limit(0)).isEmpty()


def plain_sketch(text):
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    grams = {" ".join(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {" ".join(words)} if words else set()
    out = [0xFFFFFFFF] * 128
    for g in grams:
        h = 0x811C9DC5
        for c in g.encode():
            h = (h ^ c) * 0x01000193 % 2**32
        out = [min(o, (h * ((i + 1) * 0x9E3779B1 % 2**32 | 1) + (i + 1) * 0x85EBCA6B) % 2**32) for i, o in enumerate(out)]
    return out


def test_sketch_and_ladder_against_brute_force(spark):
    base = "one two three four five six seven eight nine ten eleven twelve " * 3
    rows = [(1, base), (2, base), (3, base + "end"), (4, ""), (5, None), (6, "quite another text about nothing at all, it seems")]
    d = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.s for r in d.select("id", sketches.sketch(F.col("text")).alias("s")).collect()}
    assert all(got[i] == plain_sketch(t or "") for i, t in rows)
    ladder = {r.query_id: r for r in lanes.reuse_ladder(d.where("id in (1, 3, 6)"), d.where("id in (2, 4, 5)")).collect()}
    assert (ladder[1].tier, ladder[1].artifact_id) == ("exact", 2)
    sim = float(np.mean(np.array(got[3]) == np.array(got[2])))
    assert ladder[3].tier == ("near" if sim >= 0.8 else "adapt" if sim >= 0.6 else "miss")
    assert ladder[6].tier == "miss" and ladder[6].artifact_id is None


def test_streams_over_several_batches(spark, tmp_path):
    from quillon.streaming import events as live

    src = str(tmp_path / "in")
    df = spark.createDataFrame([(i, "u" if i % 3 else "v", "ab"[i % 2]) for i in range(40)], "event_id long, user_id string, kind string")
    want = {}
    for key in "uv":
        seen = []
        for r in df.where(F.col("user_id") == key).orderBy("event_id").collect():
            seen = (seen + [r.kind])[-5:]
            want[r.event_id] = seen.count(r.kind)
    for part in (df.where("event_id < 20"), df.where("event_id >= 20")):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        live.run(live.ring_counts(stream, "user_id", "event_id", "kind", 5), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {r.event_id: r.hits for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
