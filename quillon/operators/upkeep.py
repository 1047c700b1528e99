"""Keeping a ledger: views, audits, timelines, superseding, importing, sessions and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ledger import author_trust, confidence, earliest, weighted

# Buckets of a claim's value, the contested band, claim kinds, and rows a timeline shows.
DORMANT, TRUSTED = 0.35, 0.65
CONTESTED = (0.4, 0.6)
KINDS = ("lesson", "fact", "diagnosis", "summary", "artifact", "decision")
TIMELINE = 60
CHECKPOINTS = (250, 500, 1000, 2000)


def live_view(claims: DataFrame, provenance: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Claims with their earliest provenance record and, where retracted, their earliest tombstone."""
    p = earliest(provenance.select("claim_id", "t", "h", "author"))
    x = earliest(tombstones.select("claim_id", "t", "h")).select("claim_id", F.col("t").alias("retracted"))
    return claims.select("claim_id").join(p.select("claim_id", F.col("t").alias("minted"), "author"), "claim_id", "left").join(x, "claim_id", "left")


def stats(values: DataFrame) -> DataFrame:
    """``kind, bucket, n, tombstoned``: retracted claims count too. Needs ``kind, val, tombstone``."""
    bucket = F.when(F.col("val") < DORMANT, "dormant").when(F.col("val") < TRUSTED, "uncertain").otherwise("trusted")
    return values.groupBy("kind", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if("tombstone").alias("tombstoned"))


def contested(claims: DataFrame, evidence: DataFrame, now_day: int) -> DataFrame:
    """Live claims (``claim_id, tombstone``) whose value lies in the contested band, with a valid contradiction."""
    val = confidence(evidence, now_day, claims=claims)
    doubted = weighted(evidence).where("result = 'contradict'").select("claim_id")
    live = claims.where("not tombstone").select("claim_id")
    return live.join(val, "claim_id").where(F.col("val").between(*CONTESTED)).join(doubted, "claim_id", "left_semi")


def blamed(claims: DataFrame, evidence: DataFrame, now_day: int) -> DataFrame:
    """``claim_id, author, val, trusted_val, records``: each claim's value with and without its witnesses' trust; unknown authors count in full."""
    plain = confidence(evidence, now_day, claims=claims)
    by_trust = confidence(evidence, now_day, trust=author_trust(claims, evidence), claims=claims).withColumnRenamed("val", "trusted_val")
    n = evidence.groupBy("claim_id").agg(F.count("*").alias("records"))
    return claims.select("claim_id", "author").join(plain, "claim_id").join(by_trust, "claim_id").join(n, "claim_id", "left").withColumn("records", F.coalesce("records", F.lit(0)))


def minted(rows: DataFrame, kind: str = "kind", body: str = "body", secret: str = r"(?i)(token|secret|password)\s*[:=]") -> DataFrame:
    """Adds ``reason``: why a claim is refused; null where it is taken, and ``id``, the digest of its kind and body."""
    reason = F.when(~F.col(kind).isin(*KINDS), F.concat(F.lit("unknown claim kind: "), kind)).when(F.col(body).isNull(), "claim body must be an object").when(F.col(body).rlike(secret), "refused: looks like a secret")
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("id", F.when(F.col("reason").isNull(), F.sha2(F.concat_ws("\n", kind, body), 256)))


def claim_text(kind: Column, name: Column, text: Column, note: Column) -> Column:
    """What retrieval reads of a claim of each kind."""
    joined = lambda *c: F.concat_ws(" ", *[F.when(x != "", x) for x in c])
    return F.when(kind == "lesson", joined(text, note)).when(kind == "fact", joined(name, text)).when(kind == "diagnosis", joined(name, note)).otherwise(F.coalesce(text, note))


def timeline(claims: DataFrame, cap: int = TIMELINE) -> DataFrame:
    """``day, type, id8``: mints and retractions, latest day first, then by id. Needs ``id, minted, retracted``."""
    id8 = F.substring("id", 1, 8).alias("id8")
    mint = claims.where("minted is not null").select(F.col("minted").alias("day"), F.lit("mint").alias("type"), id8)
    gone = claims.where("retracted is not null").select(F.col("retracted").alias("day"), F.lit("retract").alias("type"), id8)
    return mint.unionAll(gone).orderBy(F.desc("day"), "id8", "type").limit(cap)


def issues(log: DataFrame, digest: Column, oracles: list[str]) -> DataFrame:
    """``id, issue`` of every invalid row: no hash, another hash, or an unknown oracle or result."""
    issue = F.when(F.col("h").isNull(), "missing hash").when(F.col("h") != digest, "content hash mismatch").when(~F.col("oracle").isin(*oracles) | ~F.col("result").isin("confirm", "contradict"), "invalid outcome")
    return log.select("id", issue.alias("issue")).where("issue is not null")


def rekeyed(evidence: DataFrame, renamed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence with the old ids' rows copied to the new ones, tombstones of the old ids); ``renamed`` has ``before, after``."""
    copied = evidence.join(renamed, evidence["claim_id"] == renamed["before"]).drop("claim_id", "before").withColumnRenamed("after", "claim_id")
    return evidence.unionByName(copied).distinct(), renamed.select(F.col("before").alias("claim_id"), F.concat(F.lit("superseded-by:"), "after").alias("reason"))


def unbacked(claims: DataFrame, rows: DataFrame, author: str) -> DataFrame:
    """The author's own claims whose fact is no longer there."""
    return claims.where(F.col("author") == author).join(rows.select("name").distinct(), "name", "left_anti")


def imported(old: DataFrame, claims: DataFrame, key: str, count: str, day: str) -> DataFrame:
    """``key, t``: one dated row for each unit of an old counter, where the claim is not there yet."""
    fresh = old.join(claims.select(key), key, "left_anti").where(F.col(count) > 0)
    return fresh.select(key, F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias("_n"), day).select(key, (F.col(day) - F.col("_n")).alias("t"))


def appended(log: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Records that are not there yet, each once: repeating an append changes nothing."""
    return new.dropDuplicates(key).join(log.select(*key), key, "left_anti")


def event_kind(tool: Column, hook: Column, prompt: Column) -> Column:
    """``edit``, ``bash`` or ``prompt``; null for what is not kept."""
    return F.when(tool.isin("Edit", "Write", "MultiEdit"), "edit").when(tool == "Bash", "bash").when((hook == "UserPromptSubmit") | prompt.isNotNull(), "prompt")


def session_summaries(events: DataFrame) -> DataFrame:
    """``sid, text, files, tested``: the first prompt, or the files touched; nothing for a session with neither.

    Needs ``sid, seq, type, file, text, tested``.  A session's distinct files are one list.
    """
    gist = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 280)
    asked = (F.col("type") == "prompt") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    g = events.groupBy("sid").agg(
        F.min_by(F.when(asked, gist), F.when(asked, F.col("seq"))).alias("gist"),
        F.array_sort(F.collect_set(F.when((F.col("type") == "edit") & (F.col("file") != ""), F.col("file")))).alias("files"),
        F.bool_or(F.coalesce("tested", F.lit(False))).alias("tested"),
    )
    text = F.coalesce("gist", F.concat(F.lit("touched "), F.array_join("files", ", ")))
    return g.where(F.col("gist").isNotNull() | (F.size("files") > 0)).select("sid", text.alias("text"), F.array_join("files", ",").alias("files"), "tested")


def retained(sessions: DataFrame, last: str, now: Column, days: int = 7) -> DataFrame:
    return sessions.where(F.col(last) >= now - F.expr(f"INTERVAL {days} DAYS"))


def checkpoint_calls(calls: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds ``n``: rows at which a group's call counter reaches one of the advisory marks."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return calls.withColumn("n", n).where(F.col("n").isin(*CHECKPOINTS))


def newest(rows: DataFrame, by: str, at: str, name: str) -> DataFrame:
    return rows.groupBy(by).agg(F.max_by(name, F.struct(at, name)).alias(name))


def canonical(fields: dict[str, Column]) -> Column:
    """JSON text of the fields in the order of their names, without null ones; equal contents have equal texts."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "true"})


def claim(kind: str, fields: dict[str, Column], scope: Column | None = None) -> Column:
    """``kind, body, scope, id``: a claim with its body in canonical form; the id covers kind, body and scope, and not who says it or when."""
    body = canonical(fields)
    scope = F.coalesce(scope, F.lit("repo")) if scope is not None else F.lit("repo")
    return F.struct(F.lit(kind).alias("kind"), body.alias("body"), scope.alias("scope"), F.sha2(F.concat_ws("\n", F.lit(kind), body, scope), 256).alias("id"))


def fact_claim(name: Column, text: Column, scope: Column | None = None) -> Column:
    return claim("fact", {"name": F.trim(name), "text": F.trim(text)}, scope)


def lesson_claim(wrong: Column, right: Column, files: Column, symbols: Column, scope: Column | None = None) -> Column:
    """A lesson's triggers are sets, so their order and repeats do not make another claim."""
    return claim("lesson", {"wrong": F.trim(wrong), "right": F.trim(right), "files": F.array_sort(F.array_distinct(files)), "symbols": F.array_sort(F.array_distinct(symbols))}, scope)


def artifact_claim(spec: Column, part: Column, deps: Column, interface: Column, scope: Column | None = None) -> Column:
    return claim("artifact", {"spec": F.trim(spec), "slice": part, "deps": F.array_sort(F.array_distinct(deps)), "interface": F.array_sort(F.array_distinct(interface))}, scope)
