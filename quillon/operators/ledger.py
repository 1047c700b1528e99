"""Evidence ledgers: confidence, recency, trust, merges, as-of views and state roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decisions import valid_ref

# The weight of each oracle's evidence.
ORACLE_WEIGHTS = {
    "human.revert": 1.0,
    "human.accept": 0.9,
    "test.run": 0.8,
    "ci.run": 0.8,
    "typecheck": 0.6,
    "graph.reval": 0.5,
    "behavioral": 0.3,
    "cortex.episode": 0.5,
    "legacy.import": 0.5,
}
HALF_LIFE = 45
UNRESOLVED_WEIGHT, UNRESOLVED_CAP = 0.5, 0.55


def weighted(evidence: DataFrame) -> DataFrame:
    """Valid evidence rows with their oracle's weight ``w`` (a stored weight is never trusted).

    Where there are such columns, the hash ``h`` must be present and the reference ``ref`` valid.
    """
    if "h" in evidence.columns:
        evidence = evidence.where("h is not null and h <> ''")
    if "ref" in evidence.columns:
        evidence = evidence.where(F.col("ref").isNull() | valid_ref(F.col("ref")))
    table = F.create_map(*[F.lit(x) for kv in ORACLE_WEIGHTS.items() for x in kv])
    known = evidence.where(F.col("oracle").isin(*ORACLE_WEIGHTS) & F.col("result").isin("confirm", "contradict"))
    return known.withColumn("w", table[F.col("oracle")])


def confidence(evidence: DataFrame, now_day: int, half_life: int = HALF_LIFE, trust: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame:
    """``claim_id, val``: decayed Beta mean; without a resolved confirmation at most the cap.

    With ``claims`` every claim has a row; one without valid evidence stands at one half.
    """
    e = weighted(evidence)
    d = F.col("w") * F.pow(F.lit(0.5), F.greatest(F.lit(0), F.lit(now_day) - F.col("t")) / half_life) * F.when(F.col("resolved"), 1.0).otherwise(UNRESOLVED_WEIGHT)
    if trust is not None:
        e = e.join(trust, "author", "left")
        d = d * F.coalesce(F.col("trust"), F.lit(1.0))
    confirm = F.col("result") == "confirm"
    sums = e.withColumn("d", d).groupBy("claim_id").agg(
        F.sum(F.when(confirm, F.col("d")).otherwise(0.0)).alias("c"), F.sum("d").alias("a"), F.bool_or(confirm & F.col("resolved")).alias("ok")
    )
    v = (1 + F.col("c")) / (2 + F.col("a"))
    vals = sums.select("claim_id", F.when(F.col("ok"), v).otherwise(F.least(v, F.lit(UNRESOLVED_CAP))).alias("val"))
    if claims is None:
        return vals
    return claims.select("claim_id").distinct().join(vals, "claim_id", "left").select("claim_id", F.coalesce("val", F.lit(0.5)).alias("val"))


def recency(evidence: DataFrame, now_day: int, half_life: int = HALF_LIFE, claims: DataFrame | None = None) -> DataFrame:
    """``claim_id, rec``: half-life decay of the latest record, future days counting as today; all evidence counts, and the mint day ``t`` of ``claims``."""
    evidence = evidence.select("claim_id", "t")
    if claims is not None:
        evidence = evidence.unionByName(claims.select("claim_id", "t"))
    return evidence.groupBy("claim_id").agg(F.pow(F.lit(0.5), F.greatest(F.lit(0), F.lit(now_day) - F.max("t")) / half_life).alias("rec"))


def author_trust(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``author, trust``: smoothed confirm rate of an author's claims, others' evidence only; 1 without any."""
    e = weighted(evidence).select("claim_id", F.col("author").alias("by"), "result", "w").join(claims.select("claim_id", "author"), "claim_id").where("`by` <> author")
    c = F.sum(F.when(F.col("result") == "confirm", F.col("w")).otherwise(0.0))
    rates = e.groupBy("author").agg(F.greatest(F.lit(0.5), (c + 2) / (F.sum("w") + 2)).alias("rate"))
    return claims.select("author").distinct().join(rates, "author", "left").select("author", F.coalesce("rate", F.lit(1.0)).alias("trust"))


def merged(*logs: DataFrame, key: tuple[str, ...] = ("claim_id", "h")) -> DataFrame:
    """Grow-only union of replicas' logs, one row for each content hash."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out.dropDuplicates(list(key))


def left_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def earliest(log: DataFrame, key: str = "claim_id") -> DataFrame:
    """The earliest record of each claim, by (t, h)."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("t", "h")).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def as_of(log: DataFrame, day: int) -> DataFrame:
    return log.where(F.col("t") <= day)


def state_at(claims: DataFrame, evidence: DataFrame, day: int) -> DataFrame:
    """``claim_id, val``: the claims minted by a day (no mint day: day 0), by the evidence until then."""
    minted = claims.where(F.coalesce("t", F.lit(0)) <= day)
    known = as_of(evidence, day).join(minted.select("claim_id"), "claim_id", "left_semi")
    return confidence(known, day, claims=minted)


def belief_diff(evidence: DataFrame, day_a: int, day_b: int) -> DataFrame:
    """``claim_id, before, after, change``: confidence as of two days, side by side."""
    a = confidence(as_of(evidence, day_a), day_a).withColumnRenamed("val", "before")
    b = confidence(as_of(evidence, day_b), day_b).withColumnRenamed("val", "after")
    both = a.join(b, "claim_id", "full_outer")
    gap = F.col("after") - F.col("before")
    change = F.when(F.col("before").isNull(), "appeared").when(F.col("after").isNull(), "vanished").when(gap > 0.01, "rose").when(gap < -0.01, "fell").otherwise("same")
    return both.withColumn("change", change)


def state_root(lines: DataFrame, id_col: str = "id", line_col: str = "line") -> DataFrame:
    """``root``: digests of sorted lines by two-character shard, then of the shards."""
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n"), 256)
    leaf = lines.select(F.substring(id_col, 1, 2).alias("shard"), F.sha2(F.col(line_col), 256).alias("x"))
    shards = leaf.groupBy("shard").agg(digest.alias("d")).select(F.concat_ws(":", "shard", "d").alias("x"))
    return shards.agg(digest.alias("root"))


def state(claims: DataFrame, evidence: DataFrame, mints: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Every claim with what the other logs say of it: ``n_evidence, author, minted, n_mints, retracted``.

    ``claims``: ``claim_id, ...``; ``evidence``: ``claim_id, h``; ``mints``: ``claim_id, author, t, h``; ``tombstones``: ``claim_id, t, h``.  Records count once for each hash; the first
    mint names author and day.  Records of claims that are not there are left out.
    """
    e = evidence.groupBy("claim_id").agg(F.count_distinct("h").alias("n_evidence"))
    m = mints.groupBy("claim_id").agg(F.min_by(F.struct("author", "t"), F.struct("t", "h")).alias("_m"), F.count_distinct("h").alias("n_mints"))
    d = tombstones.select("claim_id", F.lit(True).alias("_gone")).distinct()
    out = claims.join(e, "claim_id", "left").join(m, "claim_id", "left").join(d, "claim_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*claims.columns, zero("n_evidence"), F.col("_m.author").alias("author"), F.col("_m.t").alias("minted"), zero("n_mints"), F.coalesce("_gone", F.lit(False)).alias("retracted"))


def view(state_: DataFrame, kind: str, retracted: bool) -> DataFrame:
    """Claims of a kind; lessons keep their retracted ones (``retracted``), facts do not."""
    rows = state_.where(F.col("kind") == kind)
    return rows if retracted else rows.where(~F.col("retracted"))
