"""Ordered decision tables and risk scores, as column expressions on typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import clamp01

# Weights of dependency signals, severities, half-life in days and ring limits.
RING_WEIGHTS = {"staleness": 0.35, "major_lag": 0.3, "advisory": 0.9, "deprecated": 1.0}
SEVERITY = {"critical": 1.0, "high": 0.7, "moderate": 0.4, "low": 0.2}
STALE_HALF_LIFE = 540
ADOPT_BELOW, TRIAL_BELOW, LEAST_KINDS = 0.25, 0.5, 2
# The risk heuristic's weights.
RISK_BIAS = -1.5
RISK_WEIGHTS = {
    "caller_fanout": 0.9,
    "lesson_match": 1.4,
    "churn": 0.5,
    "test_coverage_gap": 0.7,
    "signature_change": 0.6,
    "no_caller_update": 1.1,
    "past_mistake_here": 1.0,
}


def dependency_rings(deps: DataFrame, now_day: int) -> DataFrame:
    """Adds ``score, kinds, ring``: the weighted mean of the signals that are present.

    Needs ``installed, latest, published_day, deprecated, severities array<string>``, all nullable;
    a null is an absent signal, not a low one.
    """
    major = lambda c: F.regexp_extract(F.col(c), r"(\d+)", 1).try_cast("double")
    table = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    low = F.transform("severities", lambda s: F.lower(s))
    worst = F.coalesce(F.array_max(F.transform(low, lambda s: F.coalesce(F.try_element_at(table, s), F.lit(0.0)))), F.lit(0.0))
    signal = {
        "staleness": 1 - F.pow(F.lit(0.5), F.greatest(F.lit(0), F.lit(now_day) - F.col("published_day")) / STALE_HALF_LIFE),
        "major_lag": clamp01(F.greatest(F.lit(0.0), major("latest") - major("installed")) / 3),
        "advisory": F.when(F.col("severities").isNotNull(), worst),
        "deprecated": F.col("deprecated").cast("double"),
    }
    # greatest() skips nulls, so an unknown operand is made null by hand
    signal["staleness"] = F.when(F.col("published_day").isNotNull(), signal["staleness"])
    signal["major_lag"] = F.when(major("latest").isNotNull() & major("installed").isNotNull(), signal["major_lag"])
    total = lambda f: sum((f(k, s) for k, s in signal.items()), F.lit(0.0))
    num = total(lambda k, s: F.coalesce(s * RING_WEIGHTS[k], F.lit(0.0)))
    den = total(lambda k, s: F.when(s.isNotNull(), RING_WEIGHTS[k]).otherwise(0.0))
    kinds = total(lambda k, s: s.isNotNull().cast("int")).cast("int")
    out = deps.withColumns({"score": F.coalesce(F.try_divide(num, den), F.lit(0.0)), "kinds": kinds})
    held = F.coalesce(F.col("deprecated"), F.lit(False)) | F.coalesce(F.array_contains(low, "critical"), F.lit(False))
    ring = F.when(held, "hold").when(F.col("kinds") < LEAST_KINDS, "assess").when(F.col("score") < ADOPT_BELOW, "adopt").when(F.col("score") < TRIAL_BELOW, "trial").otherwise("assess")
    return out.withColumn("ring", ring)


def heuristic_risk(features: dict[str, Column]) -> Column:
    z = F.lit(RISK_BIAS)
    for k, w in RISK_WEIGHTS.items():
        if k in features:
            z = z + w * F.coalesce(features[k], F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def risk_band(risk: Column) -> Column:
    return F.when(risk >= 0.66, "high").when(risk >= 0.4, "med").otherwise("low")


def ref_strength(ref: Column) -> Column:
    """"format" for references that only look right, "resolved" for the rest and for untyped ones."""
    return F.when(ref.rlike(r"^(file|test):"), "format").otherwise("resolved")


def valid_ref(ref: Column) -> Column:
    """Whether a typed reference has a value; untyped ones always hold."""
    return ~F.coalesce(ref.rlike(r"^(git|file|test|ci|human):$"), F.lit(False))


def lifecycle(val: Column, contradictions: Column, retired: Column) -> Column:
    return F.when(retired, "retired").when(val >= 0.6, "active").when((val < 0.45) & (contradictions >= 1), "quarantined").otherwise("candidate")


def verdicts(checks: DataFrame, by: str, status: str) -> DataFrame:
    """``by, verdict``: any FAIL, else any INCOMPLETE, else PASS."""
    has = lambda s: F.bool_or(F.col(status) == s)
    return checks.groupBy(by).agg(F.when(has("FAIL"), "FAIL").when(has("INCOMPLETE"), "INCOMPLETE").otherwise("PASS").alias("verdict"))


def majority(votes: DataFrame, by: str, defect: str) -> DataFrame:
    """``by, ran, s``: share of defect votes; abstains when fewer than half of the votes are usable."""
    usable = F.count(defect)
    ran = usable >= F.ceil(F.count("*") / 2)
    return votes.groupBy(by).agg(ran.alias("ran"), F.when(ran, F.avg(F.col(defect).cast("double"))).alias("s"))


def superseded(facts: DataFrame, name: str, id_col: str, t: str) -> DataFrame:
    """``id, reason``: every fact of a name but the latest, with the fact that replaced it."""
    latest = facts.groupBy(name).agg(F.max_by(id_col, F.struct(t, id_col)).alias("by"))
    old = facts.join(latest, name).where(F.col(id_col) != F.col("by"))
    return old.select(F.col(id_col).alias("id"), F.concat(F.lit("superseded-by:"), F.col("by").cast("string")).alias("reason"))


def discounted(items: DataFrame, source: str, score: str, id_col: str, rate: float = 0.7) -> DataFrame:
    """Adds ``value``: the score, discounted for each better item of the same source."""
    w = Window.partitionBy(source).orderBy(F.desc(score), id_col)
    return items.withColumn("value", F.col(score) * F.pow(F.lit(rate), F.row_number().over(w) - 1))


# What each signal of a task adds to its complexity, and where the tiers begin.
COMPLEXITY_BASE = 1.5
COMPLEXITY_ADDS = {"algorithmic": 4.0, "architectural": 4.0, "moderate": 2.0, "multistep": 1.0, "code": 1.0}
TRIVIAL, LONG, MEDIUM, MANY = -3.0, (120, 1.5), (55, 0.7), (5, 1.0)
TIER_FROM = (3.0, 6.0)


def additive_complexity(flags: dict[str, Column], trivial: Column, tokens: Column, constraints: Column) -> Column:
    """``score, tier`` of a task by adding up what its signals are worth; a trivial marker counts only without a hard signal."""
    score = F.lit(COMPLEXITY_BASE)
    for name, worth in COMPLEXITY_ADDS.items():
        score = score + F.when(flags[name], worth).otherwise(0.0)
    score = score + F.when(tokens > LONG[0], LONG[1]).when(tokens > MEDIUM[0], MEDIUM[1]).otherwise(0.0) + F.when(constraints >= MANY[0], MANY[1]).otherwise(0.0)
    score = F.greatest(F.lit(0.0), score + F.when(trivial & ~flags["algorithmic"] & ~flags["architectural"], TRIVIAL).otherwise(0.0))
    return F.struct(score.alias("score"), F.when(score < TIER_FROM[0], "cheap").when(score <= TIER_FROM[1], "mid").otherwise("premium").alias("tier"))


def additive_completeness(anchors: Column, specifics: Column, vague: Column, words: Column, ask_below: float = 0.6) -> Column:
    """``completeness, risk, ask`` of a request: earned by anchors and named specifics, eroded by vague words and brevity."""
    detail = F.when((words >= 30) & (specifics >= 2), 0.2).when((words >= 22) & (specifics >= 1), 0.1).otherwise(0.0)
    base = 0.45 + F.least(F.lit(0.45), 0.18 * anchors) + F.least(F.lit(0.2), 0.06 * specifics) - 0.22 * vague - F.when(words <= 7, 0.22).otherwise(0.0) + detail
    c = F.round(clamp01(base), 9)  # sums of hundredths: the limits are meant exactly
    bare = (anchors == 0) & ((words <= 10) | ((vague >= 1) & (specifics == 0)))
    return F.struct(c.alias("completeness"), F.when(c < 0.45, "high").when(c < 0.7, "medium").otherwise("low").alias("risk"), ((c < ask_below) | bare).alias("ask"))
