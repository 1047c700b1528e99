"""Retrieval, votes over exemplar banks, and ranking of what to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import clamp01, once, set_overlap

# Retrieval weights, scope weights, the least value of a claim that is shown.
RELEVANCE, RECENCY, VALUE = 0.55, 0.15, 0.3
SCOPE_WEIGHT = {"symbol": 1.0, "dir": 0.8, "repo": 0.6, "global": 0.4}
OTHER_SCOPE = 0.5
DORMANT_BELOW = 0.35
# The text rubric and the vote's gate.
NEIGHBOURS, PRIOR, SATURATES = 3, 0.15, 0.5
STRUCTURE = {"code": 0.05, "length": 0.1, "constraints": 0.05, "steps": 0.05}
CHEAP_BELOW, MID_UPTO = 0.3, 0.6
LEAST_VOTE = 0.25
# Weights of the complexity signals and the amounts at which they saturate.
COMPLEXITY = {"files": (0.22, 5), "fanout": (0.22, 15), "churn": (0.12, 12), "mistakes": (0.18, 3), "ambiguity": (0.12, 1), "size": (0.14, 60)}


def scope_weight(scope: Column) -> Column:
    out = F.lit(OTHER_SCOPE)
    for name, w in SCOPE_WEIGHT.items():
        out = F.when(scope == name, w).otherwise(out)
    return out


def dormant(val: Column) -> Column:
    return val < DORMANT_BELOW


def score(rel: Column, rec: Column, val: Column, scope: Column) -> Column:
    """Logistic of the weighted relevance, recency and value, times the scope's weight."""
    x = RELEVANCE * clamp01(rel) + RECENCY * rec + VALUE * val
    return scope_weight(scope) / (1 + F.exp(-x))


def retrieved(claims: DataFrame, budget: int = 12) -> DataFrame:
    """The ``budget`` best live claims by score, ties by id; needs ``id, rel, rec, val, scope, tombstone``."""
    live = claims.where(~F.coalesce("tombstone", F.lit(False)) & ~dormant(F.col("val")))
    return live.withColumn("score", score(*(F.col(c) for c in ("rel", "rec", "val", "scope")))).orderBy(F.desc("score"), "id").limit(budget)


def browsed(claims: DataFrame, kind: str, budget: int = 12) -> DataFrame:
    """Claims of a kind among twice the budget of retrieved ones, then cut: not the same as filtering first."""
    return retrieved(claims, 2 * budget).where(F.col("kind") == kind).orderBy(F.desc("score"), "id").limit(budget)


def grams(text: Column, stop: frozenset[str] | set[str] = frozenset(), least: int = 1) -> Column:
    """Distinct words and neighbouring pairs of lower-cased alphanumeric tokens without stop words; a plural's "s" is dropped from words of four letters or more."""
    keep = lambda t: (F.length(t) >= least) & (~t.isin(*sorted(stop)) if stop else F.lit(True))
    stem = lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)

    def pairs(t: Column) -> Column:
        return F.array_distinct(F.concat(t, F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))))

    return once(F.transform(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (t != "") & keep(t)), stem), pairs)


def bank_column(bank: list[tuple[str, float, list[str]]]) -> Column:
    """A bank of (label, value, grams) as one literal array; it is a parameter, so its size is known."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(label).alias("label"), F.lit(float(y)).alias("y"), F.array(*map(F.lit, g)).cast("array<string>").alias("g")) for i, (label, y, g) in enumerate(bank)])


def neighbours(own: Column, bank: list[tuple[str, float, list[str]]], k: int = NEIGHBOURS) -> Column:
    """The k most similar entries ``s, i, label, y`` (s: minus the overlap), ties in bank order."""
    near = F.transform(bank_column(bank), lambda e: F.struct((-set_overlap(own, e["g"])).alias("s"), e["i"].alias("i"), e["label"].alias("label"), e["y"].alias("y")))
    return F.slice(F.array_sort(near), 1, k)


def total(entries: Column, f) -> Column:
    return F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + f(e))


def knn_value(near: Column) -> Column:
    """Similarity-weighted mean of the neighbours' values, drawn to the prior where the best similarity is low."""

    def of(n: Column) -> Column:
        weight = total(n, lambda e: -e["s"])
        mean = F.when(weight > 0, total(n, lambda e: -e["s"] * e["y"]) / weight).otherwise(PRIOR)
        best = F.coalesce(-F.get(n, 0)["s"], F.lit(0.0))
        return PRIOR + (mean - PRIOR) * clamp01(best / SATURATES)

    return once(F.filter(near, lambda e: e["s"] < 0), of)


def structure(text: Column) -> Column:
    """What code blocks, length, requirements and steps add to a task's complexity."""
    size = F.greatest(F.lit(1), F.floor(F.length(text) / 4))
    wants = F.regexp_count(text, F.lit(r"(?im)(^\s*[-*\d.]|\b(must|should|ensure|require|constraint)\b)"))
    steps = F.regexp_count(text, F.lit(r"(?m)^\s*\d+[.)]\s")) + F.regexp_count(text, F.lit(r"(?i)\b(and then|after that|step \d)\b"))
    s = STRUCTURE
    return F.when(F.contains(text, F.lit("```")), s["code"]).otherwise(0.0) + s["length"] * clamp01(size / 150) + s["constraints"] * clamp01(wants / 5) + s["steps"] * clamp01(steps / 3)


def rubric(text: Column, own: Column, bank: list[tuple[str, float, list[str]]]) -> Column:
    """Complexity of a task: its topic by the bank, raised by its structure."""
    topic = knn_value(neighbours(own, bank))
    return clamp01(topic + structure(text) * (1 - topic))


def rubric_band(score_: Column) -> Column:
    return F.when(score_ < CHEAP_BELOW, "cheap").when(score_ <= MID_UPTO, "mid").otherwise("premium")


def voted(own: Column, bank: list[tuple[str, float, list[str]]], fallback: str = "none", least: float = LEAST_VOTE) -> Column:
    """``label, confidence``: the label with most similarity among the neighbours, or the fallback below the gate."""

    def of(n: Column) -> Column:
        best = F.coalesce(-F.get(n, 0)["s"], F.lit(0.0))
        sums = F.transform(n, lambda e, j: F.struct((-total(n, lambda o: F.when(o["label"] == e["label"], -o["s"]).otherwise(0.0))).alias("v"), j.alias("j"), e["label"].alias("label")))
        label = F.get(F.array_sort(sums), 0)["label"]
        return F.struct(F.when((F.size(own) > 0) & (best >= least), label).otherwise(fallback).alias("label"), best.alias("confidence"))

    return once(neighbours(own, bank), of)


def complexity(signals: dict[str, Column]) -> Column:
    """Weighted sum of the saturating signals; an absent one counts 0."""
    out = F.lit(0.0)
    for name, (w, full) in COMPLEXITY.items():
        if name in signals:
            out = out + w * clamp01(F.coalesce(signals[name], F.lit(0)) / full)
    return clamp01(out)


def recommended(score_: Column) -> Column:
    """Number of the tier, from the cheapest, for a complexity."""
    return F.when(score_ < 0.25, 0).when(score_ < 0.55, 1).when(score_ < 0.8, 2).otherwise(3)


def validity(confirmed: Column, contradicted: Column) -> Column:
    return (1 + F.coalesce(confirmed, F.lit(0))) / (2 + F.coalesce(confirmed, F.lit(0)) + F.coalesce(contradicted, F.lit(0)))


def freshness(last_day: Column, half_life: Column, now_day: int) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.lit(0), F.lit(now_day) - last_day) / half_life)


def match_score(symbols: Column, context_symbols: Column, file_hit: Column, words: Column, context_words: Column) -> Column:
    """1 for a common symbol, .6 for a file, else .3 of the words' overlap."""
    return F.when(F.arrays_overlap(symbols, context_symbols), 1.0).when(file_hit, 0.6).otherwise(0.3 * set_overlap(words, context_words))


def injected(lessons: DataFrame, now_day: int, by: list[str], budget: int = 12) -> DataFrame:
    """The best active lessons of each ``by`` with ``score``, and how many more there are.

    Needs ``id, status, match, confirmed, contradicted, last_day, half_life, scope``.
    """
    boost = F.when(F.lit(now_day) - F.col("last_day") <= 14, 1.2).otherwise(1.0)
    value = F.col("match") * freshness(F.col("last_day"), F.col("half_life"), now_day) * validity(F.col("confirmed"), F.col("contradicted")) * scope_weight(F.col("scope")) * boost
    ranked = lessons.where("status = 'active' and match > 0").withColumn("score", value)
    w = Window.partitionBy(*by)
    ranked = ranked.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "id"))).withColumn("overflow", F.greatest(F.lit(0), F.count("*").over(w) - budget))
    return ranked.where(F.col("rank") <= budget)


def glob_pattern(glob: Column) -> Column:
    """An anchored regular expression: ``**`` is anything, ``*`` anything but a slash."""
    escaped = F.regexp_replace(glob, r"([.+^${}()|\[\]\\?])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(escaped, r"\*\*", "\u0001"), r"\*", "[^/]*"), "\u0001", ".*"), F.lit("$"))


def history(files: DataFrame, incidents: DataFrame) -> DataFrame:
    """``file, weight, hits``: summed value and number of the incidents of each file; 0 without any."""
    sums = incidents.groupBy("file").agg(F.sum("val").alias("weight"), F.count("*").alias("hits"))
    return files.select("file").distinct().join(sums, "file", "left").select("file", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("hits", F.lit(0)).alias("hits"))


def rank_report(scores_: DataFrame, past: DataFrame, top: int = 15) -> DataFrame:
    """The files with most hazard: centrality over the largest, times one plus the past weight; rounded before they are ordered."""
    most = scores_.agg(F.max("score").alias("_most"))  # one row
    met = scores_.join(past, "file", "left").join(F.broadcast(most))
    hazard = F.round(F.col("score") / F.col("_most") * (1 + F.coalesce("weight", F.lit(0.0))), 6)
    return met.select("file", F.round("score", 6).alias("score"), F.coalesce("hits", F.lit(0)).alias("incidents"), hazard.alias("hazard")).orderBy(F.desc("hazard"), "file").limit(top)


def family_score(model_words: Column, family: Column, family_words: Column) -> Column:
    """Overlap of a model's words with a family's; 0 unless the family's own word is among them."""
    return F.when(F.array_contains(model_words, family), set_overlap(family_words, model_words)).otherwise(0.0)


def best_per_group(scored: DataFrame, by: str, score_: str, size: str, name: str) -> DataFrame:
    """``by, name``: the largest positive score, then the smallest size, then the name."""
    return scored.where(F.col(score_) > 0).groupBy(by).agg(F.min_by(name, F.struct(-F.col(score_), size, name)).alias(name))


def goal_drift(changed: DataFrame, by: str, on_goal: str, least: float = 0.6) -> DataFrame:
    """``by, off, drift``: changed files that the goal neither names nor nearly names, and their share."""
    off = F.count_if(F.col(on_goal) < least)
    return changed.groupBy(by).agg(off.alias("off"), (off / F.count("*")).alias("drift"))


def on_goal(hits: Column, p: float = 0.6) -> Column:
    """At least one of the hits is meant: 1 - (1 - p) ** hits."""
    return F.when(hits > 0, 1 - F.pow(F.lit(1 - p), hits)).otherwise(0.0)
