"""Telemetry aggregates, evaluation measures and least-squares fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.rounds import Rounds
from .running import running

# What a cache outcome is worth.
CACHE_WORTH = {"exact": 1.0, "near": 0.85, "adapt": 0.5}


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null: what is not measured is not 0."""
    return F.when(b != 0, a / b)


def stage_factors(events: DataFrame) -> DataFrame:
    """One row: the gate's, cache's, route's and context's factor; null where a stage has no rows.

    The route's rows have a ``cost`` and a ``premium`` cost where they can be priced.
    """
    stage, outcome = F.col("stage"), F.col("outcome")
    worth = F.lit(0.0)
    for name, w in CACHE_WORTH.items():
        worth = F.when(outcome == name, w).otherwise(worth)
    saved = F.sum(F.when(stage == "context", F.col("saved")))
    used = F.sum(F.when(stage == "context", F.col("used")))
    return events.agg(
        ratio(F.count_if((stage == "gate") & (outcome == "halt")), F.count_if(stage == "gate")).alias("gate"),
        F.avg(F.when(stage == "cache", worth)).alias("cache"),
        _route(events).alias("route"),
        ratio(saved, saved + used).alias("context"),
    )


def _route(events: DataFrame) -> Column:
    if not {"cost", "premium"} <= set(events.columns):
        return F.lit(None).cast("double")
    priced = (F.col("stage") == "route") & F.col("cost").isNotNull() & F.col("premium").isNotNull()
    return 1 - ratio(F.sum(F.when(priced, F.col("cost"))), F.sum(F.when(priced, F.col("premium"))))


def composed_reduction(factors: DataFrame, factor: str = "factor") -> DataFrame:
    """1 - prod(1 - f) over the measured factors; null when none is."""
    return factors.where(F.col(factor).isNotNull()).agg((1 - F.product(1 - F.col(factor))).alias("reduction"))


def summarised(events: DataFrame) -> DataFrame:
    return events.groupBy("stage", "outcome").agg(F.count("*").alias("n"), F.sum(F.when(~F.isnan("saved"), F.col("saved"))).alias("saved"))


def median_p95(df: DataFrame, by: str, value: str) -> DataFrame:
    """Interpolated median and nearest-rank 95th percentile of each group, exact; null values do not count.

    Equal values are counted first, and the counts are summed in order by ranges, so a group of any size is many tasks' work.
    """
    kept = Rounds(df.sparkSession, "ranks")
    counts = kept.keep(df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_k")))
    upto = running(kept, counts, ["_v"], [by], adds=["_k"])
    of = kept.keep(counts.groupBy(by).agg(F.sum("_k").alias("_n")))
    ranked = upto.withColumn("_by", F.struct(by)).join(of.select(F.struct(by).alias("_by"), "_n"), "_by")
    at = lambda rank: F.max(F.when((F.col("run__k") >= rank) & (F.col("run__k") - F.col("_k") < rank), F.col("_v")))
    low, high = F.expr("(_n + 1) div 2"), F.expr("(_n + 2) div 2")
    return kept.result(ranked.groupBy("_by").agg(at(low).alias("low"), at(high).alias("high"), at(F.expr("(95 * _n + 99) div 100")).alias("p95")).select(F.col("_by")[by].alias(by), ((F.col("low") + F.col("high")) / 2).alias("median"), "p95"))


def average_precision(scored: DataFrame, by: str, score: str = "score", label: str = "label", order: str = "ord") -> DataFrame:
    """Mean over the positives of precision at their rank (score descending, ties by ``order``); hits and ranks are sums by ranges."""
    kept = Rounds(scored.sparkSession, "precision")
    rows = kept.keep(scored.select(by, (-F.col(score)).alias("_turn"), F.col(order).alias("_ord"), F.col(label).cast("long").alias("_y"), F.lit(1).cast("long").alias("_one")))
    p = running(kept, rows, ["_turn", "_ord"], [by], adds=["_y", "_one"]).withColumn("p", F.col("run__y") / F.col("run__one"))
    return kept.result(p.groupBy(by).agg(ratio(F.sum(F.when(F.col("_y") == 1, F.col("p"))), F.sum("_y")).alias("ap")))


def precision_recall(predicted: DataFrame, expected: DataFrame, case: str, item: str) -> DataFrame:
    """Precision, recall and F1 of each case; both sets empty cannot occur in rows."""
    p = predicted.select(case, item).distinct().withColumn("p", F.lit(1))
    t = expected.select(case, item).distinct().withColumn("t", F.lit(1))
    g = p.join(t, [case, item], "full_outer").groupBy(case).agg(F.count("p").alias("np"), F.count("t").alias("nt"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"))
    pr = F.when(F.col("np") == 0, F.when(F.col("nt") == 0, 1.0).otherwise(0.0)).otherwise(F.col("tp") / F.col("np"))
    rc = F.when(F.col("nt") == 0, 1.0).otherwise(F.col("tp") / F.col("nt"))
    g = g.select(case, pr.alias("precision"), rc.alias("recall"))
    return g.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def line_fit(df: DataFrame, by: str, y: str, x: str) -> DataFrame:
    """Least-squares slope and intercept; slope 1 where x does not vary."""
    slope = F.coalesce(F.regr_slope(y, x), F.lit(1.0))
    return df.groupBy(by).agg(slope.alias("slope"), F.coalesce(F.regr_intercept(y, x), F.avg(y) - F.avg(x)).alias("intercept"))


def nearest(vectors: DataFrame, k: int = 3, every: int = 50, block: int = 2_048) -> DataFrame:
    """``query_id, rank, vec_id, sim``: the ``k`` largest cosines (9 decimals; ties: the smaller id) of each row whose ``vec_id`` is divisible by ``every`` with all rows of other ids.

    Blocks of queries meet blocks of rows; of each pair of blocks only the best ``k`` go on.
    Rows with a null id or vector take no part; a zero vector has cosine 0.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = rows.where(F.col("id") % every == 0)
    n_rows, n_asked = rows.count(), asked.count()
    right, left = max(1, -(-n_rows // block)), max(1, -(-n_asked // block))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    q = asked.withColumn("qb", deal(left)).select(F.col("id").alias("query_id"), F.col("v").alias("q"), "qb").join(F.broadcast(spark.range(right).select(F.col("id").alias("vb"))))
    v = rows.withColumn("vb", deal(right)).select(F.col("id").alias("vec_id"), F.col("v").alias("e"), "vb").join(F.broadcast(spark.range(left).select(F.col("id").alias("qb"))))

    def unit(col, dim):
        m = np.zeros((len(col), dim))
        for i, x in enumerate(col):
            m[i, : len(x)] = x
        n = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def meet(a, b):
        out = {"query_id": [], "vec_id": [], "sim": []}
        if len(a) and len(b):
            dim = max(1, a["q"].map(len).max(), b["e"].map(len).max())
            ids, asks = b["vec_id"].to_numpy(), a["query_id"].to_numpy()
            sims = unit(a["q"], dim) @ unit(b["e"], dim).T
            for i, s in zip(asks, sims):
                other = np.flatnonzero(ids != i)
                best = other[np.lexsort((ids[other], -np.round(s[other], 9)))[:k]]
                out["query_id"] += [i] * len(best)
                out["vec_id"] += ids[best].tolist()
                out["sim"] += s[best].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "sim": "float64"})

    q, v = (x.withColumns({"qb": F.col("qb").cast("int"), "vb": F.col("vb").cast("int")}) for x in (q, v))
    found = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(meet, "query_id long, vec_id long, sim double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "sim")


def report(events: DataFrame) -> DataFrame:
    """``item, value``: number of events and finite tokens saved, every stage's factor, and a caveat (value null) for each stage that nothing was recorded for."""
    wide = stage_factors(events)
    stages = ("gate", "cache", "route", "context")
    factors = wide.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("double").alias("value")) for s in stages])).alias("f")).select("f.*")
    rows = factors.select(F.when(F.col("value").isNull(), F.concat(F.lit("unmeasured: "), "stage")).otherwise(F.col("stage")).alias("item"), "value")
    finite = F.when(~F.isnan("saved") & (F.abs("saved") < float("inf")), F.col("saved"))
    totals = events.agg(F.count("*").cast("double").alias("events"), F.coalesce(F.sum(finite), F.lit(0.0)).alias("saved tokens"))
    return totals.unpivot([], ["events", "saved tokens"], "item", "value").union(rows)
