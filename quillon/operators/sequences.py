"""Ordered event logs: recurrence, charts, islands, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nth_occurrence(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def ring_recurrence(df: DataFrame, by: str, order: str, signature: str, size: int = 50) -> DataFrame:
    """How often the row's signature occurs in the last ``size`` rows of its log, itself included."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(size - 1), 0)
    return df.withColumn("_ring", F.collect_list(signature).over(w)).withColumn("hits", F.expr(f"size(filter(_ring, x -> x = {signature}))")).drop("_ring")


def cusum(df: DataFrame, by: str, order: str, value: Column, k: float = 0.35, h: float = 1.0) -> DataFrame:
    """One-sided chart C = max(0, C + d - k) in closed form; alarm where C exceeds h."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = df.withColumn("_s", F.sum(F.coalesce(value, F.lit(0.0)) - k).over(w))
    c = F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(w))
    return s.withColumn("c", c).withColumn("alarm", F.col("c") > h).drop("_s")


def islands(df: DataFrame, by: str, order: str, ends: Column) -> DataFrame:
    """Number of the stretch that a row is in; a row where ``ends`` holds closes its stretch."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("island", F.coalesce(F.sum(ends.cast("int")).over(w), F.lit(0)))


def last_before(df: DataFrame, by: str, order: str, value: Column, name: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, take: list[str]) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    Both sides are put into one ordered log for each key and the latest right values are
    carried forward: one shuffle and no pair rows.
    """
    r = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(right_time).alias("at"), *take).alias("_r"))
    r = r.groupBy(key, "_t", "_side").agg(F.max("_r").alias("_r"))
    l = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*left.columns, F.col("_r.at").alias(right_time), *[F.col(f"_r.{c}").alias(c) for c in take])


def price_windows(facts: DataFrame, windows: DataFrame, day: str) -> DataFrame:
    """Each fact of a priced key with ``price``: of the first window (by ``ord``) of its key that contains its day, else the key's ``flat`` price.

    A key has few windows; they travel as one array, so no pair of fact and window is a row.
    """
    listed = windows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "from_day", "until_day", F.col("price").alias("p")))).alias("_w"), F.max("flat").alias("_flat"))
    inside = lambda w: (F.col(day) >= w["from_day"]) & (w["until_day"].isNull() | (F.col(day) <= w["until_day"]))
    first = F.get(F.filter("_w", inside), 0)
    return facts.join(listed, "key").withColumn("price", F.coalesce(first["p"], F.col("_flat"))).drop("_w", "_flat")
