"""Splits by position, and a small logistic model trained in row order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def prequential(rows: DataFrame, by: str, order: str, share: float = 0.8) -> DataFrame:
    """Adds ``train``: whether a row is among the first ``share`` (rounded down) of its group."""
    w = Window.partitionBy(by)
    n = F.row_number().over(w.orderBy(order))
    return rows.withColumn("train", n <= F.floor(F.count("*").over(w) * F.lit(share)))


def strided(rows: DataFrame, by: str, order: str, step: int = 5) -> DataFrame:
    """Adds ``held_out``: every ``step``-th row of its group, the first of them at position 0."""
    return rows.withColumn("held_out", (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) % step == 0)


def train_logistic(rows: DataFrame, by: str, order: str, features: list[str], label: str, epochs: int = 300, rate: float = 0.3) -> DataFrame:
    """``by, bias, <features>``: weights after passes over a group's rows in order; null features count as 0.

    Each step depends on the one before, so a group is one task's work; a group must fit one task.
    """
    kind = rows.schema[by].dataType.simpleString()

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(order, kind="stable")
        x = np.column_stack([np.ones(len(g)), g[features].fillna(0).to_numpy(float)])
        y, w = g[label].to_numpy(float), np.zeros(len(features) + 1)
        for _ in range(epochs):
            for xi, yi in zip(x, y):
                w -= rate * (1 / (1 + np.exp(-(xi @ w))) - yi) * xi
        return pd.DataFrame({by: [g[by].iloc[0]], "bias": w[:1]} | {f: [v] for f, v in zip(features, w[1:])})

    columns = ", ".join(f"{c} double" for c in ["bias", *features])
    return rows.select(by, order, *features, label).groupBy(by).applyInPandas(fit, f"{by} {kind}, {columns}")


def cover(covers: DataFrame, by: str, item: str, element: str, weight: str) -> DataFrame:
    """``by, place, item``: greedy cover of a group's elements, least weight for each new element, ties by item.

    A choice depends on all before it, so a group (one change set) is one task's work.
    """
    kinds = {c: covers.schema[c].dataType.simpleString() for c in (by, item)}

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        sets = {k: set(v) for k, v in group.groupby(item)[element]}
        cost = group.groupby(item)[weight].max().to_dict()
        open_, chosen = set().union(*sets.values()), []
        while open_:
            best = min((k for k in sets if sets[k] & open_), key=lambda k: (cost[k] / len(sets[k] & open_), k))
            chosen.append(best)
            open_ -= sets[best]
        return pd.DataFrame({by: [group[by].iloc[0]] * len(chosen), "place": range(1, len(chosen) + 1), item: chosen})

    return covers.select(by, item, element, weight).dropna().groupBy(by).applyInPandas(choose, f"{by} {kinds[by]}, place long, {item} {kinds[item]}")
