"""Joins of edges, names and paths, stated as equi-joins so that no nested loop is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolved_edges(edges: DataFrame, nodes: DataFrame, discount: float = 0.9) -> DataFrame:
    """Edges ``src, target, confidence`` with ``dst``: the node whose id, else qname, else unique name is the target.

    A match by name costs ``discount`` of the confidence; without a match ``dst`` is null.
    """
    by_id = nodes.select(F.col("id").alias("target"), F.col("id").alias("d1")).distinct()
    by_q = nodes.groupBy(F.col("qname").alias("target")).agg(F.min("id").alias("d2"))
    by_name = nodes.groupBy(F.col("name").alias("target")).agg(F.min("id").alias("d3"), F.count("*").alias("k")).where("k = 1").drop("k")
    out = edges.join(by_id, "target", "left").join(by_q, "target", "left").join(by_name, "target", "left")
    named = F.col("d1").isNull() & F.col("d2").isNull() & F.col("d3").isNotNull()
    return out.select(*edges.drop("confidence").columns, F.coalesce("d1", "d2", "d3").alias("dst"), F.when(named, F.col("confidence") * discount).otherwise(F.col("confidence")).alias("confidence"))


def longest_prefix(items: DataFrame, key: str, path: str, names: DataFrame, name: str) -> DataFrame:
    """``key, name``: the longest name that is the path or is followed in it by / or a dot.

    Every path is split into its own prefixes, which then meet the names by equality.
    """
    cuts = F.filter(F.sequence(F.lit(1), F.length(path)), lambda i: (i == F.length(path)) | F.substring(F.col(path), i + 1, F.lit(1)).isin("/", "."))
    split = items.where(F.length(path) > 0).select(key, F.explode(F.transform(cuts, lambda i: F.substring(F.col(path), F.lit(1), i))).alias(name))
    return split.join(names.select(name).distinct(), name).groupBy(key).agg(F.max_by(name, F.length(name)).alias(name))


def prefix_hits(goals: DataFrame, words: DataFrame, key: str, token: str) -> DataFrame:
    """``key, hits``: goal tokens of a key that equal one of its words or, from four letters, start it or are started by it.

    Such tokens share their first four letters, which is what the join is on.
    """
    g = goals.select(key, F.col(token).alias("g"), F.when(F.length(token) >= 4, F.substring(token, 1, 4)).otherwise(F.col(token)).alias("k")).distinct()
    w = words.select(key, F.col(token).alias("w"), F.when(F.length(token) >= 4, F.substring(token, 1, 4)).otherwise(F.col(token)).alias("k")).distinct()
    met = g.join(w, [key, "k"]).where((F.col("g") == F.col("w")) | ((F.length("g") >= 4) & (F.startswith("w", "g") | ((F.length("w") >= 4) & F.startswith("g", "w")))))
    return met.groupBy(key).agg(F.count_distinct("g").alias("hits"))


def strongest(edges: DataFrame, keys: list[str], confidence: str = "confidence") -> DataFrame:
    """One row for each key: the largest confidence."""
    return edges.groupBy(*keys).agg(F.max(confidence).alias(confidence))


def collisions(files: DataFrame, mine: DataFrame, edges: DataFrame) -> DataFrame:
    """``session, direct, coupled, strength`` of sessions (``session, file``) that touch my files or their neighbours (``src, dst``)."""
    mine = mine.select("file").distinct()
    near = edges.join(mine, edges["src"] == mine["file"]).select(F.col("dst").alias("file")).distinct().join(mine, "file", "left_anti")
    n = F.lit(max(1, mine.count()))
    marked = mine.withColumn("w", F.lit(1.0)).union(near.withColumn("w", F.lit(0.5)))
    met = files.select("session", "file").distinct().join(marked, "file").groupBy("session")
    out = met.agg(F.count_if(F.col("w") == 1).alias("direct"), F.count_if(F.col("w") < 1).alias("coupled"), F.sum("w").alias("s"))
    return out.select("session", "direct", "coupled", F.round(F.least(F.col("s") / n, F.lit(1.0)), 4).alias("strength"))


def recurred(rows: DataFrame, id_col: str, keys: Column) -> DataFrame:
    """``id_col, recurred``: whether an earlier row shares one of the keys (an array); null and empty arrays never do."""
    opened = rows.select(id_col, F.explode_outer(F.array_distinct(keys)).alias("k"))
    first = opened.where("k is not null").groupBy("k").agg(F.min(id_col).alias("first"))
    return opened.join(first, "k", "left").groupBy(id_col).agg(F.coalesce(F.max(F.col("first") < F.col(id_col)), F.lit(False)).alias("recurred"))


def directory_edges(edges: DataFrame, src: str, dst: str, top: int = 9) -> DataFrame:
    """Counts of edges between the ``top`` directories with most ends; edges inside one are left out."""
    pairs = edges.where(F.col(src) != F.col(dst)).groupBy(src, dst).agg(F.count("*").alias("n"))
    ends = pairs.select(F.col(src).alias("d"), "n").union(pairs.select(F.col(dst).alias("d"), "n")).groupBy("d").agg(F.sum("n").alias("k"))
    kept = F.broadcast(ends.orderBy(F.desc("k"), "d").limit(top).select("d"))  # top rows
    return pairs.join(kept.withColumnRenamed("d", src), src, "left_semi").join(kept.withColumnRenamed("d", dst), dst, "left_semi")


def preferred(rows: DataFrame, key: str, retired: str, last: str, id_col: str) -> DataFrame:
    """One row of a key: live before retired, then the latest confirmed, then the smallest id."""
    w = Window.partitionBy(key).orderBy(F.col(retired).asc(), F.col(last).desc(), F.col(id_col).asc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def states(names: DataFrame, checks: DataFrame, name: str) -> DataFrame:
    """State of every name: without a check, or with one that does not apply (``ok`` null), UNAVAILABLE."""
    each = checks.groupBy(name).agg(F.bool_and("ok").alias("ok"))
    return names.join(each, name, "left").select(name, F.when(F.col("ok").isNull(), "UNAVAILABLE").when(F.col("ok"), "ACTIVE").otherwise("DEGRADED").alias("state"))
