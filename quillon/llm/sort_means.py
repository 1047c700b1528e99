"""k-means by sort-means: exact integer Lloyd rounds in which most distances are never taken.

Vectors and centroids are integers, floor(scale * x).  In a round the other centroids are put in order of their distance from
each centroid; a vector scans that order from its previous centroid and stops at the first one strictly beyond twice its
distance from the previous one, since by the triangle inequality no centroid from there on is as near.  Equal
distances go to the smaller number, so the assignment is the one of a full scan.  Sums are exact; the driver holds
only centroids and their sums.

Only vectors of ``dim`` components, none null or non-finite, take part.  Repeated rows are vectors of their own.  Vectors with a
null id are assigned but start no centroid.  With fewer vectors than ``k`` there are as many centroids; without vectors no
rows.  Components beyond 2**26 count as that (so that distances fit 64 bits).  Sums of distances beyond 64 bits are clamped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util as U

_LIMIT = 1 << 26
_TOP = 2**63 - 1


def kept(vectors: DataFrame, dim: int = 64, scale: float = 64.0) -> DataFrame:
    """``vec_id, x`` (array<int>) of the vectors that take part."""
    whole = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(_LIMIT))), F.lit(float(-_LIMIT)))).cast("int"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where("embedding IS NOT NULL").where(F.size("embedding") == dim).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def seeds(x: DataFrame, k: int, prefix: str = "1:") -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``prefix`` and id, in that order; vectors of one id in their own order."""
    rows = x.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances between centroids, and for each centroid the others' numbers from near to far."""
    apart = np.array([((centroids - c) ** 2).sum(1) for c in centroids])
    return apart, np.argsort(apart, axis=1, kind="stable")


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, apart: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance) of each row, scanning from its previous one, and the number of distances taken."""
    cluster, taken = before.astype(np.int64), len(x)
    first = ((x - centroids[before]) ** 2).sum(1)
    best = first.copy()
    for a in np.unique(before):
        rows = np.flatnonzero(before == a)
        rows = rows[np.argsort(-first[rows], kind="stable")]  # those that scan furthest come first
        for j in order[a]:
            if j == a:
                continue
            # strictly beyond twice: |a j| > 2 d, in squares; whole numbers, so no rounding
            rows = rows[: np.count_nonzero(apart[a, j] <= 4 * first[rows])]
            if not len(rows):
                break
            d = ((x[rows] - centroids[j]) ** 2).sum(1)
            taken += len(rows)
            nearer = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
            cluster[rows[nearer]], best[rows[nearer]] = j, d[nearer]
    return cluster, best, taken


def _assign(centroids: np.ndarray):
    def assign(batches):
        apart, order = neighbours(centroids)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"), centroids.shape[1])
            before = b.column("cluster").to_numpy(zero_copy_only=False)
            cluster, best, _ = nearest(x, before, centroids, apart, order)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(cluster.astype(np.int32)), pa.array(best)], names=["vec_id", "x", "cluster", "distance"])

    return assign


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(k: int, dim: int):
    def sums(batches):
        total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, c = _matrix(b.column("x"), dim), b.column("cluster").to_numpy(zero_copy_only=False)
            for j in np.unique(c):
                total[j] += x[c == j].sum(0)
                n[j] += np.count_nonzero(c == j)
        some = np.flatnonzero(n)
        if len(some):
            parts = [[*total[j].tolist(), int(n[j])] for j in some]
            cluster, at = np.repeat(some, dim + 1), np.tile(np.arange(dim + 1), len(some))
            yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(at), pa.array(np.array(parts).ravel())], names=["cluster", "at", "part"])

    return sums


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, prefix: str = "1:") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part, after ``rounds`` rounds and one more assignment."""
    spark = vectors.sparkSession
    state = U.stored(kept(vectors, dim, scale).withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), "vectors")
    centroids = seeds(state, k, prefix)
    schema = "vec_id long, x array<int>, cluster int, distance long"
    shape = (len(centroids), dim)
    if not len(centroids):
        U.drop_stored(state, settle_=False)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for r in range(rounds + 1):
        nxt = U.stored(state.mapInArrow(_assign(centroids), schema), "vectors")
        U.drop_stored(state, settle_=False)
        state = nxt
        if r == rounds:
            break
        total: dict[int, list[int]] = {}
        parts = state.select("x", "cluster").mapInArrow(_sums(*shape), "cluster long, at long, part long")
        for row in parts.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():  # k * (dim + 1) rows
            total.setdefault(row.cluster, [0] * (dim + 1))[row["at"]] = int(row.part)
        for c, t in total.items():
            centroids[c] = [s // t[dim] for s in t[:dim]]
    clamp = lambda v: int(min(v, _TOP))
    inertia = {r.cluster: int(r.s) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = clamp(sum(inertia.values()))
    rows = [(c, clamp(s), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = U.stored(state.drop("x").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters")
    U.drop_stored(state, settle_=False)
    return out
