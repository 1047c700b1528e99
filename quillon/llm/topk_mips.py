"""Exact top-k inner products by norm-sorted blocks and rotated partial sums.

Vectors are integer: floor(scale * x) of each component.  They are cut by length into
bands (longest first) and bands into bounded blocks.  A first pass scores every query
against the longest vectors, which gives a floor under its k-th best score; by
Cauchy-Schwarz, |q| |v| below that floor rules a vector out, so a query meets only a
prefix of the bands.  Within a block the vectors go in order of length: both sides are
rotated by the singular vectors of the data, the first coordinates give a partial sum,
and |rest of q| |rest of v| bounds what is left; only pairs whose bound reaches the
query's floor are scored, by an exact integer product (one matrix product for a block
where most pairs are left; whole numbers of this size are exact in doubles).  Bounds carry a slack above the
rounding of doubles, so no pair is lost.

Rows whose id or vector is null, or with a null or non-finite component, take no part.
Exact repeats of a row count once; a row with the query's id is the query's own; of
several rows with one id the best score counts.  Shorter vectors count as padded with
zeros.  Scores beyond 64 bits are clamped.  Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _util as U

#: Bands of length, rows of a block, queries of a block, longest vectors in the first pass.
BANDS = 64
BLOCK = 4_096
QUERIES = 2_048
HEAD = 1_024
#: Coordinates in the first partial sum, as a share of all.
FIRST = 0.25
#: Vectors of a block that are bounded at once.
STEP = 512
#: Where more than one in ``DENSE`` pairs is still open, all are scored by one matrix product.
DENSE = 16
#: Components up to here have exact products in doubles (dimension up to 2**13).
SMALL = 1 << 20


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row-wise integer products of equal-length lists of vectors, clamped to 64 bits."""
    if max(np.abs(q).max(initial=0), np.abs(v).max(initial=0)) <= SMALL:
        return np.einsum("ij,ij->i", q, v).astype(np.int64)
    lo, hi = -(2**63), 2**63 - 1
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(x, y)), lo), hi) for x, y in zip(q, v)], np.int64)


def _matrix(col, dim: int) -> np.ndarray:
    out = np.zeros((len(col), dim))
    for i, x in enumerate(col):
        out[i, : len(x)] = x
    return out


def _best(qi: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int, repeats: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score descending, id ascending) for each query; of equal ids (``repeats``: there may be some) the best score only."""
    if repeats and len(qi):
        order = np.lexsort((s, ids, qi))
        qi, ids, s = qi[order], ids[order], s[order]
        last = np.concatenate(((qi[1:] != qi[:-1]) | (ids[1:] != ids[:-1]), [True]))
        qi, ids, s = qi[last], ids[last], s[last]
    order = np.lexsort((ids, -s.astype(np.float64), qi)) if np.abs(s).max(initial=0) < 2**53 else np.array(sorted(range(len(s)), key=lambda i: (qi[i], -int(s[i]), ids[i])), np.int64)
    qi, ids, s = qi[order], ids[order], s[order]
    start = np.concatenate(([0], np.flatnonzero(np.diff(qi)) + 1)) if len(qi) else np.empty(0, np.int64)
    rank = np.arange(len(qi)) - np.repeat(start, np.diff(np.concatenate((start, [len(qi)]))))
    keep = rank < k
    return qi[keep], ids[keep], s[keep]


def search_block(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, vid: np.ndarray, v: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top k of a block for each query: (row of query, vector id, score) that may still count."""
    length = np.sqrt((v * v).sum(1))
    order = np.argsort(-length, kind="stable")
    v, vid, length = v[order], vid[order], length[order]
    ql = np.sqrt((q * q).sum(1))
    w = max(1, int(FIRST * q.shape[1]))
    qr, vr = q @ turn, v @ turn
    qrest, vrest = np.sqrt((qr[:, w:] ** 2).sum(1)), np.sqrt((vr[:, w:] ** 2).sum(1))
    floor = floor.astype(np.float64).copy()
    repeats = len(np.unique(vid)) < len(vid)
    small = max(np.abs(q).max(initial=0), np.abs(v).max(initial=0)) <= SMALL
    held: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.empty(0, np.int64),) * 3
    for lo in range(0, len(v), STEP):
        hi = min(lo + STEP, len(v))
        slack = 1e-9 * ql * length[lo] + 1e-6
        live = np.flatnonzero(ql * length[lo] + slack >= floor)
        if not len(live):
            break
        bound = qr[live, :w] @ vr[lo:hi, :w].T + np.outer(qrest[live], vrest[lo:hi]) + slack[live, None]
        open_ = (bound >= floor[live, None]) & (qid[live, None] != vid[None, lo:hi])
        rows, cols = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(rows):
            continue
        if small and open_.sum() * DENSE > len(rows) * len(cols):  # most pairs are open: one exact product for all of them
            whole = q[live[rows]] @ v[lo + cols].T
            a, b = np.nonzero(open_[np.ix_(rows, cols)] & (whole >= floor[live[rows], None]))
            s, a, b = whole[a, b].astype(np.int64), live[rows[a]], cols[b]
        else:
            a, b = np.nonzero(open_)
            a = live[a]
            s = np.concatenate([exact_scores(q[a[i : i + 65536]], v[lo + b[i : i + 65536]]) for i in range(0, len(a), 65536)])
            kept = s.astype(np.float64) >= floor[a] * (1 - 1e-12) - 1e-6
            a, b, s = a[kept], b[kept], s[kept]
        held = _best(np.concatenate((held[0], a)), np.concatenate((held[1], vid[lo + b])), np.concatenate((held[2], s)), k, repeats)
        full = np.flatnonzero(np.bincount(held[0], minlength=len(q)) >= k)
        ends = np.searchsorted(held[0], full, side="right") - 1
        floor[full] = np.maximum(floor[full], held[2][ends])
    return held


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(sound)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), _quantised(vector_col, scale).alias("v")).distinct()
    rows = U.stored(rows.withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), "vectors")

    cuts = rows.agg(F.percentile_approx("len", [i / BANDS for i in range(1, BANDS)], 10_000).alias("c"), F.max(F.size("v")).alias("d"), F.max("len").alias("top"), F.count("*").alias("n")).first()
    if not cuts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, cuts["d"])
    edges = sorted(set(cuts["c"]), reverse=True)  # descending: band 0 has the longest
    tops = [cuts["top"], *edges]  # the greatest length of each band
    turn = _rotation(rows, dim)
    sent = spark.sparkContext.broadcast(turn)  # dim * dim numbers
    band = F.lit(0)
    for e in edges:
        band = band + (F.col("len") <= e).cast("int")
    rows = rows.withColumn("band", band)
    subs = {r["band"]: -(-r["n"] // BLOCK) for r in rows.groupBy("band").agg(F.count("*").alias("n")).collect()}  # at most BANDS rows
    sub_of = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(subs.items()) for x in kv]), F.col("band"))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("id"), sub_of).cast("int"))

    head = rows.orderBy(F.desc("len"), "id").limit(HEAD).select("id", "v").toArrow()  # at most HEAD rows
    hid, hv = head.column(0).to_numpy(), _matrix(head.column(1).to_pylist(), dim)
    known = spark.sparkContext.broadcast((hid, hv))
    n_queries = rows.where(F.col("id") % every == 0).count()
    blocks = max(1, -(-n_queries // QUERIES))

    def first(batches):
        hid, hv = known.value
        for b in batches:
            ids = b.column(0).to_numpy()
            q = _matrix(b.column(1).to_pylist(), dim)
            floor = np.full(len(q), -np.inf)
            if len(q):
                a, _, s = search_block(ids, q, floor, hid, hv, sent.value, k)
                counts = np.bincount(a, minlength=len(q))
                full = np.flatnonzero(counts >= k)
                floor[full] = s[np.searchsorted(a, full, side="right") - 1]
            length = np.sqrt((q * q).sum(1))
            reach = [int(np.sum(np.array(tops) * x * (1 + 1e-9) + 1e-6 >= f)) - 1 for x, f in zip(length, floor)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(floor, pa.float64()), pa.array(reach, pa.int32())], ["id", "v", "floor", "reach"])

    queries = rows.where(F.col("id") % every == 0).select("id", "v").mapInArrow(first, "id long, v array<double>, floor double, reach int")
    queries = U.stored(queries.withColumn("qb", F.pmod(F.xxhash64(F.lit("q"), "id"), F.lit(blocks)).cast("int")), "queries")
    reach = {r["qb"]: r["m"] for r in queries.groupBy("qb").agg(F.max("reach").alias("m")).collect()}  # one row for each query block
    reach_df = spark.createDataFrame(list(reach.items()) or [(0, -1)], "qb int, m int")

    # Corpus rows go to every query block that their band may matter to; queries to every block of those bands.
    corpus = rows.select("id", "v", "band", "sub").join(F.broadcast(reach_df), F.col("band") <= F.col("m")).select("id", "v", "band", "sub", "qb")
    sub_rows = spark.createDataFrame([(b, s) for b, n in subs.items() for s in range(n)], "band int, sub int")
    asked = queries.join(F.broadcast(sub_rows), F.col("band") <= F.col("reach")).select("id", "v", "floor", "band", "sub", "qb")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
        qid = right["id"].to_numpy()
        a, ids, s = search_block(qid, _matrix(right["v"], dim), right["floor"].to_numpy(), left["id"].to_numpy(), _matrix(left["v"], dim), sent.value, k)
        return pd.DataFrame({"query_id": qid[a], "vec_id": ids, "score": s})

    keys = ["band", "sub", "qb"]
    found = corpus.groupBy(keys).cogroup(asked.groupBy(keys)).applyInPandas(meet, "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _quantised(col: str, scale: float):
    """floor(scale * x) as doubles: whole numbers, exact also where they exceed a long."""

    @F.pandas_udf("array<double>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.floor(np.asarray(x, np.float64) * scale))

    return f(F.col(col))


def _rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all the data, from sums of outer products."""

    def outer(batches):
        g = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column(0).to_pylist(), dim)
            m /= np.maximum(1.0, np.abs(m).max(initial=0))
            g += m.T @ m
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(dim), pa.int32()), "g": pa.array(list(g), pa.list_(pa.float64()))})

    sums = rows.select("v").mapInArrow(outer, "i int, g array<double>").select("i", F.posexplode("g").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    g = np.zeros((dim, dim))
    g[sums.column(0).to_numpy(), sums.column(1).to_numpy()] = sums.column(2).to_numpy()
    return np.linalg.eigh(np.nan_to_num(g + g.T))[1][:, ::-1].copy()
