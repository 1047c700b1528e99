"""Exact joins on sketches: pairs that agree in a given share of lanes, found through groups of lanes.

A pair that agrees in ``need`` of ``LANES`` lanes differs in at most LANES - need, so when the lanes are cut into
LANES - need + 1 groups, some group is equal throughout.  Every sketch enters one bucket for each of its groups, and each
qualifying pair meets in a bucket: nothing is missed, whatever the data.  Buckets hold ids only; sketches are
fetched for the pairs that meet.  Equal sketches are one class from the start.  A crowded bucket is not paired.  ``clusters`` deals
the members of all crowded buckets into blocks, and blocks that share buckets meet once; ``best_matches`` cuts a crowded bucket
again, by another grouping of the lanes, since its qualifying pairs have an equal group there too, and compares what is still
crowded then block against block.
"""

from __future__ import annotations

import ctypes
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.rounds import Rounds
from .graph import labelled
from .sketches import ADAPT, BANDS, FNV_PRIME, FNV_START, LANE_A, LANE_B, LANES, NEAR

#: Members of a bucket that are paired, rows of a block.
CROWD = 64
BLOCK = 512
#: Bytes of texts that are hashed at once, and shingles so few that they are hashed one by one.
SLICE = 1 << 18
FEW = 16
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(97, 123)]] = True


def _stretches(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all texts as stretches of one buffer: (buffer, first, length, number of each text's, in order)."""
    joined = "\n".join((t or "").lower().replace("\n", " ") for t in texts).encode("ascii", "replace")
    raw = np.frombuffer(joined, np.uint8)
    token = _TOKEN[raw]
    ends = token & ~np.append(token[1:], False)
    # one space after each token, nothing else between tokens: a shingle is then one stretch of this buffer
    keep = np.flatnonzero(token)
    place = np.cumsum(token) + np.cumsum(np.concatenate(([0], ends[:-1]))) - 1 if len(raw) else np.empty(0, np.int64)
    clean = np.full(len(keep) + int(ends.sum()), 32, np.uint8)
    clean[place[keep]] = raw[keep]
    first = place[np.flatnonzero(token & ~np.concatenate(([False], token[:-1])))] if len(raw) else np.empty(0, np.int64)
    last = place[np.flatnonzero(ends)] + 1
    row = np.searchsorted(np.flatnonzero(raw == 10), np.flatnonzero(ends))
    count = np.bincount(row, minlength=len(texts))
    start = np.cumsum(count) - count
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)
    through = at + np.repeat(np.minimum(n, count), size) - 1
    return clean, first[at], last[through] - first[at], size


def sketches_of(texts: list[str | None], n: int = 4) -> np.ndarray:
    """The sketch of each text (rows of ``LANES`` 32-bit lanes), all texts at once; the values of ``sketches.sketch_of``."""
    clean, first, length, size = _stretches(texts, n)
    h = _fnv(clean, first, length)
    out = np.full((len(texts), LANES), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(size)
    if len(some):
        cuts = (np.cumsum(size) - size)[some]
        for k in range(1, LANES + 1):
            a, b = (k * LANE_A | 1) & 0xFFFFFFFF, k * LANE_B & 0xFFFFFFFF
            out[some, k - 1] = np.minimum.reduceat(h * np.uint32(a) + np.uint32(b), cuts)
    return out


def shingle_counts_of(texts: list[str | None], n: int = 4) -> np.ndarray:
    """Number of distinct shingles of each text, told apart by two 32-bit hashes and their length."""
    clean, first, length, size = _stretches(texts, n)
    row = np.repeat(np.arange(len(texts)), size)
    h = _fnv(clean, first, length).astype(np.uint64) << np.uint64(32) | _fnv(clean, first, length, FNV_START ^ 0x5BD1E995)
    order = np.lexsort((length, h, row))
    row, h, length = row[order], h[order], length[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1]) | (length[1:] != length[:-1]))) if len(row) else np.empty(0, bool)
    return np.bincount(row[new], minlength=len(texts))


def _fnv(buf: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = FNV_START) -> np.ndarray:
    """32-bit FNV-1a of stretches of a buffer: character by character over all that are so long, the few longest by themselves."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    h = np.full(len(start), seed, np.uint32)
    j, live = 0, len(start)
    while live > FEW:
        h[:live] = (h[:live] ^ buf[start[:live] + j]) * np.uint32(FNV_PRIME)
        j += 1
        live = int(np.searchsorted(-size, -j, side="left"))
    for i in range(live):
        x = int(h[i])
        for c in buf[start[i] + j : start[i] + size[i]].tobytes():
            x = (x ^ c) * FNV_PRIME & 0xFFFFFFFF
        h[i] = x
    out = np.empty_like(h)
    out[order] = h
    return out


def _runs(texts: pa.Array):
    """(first, end, texts) of runs with about ``SLICE`` bytes; a longer text is a run by itself.  Only one run is there as Python strings."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(upto):
        hi = max(lo + 1, int(np.searchsorted(upto, (int(upto[lo - 1]) if lo else 0) + SLICE, side="right")))
        yield lo, hi, texts[lo:hi].to_pylist()
        lo = hi


def _trim() -> None:
    """Give this worker's free memory back: it is used again for further tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def sketched(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, sk``: the sketch of each text as bytes; null is an empty text."""

    def run(batches):
        for b in batches:
            for lo, hi, texts in _runs(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([r.tobytes() for r in sketches_of(texts)], pa.binary())], ["id", "sk"])
        _trim()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, sk binary")


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, sketch_sha256, band`` of each text: the digest of its sketch and its first band key, as ``sketches.band_keys`` has it."""
    rows = LANES // BANDS
    sha = lambda lanes: hashlib.sha256(",".join(map(str, lanes)).encode()).hexdigest()

    def run(batches):
        for b in batches:
            for lo, hi, texts in _runs(b.column(1)):
                sk = [s.tolist() for s in sketches_of(texts)]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([sha(s) for s in sk]), pa.array(["0:" + sha(s[:rows])[:16] for s in sk])], [id_col, "sketch_sha256", "band"])
        _trim()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, sketch_sha256 string, band string")


def shingle_counts(df: DataFrame, id_col: str, text_col: str, n: int = 4) -> DataFrame:
    """``id_col, n``: distinct shingles of each text; null is an empty text."""

    def run(batches):
        for b in batches:
            for lo, hi, texts in _runs(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(shingle_counts_of(texts, n).astype(np.int64))], [id_col, "n"])
        _trim()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n long")


def lane_groups(groups: int, cut: int) -> list[np.ndarray]:
    """``groups`` sets of lanes that cover all, as even as can be; each cut has other ones."""
    lanes = np.arange(LANES) * (2 * 11 * cut + 1) % LANES
    return [np.sort(lanes[g::groups]) for g in range(groups)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, LANES)


def bucketed(df: DataFrame, groups: int, cut: int = 0, within: str | None = None) -> DataFrame:
    """``id, bucket``: one bucket of each group of lanes of a sketch (``id, sk``), inside the bucket ``within`` where there is one."""
    places = lane_groups(groups, cut)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                sk = _matrix(part.column("sk")).astype(np.uint64)
                base = part.column(within).to_numpy(zero_copy_only=False).view(np.uint64) if within else np.zeros(len(sk), np.uint64)
                keys = np.empty((len(sk), groups), np.uint64)
                for g, lanes in enumerate(places):
                    h = _mixed(base + np.uint64((g + 1) * 0x9E3779B97F4A7C15 % 2**64))
                    for x in lanes:
                        h = _mixed(h + sk[:, x])
                    keys[:, g] = h
                at = pa.array(np.repeat(np.arange(len(sk)), groups))
                yield pa.RecordBatch.from_arrays([part.column("id").take(at), pa.array(keys.ravel().view(np.int64))], ["id", "bucket"])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "sk", *([within] if within else [])).mapInArrow(run, f"id {kind}, bucket long")


def agreeing(pairs: DataFrame, left: DataFrame, right: DataFrame, need: int) -> DataFrame:
    """``a, b, equal``: pairs whose unequal sketches (``id, sk`` of either side) agree in ``need`` lanes or more."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                equal = (_matrix(part.column("ska")) == _matrix(part.column("skb"))).sum(1) if part.num_rows else np.empty(0, np.int64)
                good = (equal >= need) & (equal < LANES)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(equal.astype(np.int32))], ["a", "b", "equal"]).filter(pa.array(good))

    ka, kb = (df.schema["id"].dataType.simpleString() for df in (left, right))
    full = pairs.join(left.select(F.col("id").alias("a"), F.col("sk").alias("ska")), "a").join(right.select(F.col("id").alias("b"), F.col("sk").alias("skb")), "b")
    return full.select("a", "b", "ska", "skb").mapInArrow(run, f"a {ka}, b {kb}, equal int")


def _links_of(group: pd.DataFrame, need: int) -> pd.DataFrame:
    """Agreeing rows of different components that meet, as a spanning forest of the components; rows of side 2 meet all, others those of another side."""
    sk = np.frombuffer(b"".join(group["sk"]), np.uint32).reshape(-1, LANES)
    ids, side = group["id"].to_numpy(), group["side"].to_numpy()
    of = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
    root = list(range(len(group)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a, b = [], []
    for i in range(len(sk) - 1):
        rest = np.flatnonzero((of[i + 1 :] != of[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 2))) + i + 1
        for j in rest[(sk[rest] == sk[i]).sum(1) >= need]:
            x, y = top(int(of[i])), top(int(of[j]))
            if x != y:
                root[y] = x
                a.append(ids[i])
                b.append(ids[j])
    return pd.DataFrame({"a": a, "b": b})


def _crowd_links(kept: Rounds, part: DataFrame, reps: DataFrame, need: int, block: int) -> DataFrame:
    """``a, b``: links between different components inside crowded buckets (``bucket, id, component, m``, kept).

    A crowd of texts much alike shares most of its buckets, so what meets is not told bucket by bucket: every member has one
    chunk of about ``block``, of its component where that is large and otherwise of its most crowded bucket, and two chunks that share
    buckets, however many, meet once.  Chunks of one large component do not meet.
    """
    none = F.lit(0).cast(part.schema["id"].dataType)
    home = part.groupBy("id").agg(F.max(F.struct("m", "bucket"))["bucket"].alias("home"), F.any_value("component").alias("component"))
    home = kept.keep(home)
    large = home.groupBy("component").agg((F.count("*") >= max(block // 4, 2)).alias("big"))
    home = home.join(large, "component").select("id", "component", "big", F.when(F.col("big"), F.col("component")).otherwise(none).alias("c"), F.when(F.col("big"), F.lit(0)).otherwise(F.col("home")).alias("home"))
    size = home.groupBy("big", "c", "home").agg(F.ceil(F.count("*") / block).cast("int").alias("w"))
    home = home.join(size, ["big", "c", "home"]).select("id", "component", F.struct("big", "c", "home", F.expr("cast(pmod(xxhash64(id), w) as int)").alias("w")).alias("chunk"))
    home = kept.keep(home)
    there = part.select("bucket", "id").join(home, "id").select("bucket", "chunk").distinct()
    pairs = there.alias("x").join(there.alias("y"), "bucket").where("x.chunk <= y.chunk and not (x.chunk.big and y.chunk.big and x.chunk.c = y.chunk.c)")
    pairs = kept.keep(pairs.select(F.col("x.chunk").alias("lo"), F.col("y.chunk").alias("hi")).distinct())
    pairs = pairs.withColumn("pair", F.xxhash64("lo", "hi"))
    low = pairs.join(home, pairs["lo"] == home["chunk"]).select("pair", "id", "component", F.when(F.col("lo") == F.col("hi"), 2).otherwise(0).alias("side"))
    high = pairs.where("lo <> hi").join(home, F.col("hi") == home["chunk"]).select("pair", "id", "component", F.lit(1).alias("side"))
    kind = part.schema["id"].dataType.simpleString()
    return low.union(high).join(reps, "id").groupBy("pair").applyInPandas(lambda g: _links_of(g, need), f"a {kind}, b {kind}")


def clusters(df: DataFrame, tau: float = 0.7, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """``id, cluster``: rows (``id, text``) of groups of two or more that agreements of ``tau`` or more connect; the smallest id names a group.

    A link inside a component that is already joined tells nothing, so in every bucket all members first meet the
    smallest one, and only then members of different components meet, those of crowded buckets block by block.  Rows with a null id take no part; a repeated id is one member.
    """
    need = math.ceil(round(tau * LANES, 9))
    groups = LANES - need + 1
    kept = Rounds(df.sparkSession, "clusters")
    rows = kept.keep(sketched(df.where("id is not null")))
    reps = kept.keep(rows.groupBy("sk").agg(F.min("id").alias("id")))
    kind = df.schema["id"].dataType.simpleString()
    edges = kept.keep(reps.select(F.col("id").alias("src"), F.col("id").alias("dst")).where("false"))
    entries = bucketed(reps, groups)
    shared = entries.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("bucket", "first")
    entries = kept.keep(entries.join(shared, "bucket"))
    if kept.seen["n"]:
        stars = entries.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
        edges = kept.keep(edges.union(agreeing(stars, reps, reps, need).select("a", "b")))
        of = labelled(kept, reps, edges)
        part = kept.keep(entries.join(of, "id").select("bucket", "id", "component"))
        size = part.groupBy("bucket").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket", "m")
        part = kept.keep(part.join(size, "bucket"))
        x, y = (part.where(F.col("m") <= crowd).select("bucket", F.col("id").alias(i), F.col("component").alias(c)) for i, c in (("a", "ca"), ("b", "cb")))
        few = x.join(y, "bucket").where("a < b and ca <> cb").select("a", "b").distinct()
        edges = kept.keep(edges.union(agreeing(few, reps, reps, need).select("a", "b")))
        many = kept.keep(part.where(F.col("m") > crowd))
        if kept.seen["n"]:
            edges = kept.keep(edges.union(_crowd_links(kept, many, reps, need, block)))
    of = labelled(kept, reps, edges)
    named = rows.select("id", "sk").join(reps.select("sk", F.col("id").alias("rep")), "sk").join(of.withColumnRenamed("id", "rep"), "rep").select("id", "component").distinct()
    large = named.groupBy("component").agg(F.count("*").alias("k"), F.min("id").alias("cluster")).where("k > 1").select("component", "cluster")
    return kept.result(named.join(large, "component").select("id", "cluster"))


def _best_of(q: pd.DataFrame, a: pd.DataFrame, need: int) -> pd.DataFrame:
    """The best artifact of each query of a block; ties go to the smaller id."""
    out = []
    if len(q) and len(a):
        a = a.sort_values("b")
        sk = np.frombuffer(b"".join(a["sk"]), np.uint32).reshape(-1, LANES)
        ids = a["b"].to_numpy()
        for qid, own in zip(q["a"], q["sk"]):
            equal = (sk == np.frombuffer(own, np.uint32)).sum(1)
            equal[equal == LANES] = 0  # the query's own class
            k = int(equal.argmax())
            if equal[k] >= need:
                out.append((qid, ids[k], int(equal[k])))
    return pd.DataFrame(out, columns=["a", "b", "equal"])


def best_matches(kept: Rounds, queries: DataFrame, artifacts: DataFrame, need: int, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """``a, b, equal``: of the artifacts with another sketch than the query's, the one that agrees best (both ``id, sk``), if in ``need`` lanes or more."""
    groups = LANES - need + 1
    kq, ka = (df.schema["id"].dataType.simpleString() for df in (queries, artifacts))
    q, a = bucketed(queries, groups), bucketed(artifacts, groups)
    found = []
    for cut in range(2):
        q = kept.keep(q)
        a = kept.keep(a.join(q.select("bucket").distinct(), "bucket", "left_semi"))
        size = q.groupBy("bucket").agg(F.count("*").alias("nq")).join(a.groupBy("bucket").agg(F.count("*").alias("na")), "bucket")
        size = kept.keep(size, crowded=F.count_if(F.col("nq") * F.col("na") > crowd * crowd))
        crowded, few = kept.seen["crowded"], size.where(F.col("nq") * F.col("na") <= crowd * crowd).select("bucket")
        pairs = q.join(few, "bucket").select("bucket", F.col("id").alias("a")).join(a.select("bucket", F.col("id").alias("b")), "bucket").select("a", "b").distinct()
        found.append(kept.keep(agreeing(pairs, queries, artifacts, need)))
        many = size.where(F.col("nq") * F.col("na") > crowd * crowd).select("bucket", "nq", "na")
        if not crowded:
            break
        if cut == 0:
            inside = lambda df, sk: bucketed(df.join(many, "bucket", "left_semi").join(sk, "id").withColumnRenamed("bucket", "within"), groups, 1, "within")
            q, a = inside(q, queries), inside(a, artifacts)
            continue
        wide = many.select("bucket", F.ceil(F.col("nq") / block).cast("int").alias("mq"), F.ceil(F.col("na") / block).cast("int").alias("ma"))
        qs = q.join(wide, "bucket").select("bucket", F.col("id").alias("a"), F.expr("cast(pmod(xxhash64(id), mq) as int)").alias("u"), F.explode(F.sequence(F.lit(0), F.col("ma") - 1)).alias("v"))
        as_ = a.join(wide, "bucket").select("bucket", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("mq") - 1)).alias("u"), F.expr("cast(pmod(xxhash64(id), ma) as int)").alias("v"))
        qs, as_ = qs.join(queries.withColumnRenamed("id", "a"), "a"), as_.join(artifacts.withColumnRenamed("id", "b"), "b")
        met = qs.groupBy("bucket", "u", "v").cogroup(as_.groupBy("bucket", "u", "v")).applyInPandas(lambda x, y: _best_of(x, y, need), f"a {kq}, b {ka}, equal int")
        found.append(kept.keep(met))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.groupBy("a").agg(F.min_by(F.struct("b", "equal"), F.struct(-F.col("equal"), F.col("b"))).alias("m")).select("a", "m.b", "m.equal")


def _two_smallest(rows: DataFrame) -> DataFrame:
    """``sk, id, second``: the two smallest distinct ids of each sketch."""
    first = rows.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("sk").orderBy("id"))).where("_n <= 2")
    return first.groupBy("sk").agg(F.min("id").alias("id"), F.max(F.when(F.col("_n") == 2, F.col("id"))).alias("second"))


def reuse_ladder(queries: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``query_id, tier, artifact_id, sim``: the artifact most like each query, exactly.

    Both sides are ``id, text``; an artifact with the query's id is the query's own and is no answer.  Artifacts of equal sketches
    count once (the smallest id, or the next where that is the query's); ties go to the smaller id.  Tier: exact (equal sketch),
    near, adapt or miss.  Queries that one tier answers need no search for the next, which has more and wider buckets.
    """
    kept = Rounds(queries.sparkSession, "ladder")
    # equal sketches are one query and one artifact; a second artifact of a class answers the query that is its first
    q = kept.keep(sketched(queries))
    a = kept.keep(_two_smallest(sketched(artifacts)))
    other = F.when(F.col("id") != F.col("query_id"), F.col("id")).otherwise(F.col("second"))
    exact = q.select(F.col("id").alias("query_id"), "sk").join(a, "sk").select("query_id", other.alias("artifact_id")).where("artifact_id is not null")
    done = kept.keep(exact.select("query_id", F.lit("exact").alias("tier"), "artifact_id", F.lit(1.0).alias("sim")))
    for tier, least in (("near", NEAR), ("adapt", ADAPT)):
        open_ = q.join(done.select(F.col("query_id").alias("id")), "id", "left_anti")
        open_ = kept.keep(open_.groupBy("sk").agg(F.min("id").alias("id")))
        others = a.select("id", "sk")
        got = best_matches(kept, open_, others, math.ceil(round(least * LANES, 9)))
        # what is open has no equal sketch but its own, so artifacts with another sketch are all there is
        got = got.select(F.col("a").alias("id"), F.col("b").alias("artifact_id"), (F.col("equal") / LANES).alias("sim")).join(open_, "id").drop("id")
        mine = q.join(done.select(F.col("query_id").alias("id")), "id", "left_anti").join(got, "sk").select(F.col("id").alias("query_id"), F.lit(tier).alias("tier"), "artifact_id", "sim")
        done = kept.keep(done.union(mine))
    rest = q.select(F.col("id").alias("query_id")).distinct().join(done, "query_id", "left")
    return kept.result(rest.select("query_id", F.coalesce("tier", F.lit("miss")).alias("tier"), "artifact_id", "sim"))
