"""Prefix trie of conversations as preorder intervals.

A node is a distinct sequence of the first d turns; two turns are equal if role and text are.  Identity: turns are known
by the MD5 of role and text, a prefix by its depth and two 64-bit exclusive ors of hashes of (depth, turn), which are running
values, so no conversation is ever gathered in a row.  Order: nodes are ranked by their paths of turn
digests, 64 turns at a time (where conversations are longer, blocks of 64 are ranked first and paths are made of their
ranks, so a path never has more than 64 parts).  In that order a node's descendants follow it; ``rank`` and ``end`` bound the
interval, and leaves and savings of a subtree are differences of running sums at its two ends.

Rows with a null conversation id take no part; null role or text is empty, a null turn comes first; rows with the same
turn go in the order of their digests, and repeated rows are turns of their own.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _util as U
from .running import lookup, pieces, running

#: Turns, or ranks of blocks, in one path.
SPAN = 64
_WS = r"\x20\x09-\x0D"
_KEY = ["depth", "k1", "k2"]


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space, in one pass without an array."""
    return F.length(F.regexp_replace(F.regexp_replace(text, f"^[{_WS}]++", ""), f"[^{_WS}]++[{_WS}]*+", "x"))


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, sym, words``: position of each turn from 1, its digest and words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("sym"),
        n_words(text).cast("long").alias("words"),
        F.lit(1).cast("long").alias("one"),
    )
    held = U.stored(t, "turns")
    out = running(held, ["turn", "sym"], "conv_id", adds=["one"])
    U.drop_stored(held, settle_=False)
    return out.select("conv_id", F.col("run_one").alias("pos"), "sym", "words")


def _blocks(last: str) -> Column:
    return F.explode(F.expr(f"sequence(0L, greatest({last} - 1, 0L) div {SPAN})")).alias("block")


def rebuilt(placed: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """``conv_id, depth, sym, words, last`` of every conversation c: the first h = crc32(c) mod ``heads`` turns of c - c mod ``family``, then its own after the first h.

    Depth 0 is the root, with an empty digest; ``last`` marks a conversation's last row.  Every conversation has a root row, even without turns.
    """
    sizes = placed.groupBy("conv_id").agg(F.max("pos").alias("n"))
    c = sizes.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    c = c.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    c = c.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)).cast("long"))).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    c = U.stored(c.select("conv_id", "n", "h", "base", "k", "length"), "rebuilt")
    heads_ = placed.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "sym", "words")
    taken = c.where("k > 0").join(heads_, "base").where("depth <= k").select("conv_id", "depth", "sym", "words", "length")
    own = placed.withColumn("block", F.expr(f"(pos - 1) div {SPAN}")).join(c.select("conv_id", "h", "k", "length", _blocks("n")), ["conv_id", "block"])
    own = own.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "sym", "words", "length")
    roots = c.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("sym"), F.lit(0).cast("long").alias("words"), "length")
    out = U.stored(taken.unionByName(own).unionByName(roots).select("conv_id", "depth", "sym", "words", (F.col("depth") == F.col("length")).alias("last")), "rebuilt")
    U.drop_stored(c, settle_=False)
    return out


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of ``conv_id, depth, sym, words, last`` rows (stored): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, rank, end.

    ``conv_id`` is the smallest member, ``rank`` the preorder position from 1 and ``end`` the rank of the subtree's last node.
    """
    lane = lambda i: F.when(F.col("depth") == 0, 0).otherwise(F.xxhash64(F.lit(i), "depth", "sym"))
    keyed = running(rows.withColumns({"x1": lane(1), "x2": lane(2)}), ["depth"], "conv_id", xors=["x1", "x2"])
    keyed = keyed.withColumns({"k1": F.col("run_x1"), "k2": F.col("run_x2"), "block": F.expr(f"greatest(depth - 1, 0L) div {SPAN}")})
    nodes, used = _nodes(keyed)
    total = nodes.count()
    children = nodes.where("depth > 0").groupBy(F.col("p_depth").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    full = U.stored(
        nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).withColumns({"one": F.lit(1).cast("long"), "leaf": (F.col("n_children") == 0).cast("long"), "own": (F.col("n_convs") - 1) * F.col("words")}),
        "trie",
    )
    ranked = running(full, ["path"], adds=["one", "leaf", "own"]).withColumnsRenamed({"run_one": "rank", "run_leaf": "leaves", "run_own": "saved"})
    ranked = U.stored(ranked.drop("path", "one"), "trie")
    last = keyed.where("last")
    ends = last.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id")).join(ranked.select(*_KEY, "rank", "leaves", "saved"), _KEY)
    reach = keyed.select("conv_id", "block", *_KEY).join(ends.select("conv_id", "rank", "leaves", "saved", _blocks("depth")), ["conv_id", "block"])
    reach = reach.groupBy(*_KEY).agg(F.max("rank").alias("end"), F.max("leaves").alias("to_leaves"), F.max("saved").alias("to_saved"))
    parents = full.select(F.col("depth").alias("p_depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = lookup(ranked.where("depth > 0"), parents, ["p_depth", "p1", "p2"], "n_children", total)
    named = below.unionByName(ranked.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = named.join(reach, _KEY).join(_end_digests(last.select(*_KEY, "conv_id")), _KEY, "left")
    out = out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("to_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("to_saved") - F.col("saved") + F.col("own")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        "rank", "end",
    )
    done = U.stored(out, "trie")
    U.drop_stored(*used, full, ranked, settle_=False)
    U.drop_stored(keyed)
    return done


def _nodes(keyed: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Distinct nodes with a ``path`` whose byte order is the preorder, and the tables they are read from."""
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    joined = lambda c: F.aggregate(c, F.lit(b""), lambda a, x: F.concat(a, x))
    rows = keyed.withColumn("path", joined(F.collect_list("sym").over(upto)))
    nodes = rows.groupBy(*_KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"),
        F.first("x1").alias("x1"), F.first("x2").alias("x2"), F.first("path").alias("path"),
    )
    nodes = nodes.withColumns({"p_depth": F.col("depth") - 1, "p1": F.col("k1").bitwiseXOR(F.col("x1")), "p2": F.col("k2").bitwiseXOR(F.col("x2"))}).drop("x1", "x2")
    nodes = U.stored(nodes, "nodes")
    used, unit, deepest = [nodes], SPAN, nodes.agg(F.max("depth")).first()[0] or 0
    while unit < deepest:  # paths hold the last block of ``unit`` turns only: rank those, and write paths of ranks
        wide = unit * SPAN
        names = U.stored(nodes.select("path").distinct().withColumn("one", F.lit(1).cast("long")), "names")
        placed = running(names, ["path"], adds=["one"])
        named = U.stored(nodes.join(placed.select("path", F.unhex(F.lpad(F.hex("run_one"), 16, "0")).alias("sym")), "path").drop("path"), "nodes")
        at = keyed.where(f"depth > 0 AND depth % {unit} = 0").select("conv_id", *_KEY).join(named.select(*_KEY, "sym"), _KEY)
        above = Window.partitionBy("conv_id", F.expr(f"(depth - 1) div {wide}")).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
        at = at.where(f"depth % {wide} <> 0").select("conv_id", F.col("depth").alias("under"), joined(F.collect_list("sym").over(above)).alias("upper"))
        longer = named.withColumn("under", F.expr(f"greatest(depth - 1, 0L) div {unit} * {unit}")).join(at, ["conv_id", "under"], "left")
        nxt = U.stored(longer.withColumn("path", F.when(F.col("depth") == 0, F.lit(b"")).otherwise(F.concat(F.coalesce("upper", F.lit(b"")), "sym"))).drop("sym", "under", "upper"), "nodes")
        U.drop_stored(nodes, names, named, placed, settle_=False)
        nodes, used, unit = nxt, [nxt], wide
    return nodes, used


def _end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ``conv_id`` list; ids are joined into chunks first, so a common end is a few rows, read in order."""
    by = [*_KEY, "conv_id"]
    n = pieces(ends, ends.count())
    chunks = ends.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(_chunks, "depth long, k1 long, k2 long, first_id long, ids string")
    return chunks.repartition(n, *_KEY).sortWithinPartitions(*_KEY, "first_id").mapInArrow(_hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def _chunks(batches):
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in _KEY])
        ids = b.column("conv_id").to_numpy(zero_copy_only=False)
        lo = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1))
        words = ids.astype(str).tolist()
        hi = [*lo[1:].tolist(), len(ids)]
        joined = [",".join(words[i:j]) for i, j in zip(lo.tolist(), hi)]
        yield pa.RecordBatch.from_arrays([*(pa.array(key[i][lo]) for i in range(3)), pa.array(ids[lo]), pa.array(joined, pa.string())], names=[*_KEY, "first_id", "ids"])


def _hashed(batches):
    held, digest = None, None
    for b in batches:
        done: list[tuple] = []
        for d, a, z, text in zip(*(b.column(c).to_pylist() for c in _KEY), b.column("ids").to_pylist()):
            if (d, a, z) == held:
                digest.update(b"," + text.encode())
                continue
            if held is not None:
                done.append((*held, digest.hexdigest()))
            held, digest = (d, a, z), hashlib.sha256(text.encode())
        if done:
            yield _digest_rows(done)
    if held is not None:
        yield _digest_rows([(*held, digest.hexdigest())])


def _digest_rows(done: list[tuple]) -> pa.RecordBatch:
    d, a, z, s = zip(*done)
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (d, a, z)), pa.array(s, pa.string())], names=[*_KEY, "ends_sha256"])


def prefix_trie(conversations: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Rebuild the conversations and return the nodes of their trie."""
    placed = turns(conversations)
    rows = rebuilt(placed, family, heads)
    U.drop_stored(placed, settle_=False)
    nodes = trie(rows)
    U.drop_stored(rows, settle_=False)
    return nodes
