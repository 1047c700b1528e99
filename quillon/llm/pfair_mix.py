"""Mixing sources to target weights by Pfair scheduling.

Every source's rows, in id order, are cut into blocks.  Block i of a source whose share
is w = a / D (a: its integer weight, D: the sum over sources that still have blocks)
is released at slot floor(i / w) and due at slot ceil((i + 1) / w); each slot takes the
released block with the earliest deadline (ties: the source's name).  At any slot each
live source has got its share to within less than one block.  When a source has no
blocks left the shares are renewed over the rest and a new phase begins, so every row
keeps a place and none is dropped or repeated.

The schedule of a phase repeats every D slots, so one period for each phase (at most one
phase for each source) is worked out on the driver from the sources' weights and block
counts, and the blocks of any amount of data are placed by a join with it.  The driver
holds one row for each source and at most ``sources * D`` slots.

A null source is a source of its own.  A source that has no weight, or one below 1, gets
weight 1.  Rows that share source and id take the places one after the other.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _util as U

BLOCK_ROWS = 64
#: Weights are whole parts of this, so that a period is short.
PARTS = 1_000


def period(weights: list[int]) -> list[tuple[int, int, int, int]]:
    """One period of the schedule: (source, block, release, deadline) for each slot."""
    total = sum(weights)
    waiting = [(0, s, 0) for s in range(len(weights))]  # (release, source, block)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    heapq.heapify(waiting)
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            release, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // weights[s]), s, i, release))
        deadline, s, i, release = heapq.heappop(ready)
        out.append((s, i, release, deadline))
        heapq.heappush(waiting, (((i + 1) * total) // weights[s], s, i + 1))
    return out


def schedule(weights: list[int], blocks: list[int]) -> tuple[list[tuple], list[tuple]]:
    """(phases, slots): phase rows (phase, source, first block, end block, first slot, D, a)
    and slot rows (phase, source, j, slot, release, deadline) of one period each."""
    left, done = list(blocks), [0] * len(blocks)
    base, phases, slots = 0, [], []
    while any(left):
        live = [s for s, n in enumerate(left) if n]
        own = [weights[s] for s in live]
        total, plan = sum(own), period(own)
        place: list[list[int]] = [[] for _ in live]
        for t, (k, _, release, deadline) in enumerate(plan):
            slots.append((len(phases), live[k], len(place[k]), t, release, deadline))
            place[k].append(t)
        length = min((left[s] - 1) // own[k] * total + place[k][(left[s] - 1) % own[k]] + 1 for k, s in enumerate(live))
        rounds, rest = divmod(length, total)
        rows = []
        for k, s in enumerate(live):
            n = rounds * own[k] + sum(t < rest for t in place[k])
            rows.append((len(phases), s, done[s], done[s] + n, base, total, own[k]))
            done[s] += n
            left[s] -= n
        phases.append(rows)
        base += length
    return [r for rows in phases for r in rows], slots


def temperature_weights(counts: dict[str, int], power: float = 0.5, parts: int = PARTS) -> dict[str, int]:
    """Whole weights in proportion to a power of the sources' sizes."""
    total = sum(n**power for n in counts.values())
    return {s: max(1, round(parts * n**power / total)) for s, n in counts.items()}


def mixed(docs: DataFrame, weights: dict[str | None, int] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``id_col, source_col, block, place, slot, release, deadline`` of every row.

    Ordered by (slot, place) the rows are the mixed sequence; ``place`` is the row's
    place in its block, release and deadline are slots too.  Without ``weights`` the
    target is in proportion to the square root of each source's row count.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    slim = docs.select(id_col, source_col, key.alias("_key"))
    dealt = U.stored(slim.repartitionByRange(n, "_key", id_col).withColumn("_part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_key", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    counts = {r["_key"]: r["n"] for r in sizes.groupBy("_key").agg(F.sum("_n").alias("n")).collect()}  # one row for each source

    names = sorted(counts)
    if weights is None:
        chosen = temperature_weights(counts)
    else:
        given = {("n" if s is None else f"s{s}"): int(w) for s, w in weights.items()}
        chosen = {s: max(1, given.get(s, 1)) for s in names}
    phases, slots = schedule([chosen[s] for s in names], [-(-counts[s] // block_rows) for s in names])
    p = spark.createDataFrame([(names[r[1]], *r) for r in phases], "_key string, phase int, s int, lo long, hi long, base long, d long, a long")
    q = spark.createDataFrame(slots, "phase int, s int, j long, at long, release long, deadline long")

    within = Window.partitionBy("_key", "_part").orderBy(id_col)
    placed = dealt.withColumn("_k", F.row_number().over(within) - 1).join(offsets, ["_key", "_part"]).withColumn("_row", F.col("_offset") + F.col("_k"))
    placed = placed.withColumns({"block": F.expr(f"_row div {block_rows}"), "place": F.expr(f"_row % {block_rows}")})
    # Both small sides are bounded by the number of sources and PARTS (see the module's text).
    x = placed.join(F.broadcast(p), (placed["_key"] == p["_key"]) & (F.col("block") >= F.col("lo")) & (F.col("block") < F.col("hi"))).drop(p["_key"])
    x = x.withColumns({"_turn": F.expr("(block - lo) div a"), "j": F.expr("(block - lo) % a")})
    x = x.join(F.broadcast(q), ["phase", "s", "j"])
    shift = F.col("base") + F.col("_turn") * F.col("d")
    return x.select(id_col, source_col, "block", F.col("place").cast("int").alias("place"), (shift + F.col("at")).alias("slot"), (shift + F.col("release")).alias("release"), (shift + F.col("deadline")).alias("deadline"))


def in_mixed_order(docs: DataFrame, weights: dict[str | None, int] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows of ``docs``, same columns, range-partitioned and sorted into the mixed sequence."""
    spark = docs.sparkSession
    own, slot, place = (U.fresh(docs, c) for c in ("_id", "_slot", "_place"))
    at = mixed(docs, weights, block_rows, id_col, source_col).groupBy(F.col(id_col).alias(own)).agg(F.min(F.struct("slot", "place")).alias("p"))
    at = U.stored(at.select(own, F.col("p.slot").alias(slot), F.col("p.place").alias(place)), "places")  # repeated ids travel together, at their first place
    joined = docs.join(at, docs[id_col].eqNullSafe(at[own]), "left")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return joined.repartitionByRange(n, slot, place).sortWithinPartitions(slot, place, F.xxhash64(*docs.columns)).select(*[docs[c] for c in docs.columns])


def with_position(docs: DataFrame, name: str = "position") -> DataFrame:
    """``docs`` and each row's place, from 0, in the sequence that its files were written in.

    Spark reads files in an order of its own; the number in a part file's name and the row
    index in the file give the sequence back.  A frame that is not read from Parquet files
    directly is written first.
    """
    docs = docs.drop(name)  # a column of this name gives way
    file, row, start = (U.fresh(docs, c) for c in ("_file", "_at", "_first"))
    try:
        at = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return with_position(U.stored(docs, "sequence"), name)

    def number(path: str) -> tuple:
        m = re.match(r"part-(\d+)", path.rsplit("/", 1)[1])
        c = re.search(r"-c(\d+)\.", path)
        return (int(m[1]) if m else 0, int(c[1]) if c else 0, path)

    sizes = {r[file]: r["n"] for r in at.groupBy(file).agg(F.count("*").alias("n")).collect()}  # one row for each file
    first, starts = 0, []
    for path in sorted(sizes, key=number):
        starts.append((path, first))
        first += sizes[path]
    known = docs.sparkSession.createDataFrame(starts, f"{file} string, {start} long")
    return at.join(F.broadcast(known), file).select(*docs.columns, (F.col(start) + F.col(row)).alias(name))
