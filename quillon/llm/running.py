"""Running sums over a whole table: range partitions, sums inside each, one carry for each partition."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _util as U

#: Rows of one range partition.
PIECE_ROWS = 1 << 18
#: A key with more than one in ``HOT`` of a join's rows is looked up from a broadcast table of at most ``HOT`` rows.
HOT = 4_096


def pieces(df: DataFrame, rows: int) -> int:
    """Partitions for ``rows`` rows: bounded in size, and as many as there are cores where rows suffice."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(-(-rows // PIECE_ROWS), min(cores, rows // 1024), 1)


def running(df: DataFrame, order: Sequence[str], group: str | None = None, adds: Sequence[str] = (), xors: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``run_<c>`` for every column of ``adds`` (running sum) and ``xors`` (running exclusive or).

    Runs are in the order of ``group`` and ``order``, the row itself included, and start anew with each value of
    ``group`` (a long without nulls).  Rows are dealt by range of group *and* order, so a long group is
    split; the driver sees one row for each partition.  All summed columns are longs without nulls.  Rows that tie in all of
    ``order`` get their places in any order.  The sums are kept in a table of the shared folder, which ``_util.drop_stored`` removes.
    """
    by = [*([group] if group else []), *order]
    names = [*adds, *xors]
    n = df.count()
    dealt = df.repartitionByRange(pieces(df, n), *by).sortWithinPartitions(*by)
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"run_{c}", T.LongType()) for c in names), T.StructField("_piece", T.LongType()), T.StructField("_row", T.LongType()), T.StructField("_opening", T.BooleanType())])
    local = U.stored(dealt.mapInArrow(_scan(group, list(adds), list(xors)), schema), "running")
    kept = [group] if group else []
    edge = F.struct(*kept, *(f"run_{c}" for c in names), "_opening")
    ends = local.groupBy("_piece").agg(F.min_by(edge, "_row").alias("head"), F.max_by(edge, "_row").alias("tail")).orderBy("_piece").collect()
    carry, held, rows = [0] * len(names), None, []
    for e in ends:
        goes_on = group is None or e.head[group] == held
        own = [e.tail[f"run_{c}"] for c in names]
        if goes_on and any(carry):
            rows.append((e._piece, *carry))
        if e.tail._opening and goes_on:
            carry = [a + b if i < len(adds) else a ^ b for i, (a, b) in enumerate(zip(carry, own))]
        else:
            carry = own
        held = e.tail[group] if group else None
    offsets = df.sparkSession.createDataFrame(rows, ", ".join(["_piece long", *(f"_add_{i} long" for i in range(len(names)))]))
    out = local.join(F.broadcast(offsets), "_piece", "left")
    for i, c in enumerate(names):
        off = F.when(F.col("_opening"), F.coalesce(f"_add_{i}", F.lit(0))).otherwise(0)
        out = out.withColumn(f"run_{c}", F.col(f"run_{c}") + off if i < len(adds) else F.col(f"run_{c}").bitwiseXOR(off))
    return out.select(*df.columns, *(f"run_{c}" for c in names))


def _scan(group: str | None, adds: list[str], xors: list[str]):
    def scan(batches):
        piece, row, opening, held = TaskContext.get().partitionId(), 0, True, None
        state = {c: np.int64(0) for c in [*adds, *xors]}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            start = np.zeros(n, bool)
            if group:
                g = b.column(group).to_numpy(zero_copy_only=False)
                start[1:] = g[1:] != g[:-1]
                start[0] = held is not None and g[0] != held
                held = g[-1]
            seg = np.cumsum(start)
            at = np.concatenate(([0], np.flatnonzero(start)))
            if start[0]:
                at = at[1:]
                seg = seg - 1
            cols = list(b.columns)
            for c in [*adds, *xors]:
                x = b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                if c in adds:
                    total = np.cumsum(x)
                    before = total[at] - x[at]
                    if not start[0]:
                        before[0] -= state[c]
                    run = total - before[seg]
                else:
                    total = np.bitwise_xor.accumulate(x)
                    before = total[at] ^ x[at]
                    if not start[0]:
                        before[0] ^= state[c]
                    run = total ^ before[seg]
                state[c] = run[-1]
                cols.append(pa.array(run))
            inside = np.full(n, opening)
            if start.any():
                inside[int(np.argmax(start)) :] = False
                opening = False
            cols += [pa.array(np.full(n, piece, np.int64)), pa.array(np.arange(row, row + n)), pa.array(inside)]
            row += n
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *(f"run_{c}" for c in [*adds, *xors]), "_piece", "_row", "_opening"])

    return scan


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], count: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right`` (unique ``keys``), whose column ``count`` says how many rows of ``left`` (``total`` in all) have the key.

    Keys with more than total / HOT rows number at most HOT; those rows meet a broadcast table, and all others a
    shuffled one in which no key has more rows than that.
    """
    often = F.col(count) * HOT > total
    right = right.where(F.col(count) > 0)
    hot = F.broadcast(right.where(often).drop(count))
    return left.join(hot, list(keys)).unionByName(left.join(F.broadcast(right.where(often).select(*keys)), list(keys), "left_anti").join(right.where(~often).drop(count), list(keys)))
