"""Running sums of a whole table or of its groups, dealt by range, so that a group of any size is split."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.rounds import Rounds

#: Rows of one range partition.
PIECE_ROWS = 1 << 18


def pieces(df: DataFrame, rows: int) -> int:
    """Partitions for ``rows`` rows: bounded in size, and as many as there are cores where rows suffice."""
    return max(-(-rows // PIECE_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, rows // 1024), 1)


def running(rounds: Rounds, df: DataFrame, order: Sequence[str], group: Sequence[str] = (), adds: Sequence[str] = ()) -> DataFrame:
    """``df`` (a kept table) with ``run_<c>`` for every long ``c`` of ``adds``: its sum up to the row, in the order of ``group`` and ``order``.

    Sums start anew in each group (nulls are a group); null summands count as nothing.  Rows go to partitions by range of group and order, are
    summed there, and each partition's carry from those before it is worked out from one row for each partition.
    """
    by = [*group, *order]
    dealt = df.repartitionByRange(pieces(df, df.count()), *by).sortWithinPartitions(*by)
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"run_{c}", T.LongType()) for c in adds), T.StructField("_piece", T.LongType()), T.StructField("_row", T.LongType()), T.StructField("_opening", T.BooleanType())])
    local = rounds.keep(dealt.mapInArrow(_sums(list(group), list(adds)), schema))
    edge = F.struct(*group, *(f"run_{c}" for c in adds), "_opening")
    carry, held, rows = [0] * len(adds), None, []
    for e in local.groupBy("_piece").agg(F.min_by(edge, "_row").alias("head"), F.max_by(edge, "_row").alias("tail")).orderBy("_piece").collect():
        goes_on = not group or tuple(e.head[g] for g in group) == held
        if goes_on and any(carry):
            rows.append((e._piece, *carry))
        carry = [e.tail[f"run_{c}"] + (before if goes_on and e.tail["_opening"] else 0) for c, before in zip(adds, carry)]
        held = tuple(e.tail[g] for g in group)
    offsets = df.sparkSession.createDataFrame(rows, ", ".join(["_piece long", *(f"_add_{i} long" for i in range(len(adds)))]))  # a row for each partition at most
    out = local.join(F.broadcast(offsets), "_piece", "left")
    carried = [(F.col(f"run_{c}") + F.when(F.col("_opening"), F.coalesce(f"_add_{i}", F.lit(0))).otherwise(0)).alias(f"run_{c}") for i, c in enumerate(adds)]
    return out.select(*df.columns, *carried)


def _sums(group: list[str], adds: list[str]):
    """Sums inside one partition, batch by batch; ``_opening`` marks rows of the group with which the partition begins."""

    def run(batches):
        piece, row, opening, held = TaskContext.get().partitionId(), 0, True, None
        upto = dict.fromkeys(adds, 0)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for g in group:
                col = b.column(g)
                null = pc.is_null(col).to_numpy(zero_copy_only=False)
                new[1:] |= pc.fill_null(pc.not_equal(col[1:], col[:-1]), False).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
            last = tuple(b.column(g)[0].as_py() for g in group)
            new[0] = held is not None and last != held
            held = tuple(b.column(g)[n - 1].as_py() for g in group)
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # where the row's group began in this batch
            cols = list(b.columns)
            for c in adds:
                x = pc.fill_null(b.column(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.concatenate(([0], np.cumsum(x)))
                run_ = total[1:] - np.where(first >= 0, total[first], -upto[c])
                upto[c] = run_[-1]
                cols.append(pa.array(run_))
            inside = (first < 0) & opening
            opening = bool(inside[-1])
            cols += [pa.array(np.full(n, piece, np.int64)), pa.array(np.arange(row, row + n)), pa.array(inside)]
            row += n
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *(f"run_{c}" for c in adds), "_piece", "_row", "_opening"])

    return run
