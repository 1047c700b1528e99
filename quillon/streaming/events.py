"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RING = 50


def windowed(stream: DataFrame, ts: str, width: str, keys: list[str], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by window and keys; rows later than the watermark are dropped and their state freed."""
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks take no zone-less times
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def ring_counts(stream: DataFrame, by: str, order: str, signature: str, size: int = RING) -> DataFrame:
    """``order, hits``: recurrences of each row's signature in its key's last ``size`` rows.

    The state of a key is its ring, so it stays bounded; rows of one batch go in their order.
    """
    types = dict(stream.dtypes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        hits = []
        for s in rows[signature]:
            ring = (ring + [s])[-size:]
            hits.append(ring.count(s))
        state.update((ring,))
        yield pd.DataFrame({order: rows[order].to_numpy(), "hits": hits})

    return stream.groupBy(by).applyInPandasWithState(step, f"`{order}` {types[order]}, hits long", "ring array<string>", "append", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that has arrived.  Whole aggregates ("complete") replace the table; other rows are added."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    else:
        writer = writer.format("parquet").option("path", out)
    writer.start().awaitTermination()
