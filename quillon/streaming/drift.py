"""Drift charts of sessions as keyed state that goes when a session falls idle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and typed state need; set it on the session before such a stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "sid string, seq long, c double, alarm boolean, ended boolean, n long"


class DriftChart(StatefulProcessor):
    """C = max(0, C + d - k) of each session, one row for each of its rows; a session without rows for ``idle_ms`` of event time ends with a last row, and its state is deleted.

    The state of a session is one row whatever its length.  Rows of one batch go in their order; d that is no number counts as 0.
    """

    def __init__(self, k: float, h: float, idle_ms: int):
        self.k, self.h, self.idle_ms = k, h, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chart = handle.getValueState("chart", "c double, n long, seq long, alarm boolean, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c, n, _, alarm, until = self.chart.get() if self.chart.exists() else (0.0, 0, -1, False, None)
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for seq, d in zip(batch["seq"], batch["d"]):
            c = max(0.0, c + (0.0 if pd.isna(d) or d in (float("inf"), float("-inf")) else float(d)) - self.k)
            n += 1
            alarm = bool(alarm or c > self.h)
            out.append((str(key[0]), int(seq), c, c > self.h, False, n))
        if until is not None:
            self.handle.deleteTimer(until)
        until = max(int(batch["ms"].max()) + self.idle_ms, until or 0)
        self.handle.registerTimer(until)
        self.chart.update((c, n, out[-1][1], alarm, until))
        yield pd.DataFrame(out, columns=["sid", "seq", "c", "alarm", "ended", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        c, n, seq, alarm, _ = self.chart.get()
        self.chart.clear()
        yield pd.DataFrame([(str(key[0]), int(seq), float(c), bool(alarm), True, int(n))], columns=["sid", "seq", "c", "alarm", "ended", "n"])

    def close(self) -> None:
        pass


def charted(stream: DataFrame, late: str = "1 hour", k: float = 0.35, h: float = 1.0, idle_days: float = 7) -> DataFrame:
    """``sid, seq, c, alarm, ended, n`` of a stream of ``sid, seq, ts, d``; an ``ended`` row has whether the session ever alarmed and how many rows it had.

    Rows later than the watermark are left out.  Needs the state store of ``STORE``.
    """
    rows = stream.select(F.col("sid").cast("string").alias("sid"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("d").cast("double").alias("d"))
    rows = rows.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("sid").transformWithStateInPandas(DriftChart(k, h, int(idle_days * 86_400_000)), OUT, "Append", "EventTime")
