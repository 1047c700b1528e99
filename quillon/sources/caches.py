"""A vector cache that forgets its oldest entries when it outgrows its size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import running
from .rounds import Rounds

SCHEMA = "k string, v array<double>, at long, gen long, batch string"


class VectorCache:
    """``k, v`` entries below ``path``, by generations: a generation is only added to, and a smaller one takes its place whole.

    An entry's place is the number of the append that brought it, then its key.  Bytes count as those of a JSON line.  A rewrite that is lost half-way leaves a
    generation without a mark, which readers do not see; losing entries costs only their being made again.
    """

    def __init__(self, spark: SparkSession, path: str, most_bytes: int):
        self.spark, self.path, self.most_bytes = spark, path.rstrip("/"), most_bytes

    def _fs(self, sub: str = ""):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path + sub)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _gen(self) -> int:
        fs, where = self._fs("/marks")
        return max((int(s.getPath().getName()) for s in fs.listStatus(where)), default=0) if fs.exists(where) else 0

    def _lines(self) -> DataFrame:
        gen = self._gen()
        fs, where = self._fs(f"/gen={gen}")
        if not fs.exists(where):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(f"{self.path}/gen={gen}")

    @staticmethod
    def _sound():
        return F.col("k").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def read(self) -> DataFrame:
        """``k, v``: the newest entry of each key; entries without key, or whose vector has no or no finite components, do not count."""
        return self._lines().where(self._sound()).groupBy("k").agg(F.max_by("v", "at").alias("v"))

    def append(self, entries: DataFrame) -> bool:
        """Add ``k, v`` rows; whether the cache outgrew its size and was cut to the newest entries that fit half of it."""
        at = (self._lines().agg(F.max("at")).first()[0] or 0) + 1
        new = entries.where(self._sound()).select("k", F.col("v").cast("array<double>").alias("v"), F.lit(at).cast("long").alias("at"))
        new.write.parquet(f"{self.path}/gen={self._gen()}/batch={uuid.uuid4().hex}")
        size = F.length(F.to_json(F.struct("k", "v"))).cast("long") + 1
        if (self._lines().agg(F.sum(size)).first()[0] or 0) <= self.most_bytes:
            return False
        run = Rounds(self.spark, "cache")
        lines = run.keep(self._lines().select("k", "v", "at", size.alias("bytes"), (-F.col("at")).alias("age")))
        kept = running(run, lines, ["age", "k"], adds=["bytes"]).where(F.col("run_bytes") <= self.most_bytes // 2)  # newest first
        gen = self._gen()
        kept.select("k", "v", "at").write.parquet(f"{self.path}/gen={gen + 1}/batch={uuid.uuid4().hex}")
        fs, mark = self._fs(f"/marks/{gen + 1}")
        fs.create(mark, False).close()  # readers see the new generation from here on
        fs.delete(self._fs(f"/gen={gen}")[1], True)
        run.close()
        return True

    def missing(self, keys: DataFrame) -> DataFrame:
        """The distinct ``k`` that have no entry."""
        return keys.select("k").where("k is not null").distinct().join(self.read().select("k"), "k", "left_anti")
