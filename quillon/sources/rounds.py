"""Tables between the rounds of an iterative job: written to the shared folder, watched while written, deleted after use."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of this machine only where Spark runs on it alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/quillon-shared"


class Rounds:
    """One run's folder.  ``keep`` is one job a table: it cuts lineage durably, so a lost executor costs one round at most."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.seen: dict = {}
        self._made = 0

    def keep(self, df: DataFrame, **watch: Column) -> DataFrame:
        """``df``, written and read again; ``seen`` then has ``n`` (its rows) and the aggregates ``watch``, taken while writing."""
        self._made += 1
        path = f"{self.folder}/{self._made}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in watch.items())).write.parquet(path)
        self.seen = seen.get
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for df in frames:
            _delete(self.spark, df.kept_at)

    def close(self) -> None:
        """Delete all tables of the run."""
        _delete(self.spark, self.folder)

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` in a folder of its own, which is the caller's to delete (``forget``); all tables of the run go."""
        path = f"{self.folder}-result"
        df.write.parquet(path)
        _delete(self.spark, self.folder)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path
        return out


def forget(df: DataFrame) -> None:
    """Delete the files of a result."""
    _delete(df.sparkSession, df.kept_at)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
