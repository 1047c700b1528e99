"""Stores that writes are routed to and moved out of, so that doing anything twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = "id string, text string, batch long, home string"


def _there(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, where


class FactStore:
    """Facts below ``path``, one partition for each home.

    A batch of facts is one folder in each home, named by the batch's number and replaced as a whole, so a batch that is written again
    after a failure changes nothing; a fact that an earlier batch brought is not written again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def facts(self) -> DataFrame:
        """``id, text, batch, home`` of all facts."""
        fs, where = _there(self.spark, self.path)
        return self.spark.read.schema(FACTS).parquet(self.path) if fs.exists(where) else self.spark.createDataFrame([], FACTS)

    def decide(self, rows: DataFrame, advice_only: Column | None = None) -> DataFrame:
        """Adds ``id, body, stored, reason`` to ``text, home, secret``: empty facts and secrets are refused, homes that only advise store nothing."""
        body = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
        r = rows.withColumn("body", body).withColumn("id", F.sha2("body", 256))
        why = F.when(F.col("body") == "", "empty").when(F.coalesce("secret", F.lit(False)), "secret")
        if advice_only is not None:
            why = F.coalesce(why, F.when(advice_only, "advice"))
        why = F.coalesce(why, F.when(F.col("home").isNull(), "no home"))
        return r.withColumn("reason", why).withColumn("stored", F.col("reason").isNull())

    def store(self, rows: DataFrame, batch: int, advice_only: Column | None = None) -> None:
        """Write the facts of one batch that ``decide`` stores and no other batch has; also the function of a stream's ``foreachBatch``."""
        new = self.decide(rows, advice_only).where("stored").select("id", F.col("body").alias("text"), "home").dropDuplicates(["home", "id"])
        old = self.facts().where(F.col("batch") != batch).select("home", "id")
        new = new.join(old, ["home", "id"], "left_anti").withColumn("batch", F.lit(batch).cast("long"))
        new.repartition("home").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("home", "batch").parquet(self.path)


class ClaimStore:
    """Live claims (``id, ...``) and an attic, both by the first two characters of the id."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.live_path, self.attic_path = spark, f"{path.rstrip('/')}/live", f"{path.rstrip('/')}/attic"
        self.schema = f"{schema}, shard string"

    def _read(self, path: str) -> DataFrame:
        fs, where = _there(self.spark, path)
        return self.spark.read.schema(self.schema).parquet(path) if fs.exists(where) else self.spark.createDataFrame([], self.schema)

    def add(self, claims: DataFrame) -> None:
        """Claims that neither the store nor the attic has."""
        new = claims.dropDuplicates(["id"]).withColumn("shard", F.substring("id", 1, 2))
        known = self._read(self.live_path).select("shard", "id").union(self._read(self.attic_path).select("shard", "id"))
        new.join(known, ["shard", "id"], "left_anti").repartition("shard").write.mode("append").partitionBy("shard").parquet(self.live_path)

    def live(self) -> DataFrame:
        """Claims that are not in the attic; a move that was lost half-way already counts."""
        return self._read(self.live_path).join(self._read(self.attic_path).select("shard", "id"), ["shard", "id"], "left_anti").drop("shard")

    def attic(self) -> DataFrame:
        return self._read(self.attic_path).dropDuplicates(["id"]).drop("shard")

    def prune(self, ids: DataFrame) -> int:
        """Move claims to the attic: first they are added there, then only the partitions that had them are written anew.  The number of claims moved."""
        gone = ids.select("id").where("id is not null").distinct().withColumn("shard", F.substring("id", 1, 2))
        moved = self._read(self.live_path).join(gone, ["shard", "id"], "left_semi")
        moved = moved.join(self._read(self.attic_path).select("shard", "id"), ["shard", "id"], "left_anti")
        before = self._read(self.attic_path).select("id").distinct().count()
        moved.repartition("shard").write.mode("append").partitionBy("shard").parquet(self.attic_path)
        shards = [r.shard for r in gone.select("shard").distinct().collect()]  # 256 for hex ids
        if shards:
            fs, _ = _there(self.spark, self.live_path)
            rest = self._read(self.live_path).where(F.col("shard").isin(*shards)).join(gone, ["shard", "id"], "left_anti")
            left = {r.shard for r in rest.select("shard").distinct().collect()}
            rest.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(self.live_path)
            for s in set(shards) - left:  # a partition without rows is not replaced, so it is deleted
                fs.delete(_there(self.spark, f"{self.live_path}/shard={s}")[1], True)
        return self._read(self.attic_path).select("id").distinct().count() - before
