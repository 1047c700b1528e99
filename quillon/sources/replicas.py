"""Replicas of an append-only record log that converge by comparing digests: what is equal is never read.

A replica is a folder: ``records``, Parquet in batches with one partition for each first byte of a record's hash, only ever added to; and
``roots``, numbered files with the digest of every partition (256 at most) that a writer publishes after it has appended.
A digest is the number of distinct records and two exclusive ors of their hashes, so it does not depend on order or repeats.  A
root is published by creating the next number, which fails if another writer was first; then the digests are taken anew.
A writer that is lost between the two steps leaves records that the next writer's digest of that partition includes.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "h string, line string, batch string, shard string"
#: Times that a lost race for a root is run again.
RETRIES = 3


def sealed(line: Column) -> Column:
    return F.sha2(line, 256)


class Replica:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.read_shards: list[str] = []  # what this object has read from the store, for those who count

    def _fs(self, sub: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{sub}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _roots(self) -> list[str]:
        fs, where = self._fs("roots")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def digests(self) -> dict[str, list[int]]:
        """The latest published digest of each partition: number of records and two exclusive ors."""
        names = self._roots()
        if not names:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/roots/{names[-1]}", wholetext=True).first()[0])  # 256 entries at most

    def root(self) -> str:
        """One digest of the whole state; equal states have equal roots."""
        return hashlib.sha256(json.dumps(self.digests(), sort_keys=True).encode()).hexdigest()

    def records(self, shards: Iterable[str] | None = None) -> DataFrame:
        """``h, line, shard`` of the records, each once, of some partitions or all; other partitions' files are not opened."""
        fs, where = self._fs("records")
        if not fs.exists(where):
            return self.spark.createDataFrame([], SCHEMA).drop("batch")
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/records")
        if shards is not None:
            shards = sorted(shards)
            self.read_shards += shards
            rows = rows.where(F.col("shard").isin(*shards)) if shards else rows.where("false")
        return rows.select("h", "line", "shard").dropDuplicates(["shard", "h"])

    def append(self, records: DataFrame) -> dict[str, int]:
        """Add ``h, line`` rows that are not there; ``added`` and ``quarantined`` (hash and line do not agree) are counted."""
        sound = F.coalesce(F.col("h") == sealed(F.col("line")), F.lit(False))
        seen = records.agg(F.count_if(~sound).alias("bad"), F.collect_set(F.when(sound, F.substring("h", 1, 2))).alias("shards")).first()  # 256 names at most
        new = records.where(sound).select("h", "line", F.substring("h", 1, 2).alias("shard")).dropDuplicates(["shard", "h"])
        new = new.join(self.records(seen.shards).select("shard", "h"), ["shard", "h"], "left_anti")
        before = {s: n for s, (n, *_) in self.digests().items()}
        if seen.shards:
            new.repartition("shard").write.partitionBy("shard").parquet(f"{self.path}/records/batch={uuid.uuid4().hex}")  # writers at once do not share a folder
            self._publish(seen.shards)
        after = {s: n for s, (n, *_) in self.digests().items()}
        return {"added": sum(after.get(s, 0) - before.get(s, 0) for s in seen.shards), "quarantined": seen.bad}

    def _publish(self, touched: list[str]) -> None:
        for _ in range(RETRIES + 1):
            last = int(self._roots()[-1]) if self._roots() else 0
            state = self.digests()
            lanes = [F.bit_xor(F.xxhash64(F.lit(i), F.col("h"))).alias(f"x{i}") for i in (1, 2)]
            for r in self.records(touched).groupBy("shard").agg(F.count("*").alias("n"), *lanes).collect():
                state[r.shard] = [r.n, r.x1, r.x2]
            fs, where = self._fs(f"roots/{last + 1:012d}")
            try:
                out = fs.create(where, False)
            except Exception:  # the number is taken
                if not fs.exists(where):
                    raise
                continue
            out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
            out.close()
            return
        raise RuntimeError("another writer was first each time")


def sync(a: Replica, b: Replica) -> dict:
    """Bring two replicas to the union of both: only partitions whose digests differ are read, and only what is missing is written."""
    of_a, of_b = a.digests(), b.digests()
    differ = sorted(s for s in of_a.keys() | of_b.keys() if of_a.get(s) != of_b.get(s))
    if not differ:
        return {"up_to_date": True, "shards": 0, "pulled": 0, "pushed": 0, "quarantined": 0}
    mine, theirs = a.records(differ), b.records(differ)
    pull = theirs.join(mine.select("shard", "h"), ["shard", "h"], "left_anti").select("h", "line")
    push = mine.join(theirs.select("shard", "h"), ["shard", "h"], "left_anti").select("h", "line")
    pulled = a.append(pull)
    pushed = b.append(push)
    return {"up_to_date": False, "shards": len(differ), "pulled": pulled["added"], "pushed": pushed["added"], "quarantined": pulled["quarantined"] + pushed["quarantined"]}
