"""Line logs and the sharded claim store as Spark sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_log(spark: SparkSession, path: str, schema: str, where: Column | None = None) -> DataFrame:
    """Rows of a JSON line log; lines that do not parse are skipped."""
    typed = StructType.fromDDL(schema).add("_bad", "string")
    rows = spark.read.schema(typed).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.where(F.col("_bad").isNull()).drop("_bad")
    return rows if where is None else rows.where(where)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def seal(*columns: str) -> Column:
    """Content hash of a record: over its fields as JSON, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "true"}), 256)


def verified(log: DataFrame, h: str = "h") -> tuple[DataFrame, DataFrame]:
    """(rows whose hash holds, one for each hash; forged rows, all of them)."""
    true = seal(*[c for c in log.columns if c != h])
    good = F.coalesce(F.col(h) == true, F.lit(False))
    return log.where(good).dropDuplicates([h]), log.where(~good)


def write_claims(claims: DataFrame, path: str) -> None:
    """Claims by the first two characters of their id."""
    claims.withColumn("shard", F.substring("id", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def new_claims(claims: DataFrame, stored: DataFrame) -> DataFrame:
    """Claims that the store does not have; putting one twice changes nothing."""
    return claims.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")


def by_prefix(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """The first claim whose id starts so; two characters or more read one partition."""
    schema = spark.read.parquet(path).drop("shard").schema.add("shard", "string")  # never a number
    rows = spark.read.schema(schema).parquet(path)
    if len(prefix) >= 2:
        rows = rows.where(F.col("shard") == prefix[:2])
    return rows.where(F.col("id").startswith(prefix)).orderBy("id").limit(1)


#: Prices of a model that no table names, for a million tokens in and out.
OTHER_PRICE = (3.0, 15.0)
_USAGE = "struct<input_tokens:bigint,output_tokens:bigint>"


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """``file, model, tokens_in, tokens_out`` of every entry of session logs (JSON lines) that reports usage, at its top or inside its message; lines that do not parse are skipped."""
    rows = spark.read.schema(f"model string, usage {_USAGE}, message struct<model:string,usage:{_USAGE}>").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").json(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.coalesce(F.nullif("model", F.lit("")), "message.model", F.lit("")).alias("model"), F.coalesce("usage", "message.usage").alias("u")).where("u is not null")
    return rows.select("file", "model", F.coalesce("u.input_tokens", F.lit(0)).alias("tokens_in"), F.coalesce("u.output_tokens", F.lit(0)).alias("tokens_out"))


def spend(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``model, tokens_in, tokens_out, sessions, cost`` in dollars; ``prices``: ``model, price_in, price_out`` for a million tokens."""
    by = usage.groupBy("model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count_distinct("file").alias("sessions"))
    at = by.join(prices, "model", "left")
    cost = F.col("tokens_in") * F.coalesce("price_in", F.lit(OTHER_PRICE[0])) + F.col("tokens_out") * F.coalesce("price_out", F.lit(OTHER_PRICE[1]))
    return at.select("model", "tokens_in", "tokens_out", "sessions", (cost / 1e6).alias("cost"))
