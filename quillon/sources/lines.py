"""Lines of documents and diffs, with what holds at each line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line`` (from 1) ``, text``; null texts have no lines."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line, text, in_code, section``: fences toggle code, and headings count outside it only."""
    w = Window.partitionBy(key).orderBy("line")
    fence = F.col("text").rlike(r"^\s*(```|~~~)")
    out = lines(docs, key, text).withColumn("fence", fence).withColumn("in_code", F.sum(F.col("fence").cast("int")).over(w) % 2 == 1)
    heading = F.when(~F.col("in_code") & F.col("text").rlike(r"^#{1,6}\s+\S"), F.trim(F.regexp_replace("text", r"^#{1,6}\s+", "")))
    return out.withColumn("section", F.last(heading, True).over(w)).select(key, "line", "text", "in_code", "section")


def diff_footprint(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, file, added, removed``: changed lines of each file of a unified diff.

    Lines before the first hunk of a file are its head; inside a hunk a line of +++ is content.
    """
    w = Window.partitionBy(key).orderBy("line")
    at = lines(diffs, key, text)
    at = at.withColumn("part", F.sum(F.col("text").startswith("diff --git ").cast("int")).over(w))
    in_part = Window.partitionBy(key, "part").orderBy("line")
    at = at.withColumn("hunk", F.max(F.col("text").startswith("@@").cast("int")).over(in_part) == 1)
    name = F.when(~F.col("hunk") & F.col("text").startswith("+++ "), F.regexp_replace("text", r"^\+\+\+ (b/)?", ""))
    at = at.withColumn("file", F.last(name, True).over(in_part)).where(F.col("hunk") & F.col("file").isNotNull())
    return at.groupBy(key, "file").agg(F.count_if(F.col("text").startswith("+")).alias("added"), F.count_if(F.col("text").startswith("-")).alias("removed"))
