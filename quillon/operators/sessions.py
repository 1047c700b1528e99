"""Session logs: correction signals, contradictions and doom loops by window functions.

Rows are ``sid, seq, type (edit, bash, prompt), file, command, exit_code, output_sig, text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Commands and words that carry a signal.
TEST_RUN = r"\b(npm\s+(run\s+)?test|node\s+--test|jest|vitest|pytest|go\s+test|cargo\s+test)\b"
REVERT = r"\bgit\s+(revert|reset\s+--hard|checkout\s+--|restore)\b"
OBJECTION = r"(?i)\b(undo|revert|that'?s\s+wrong|not\s+what|you\s+broke|regression|wrong\s+again)\b"


def _log(by: list[str]):
    return Window.partitionBy(*by).orderBy("seq")


def signals(events: DataFrame) -> DataFrame:
    """``sid, file, signal``: S1 failed, edited, passed; S2, S3 edited again; S5 objected to."""
    edit = (F.col("type") == "edit") & (F.col("file") != "")
    test = (F.col("type") == "bash") & F.col("command").rlike(TEST_RUN)
    passed, failed = F.coalesce(test & (F.col("exit_code") == 0), F.lit(False)), F.coalesce(test & (F.col("exit_code") != 0), F.lit(False))
    before = _log(["sid"]).rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumns({"_edit": F.coalesce(edit, F.lit(False)), "_pass": passed, "_fail": failed})
    e = e.withColumn("_run", F.coalesce(F.sum(F.col("_pass").cast("int")).over(before), F.lit(0)))
    # A run ends with its pass: what was edited after the run's first failure was mended by it.
    run = Window.partitionBy("sid", "_run")
    mended = F.col("_edit") & F.bool_or("_fail").over(run.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)) & F.bool_or("_pass").over(run)
    nth = F.row_number().over(_log(["sid", "file", "_edit"]))
    last = F.last(F.when(F.col("_edit"), F.col("file")), ignorenulls=True).over(before)
    e = e.withColumns({"_s1": mended, "_nth": nth, "_last": last})
    objected = (F.col("type") == "prompt") & F.col("text").rlike(OBJECTION) & F.col("_last").isNotNull()
    found = F.array(
        F.when(F.col("_s1"), F.struct("file", F.lit("S1").alias("signal"))),
        F.when(F.col("_edit") & (F.col("_nth") >= 2), F.struct("file", F.lit("S2").alias("signal"))),
        F.when(F.col("_edit") & (F.col("_nth") >= 3), F.struct("file", F.lit("S3").alias("signal"))),
        F.when(objected, F.struct(F.col("_last").alias("file"), F.lit("S5").alias("signal"))),
    )
    return e.select("sid", F.explode(F.array_compact(found)).alias("f")).select("sid", "f.file", "f.signal").distinct()


def contradictions(events: DataFrame) -> DataFrame:
    """``sid, seq, files``: the last three edits before each revert."""
    before = _log(["sid"]).rowsBetween(Window.unboundedPreceding, -1)
    edit = F.when((F.col("type") == "edit") & (F.col("file") != ""), F.col("file"))
    e = events.withColumn("_n", F.count(edit).over(before)).withColumn("_edit", edit)
    reverts = e.where((F.col("type") == "bash") & F.col("command").rlike(REVERT)).select("sid", "seq", "_n")
    # Edits carry their number, so a revert finds its three by key and no list grows with the session.
    wanted = reverts.select("sid", "seq", F.explode(F.when(F.col("_n") > 0, F.sequence(F.greatest(F.lit(1), F.col("_n") - 2), F.col("_n"))).otherwise(F.array(F.lit(0).cast("long")))).alias("k"))
    edits = e.where("_edit is not null").select("sid", (F.col("_n") + 1).alias("k"), "_edit")
    rows = wanted.join(edits, ["sid", "k"], "left").groupBy("sid", "seq").agg(F.array_sort(F.collect_list(F.when(F.col("_edit").isNotNull(), F.struct("k", "_edit")))).alias("f"))
    return rows.select("sid", "seq", F.transform("f", lambda x: x["_edit"]).alias("files"))


def doom_loops(events: DataFrame, threshold: int = 3) -> DataFrame:
    """``sid, signature, n, files``: each session's most frequent failure, if frequent enough."""
    after = _log(["sid"]).rowsBetween(0, Window.unboundedFollowing)
    sig = F.when((F.col("type") == "bash") & (F.col("output_sig") != ""), F.col("output_sig"))
    e = events.withColumn("_sig", sig).withColumn("_next", F.first("_sig", ignorenulls=True).over(after))
    files = F.array_sort(F.collect_set(F.when((F.col("type") == "edit") & (F.col("file") != ""), F.col("file"))))
    counted = e.where("_next is not null").groupBy("sid", F.col("_next").alias("signature")).agg(F.count("_sig").alias("n"), F.min(F.when(F.col("_sig").isNotNull(), F.col("seq"))).alias("_first"), files.alias("files"))
    best = counted.where(F.col("n") >= threshold).groupBy("sid").agg(F.min_by(F.struct("signature", "n", "files"), F.struct(-F.col("n"), "_first")).alias("b"))
    return best.select("sid", "b.*")


def daily_history(events: DataFrame, now_day: int, days: int = 90) -> DataFrame:
    """``day, n, saved``: one row for each of the last ``days`` days, zero-filled; later rows are left out."""
    spine = events.sparkSession.range(now_day - days + 1, now_day + 1).select(F.col("id").cast("int").alias("day"))
    sums = events.where(F.col("day").between(now_day - days + 1, now_day)).groupBy("day").agg(F.count("*").alias("n"), F.sum("saved").alias("saved"))
    return spine.join(sums, "day", "left").na.fill(0, ["n"]).na.fill(0.0, ["saved"])
