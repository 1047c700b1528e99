"""Context under a token budget: what is required is shortened before anything is dropped, the rest fills up by value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.rounds import Rounds
from .running import running

# What each further item of one source is worth, and the worth after which a task takes no more.
DISCOUNT, WORTHLESS = 0.7, 0.2


def assembled(items: DataFrame, budget: int = 6000) -> DataFrame:
    """``task, item, source, level, tokens, required``: the items chosen for each task, each at one level of its ladder.

    ``items``: ``task, item, source, ord, score, covers array<string>, ladder array<struct<level, tokens long>>`` (full text first).  Rows of one
    item count as one: all that any of them covers, the best score, the first one's ladder.  An item that covers something is required: all of those
    are taken, and while they exceed the budget the longest one that has a shorter form goes one level down (of equals
    the first by ``ord``, then by item).  Required items stay even if all in their shortest form exceed the budget.  The others come by score, then item; each is taken
    at full length if it still fits, until a source has given so many that the last one's worth is spent.  Rows without
    task, item or ladder take no part.
    """
    kept = Rounds(items.sparkSession, "assembled")
    sound = items.where("task is not null and item is not null and size(ladder) > 0")
    first = F.min_by(F.struct("source", "ladder", "ord"), F.struct(F.coalesce("ord", F.lit(2**62)), "source")).alias("f")
    one = sound.groupBy("task", "item").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("covers", F.array().cast("array<string>"))))).alias("covers"), F.max("score").alias("score"), first)
    one = kept.keep(one.select("task", "item", (F.size("covers") > 0).alias("required"), "score", F.coalesce("f.ord", F.lit(2**62)).alias("ord"), "f.source", "f.ladder"))
    must = _shortened(kept, one.where("required"), budget)
    spent = must.groupBy("task").agg(F.sum("tokens").alias("spent"))
    rest = one.where("not required").select("task", "item", "source", "score", F.col("ladder")[0].alias("top"))
    more = _filled(kept, rest, spent, budget)
    return kept.result(must.withColumn("required", F.lit(True)).unionByName(more.withColumn("required", F.lit(False))))


def _shortened(kept: Rounds, must: DataFrame, budget: int) -> DataFrame:
    """Required items at their levels.

    Steps down come in one order whatever the budget: by the length they start from, and a step that a shorter one of its
    item stands before comes right after that.  So a running sum of what they save tells after which step a task fits.
    """
    whole = must.groupBy("task").agg(F.sum(F.col("ladder")[0]["tokens"]).alias("whole"))
    steps = must.where(F.size("ladder") > 1).select("task", "item", "ord", "ladder", F.explode(F.sequence(F.lit(0), F.size("ladder") - 2)).alias("step"))
    at = lambda i: F.get(F.col("ladder.tokens"), i)
    steps = steps.select("task", "item", "ord", "step", (-F.array_min(F.slice(F.col("ladder.tokens"), 1, F.col("step") + 1))).alias("turn"), (at(F.col("step")) - at(F.col("step") + 1)).alias("saved"), F.lit(1).cast("long").alias("one"))
    placed = running(kept, kept.keep(steps), ["turn", "ord", "item", "step"], ["task"], adds=["saved", "one"])
    enough = placed.join(whole, "task").groupBy("task").agg(F.min(F.when(F.col("whole") - F.col("run_saved") <= budget, F.col("run_one"))).alias("last"))
    last = whole.join(enough, "task", "left").select("task", F.when(F.col("whole") <= budget, 0).otherwise(F.coalesce("last", F.lit(2**62))).alias("last"))
    down = placed.join(last, "task").where("run_one <= last").groupBy("task", "item").agg(F.count("*").cast("int").alias("down"))
    chosen = must.join(down, ["task", "item"], "left").withColumn("c", F.get("ladder", F.coalesce("down", F.lit(0))))
    return kept.keep(chosen.select("task", "item", "source", "c.level", "c.tokens"))


def _filled(kept: Rounds, rest: DataFrame, spent: DataFrame, budget: int) -> DataFrame:
    """The other items that fit, taken in order, each if what is left allows it.

    With ``t`` the largest power of two in what is left, every item of at most t is taken as long as t is left, none of 2 t or more
    ever is, and one in between ends that state.  So a round is one running sum up to each task's first such end, and
    what is left halves: the rounds are the logarithm of the budget, however many items there are.
    """
    ordered = rest.select("task", "item", "source", "top.level", "top.tokens", (-F.coalesce("score", F.lit(float("-inf")))).alias("turn"), F.lit(1).cast("long").alias("one"))
    ordered = running(kept, kept.keep(ordered), ["turn", "item"], ["task"], adds=["one"]).select("task", "item", "source", "level", "tokens", F.col("run_one").alias("pos"))
    open_ = kept.keep(ordered.join(spent, "task", "left").withColumn("left", budget - F.coalesce("spent", F.lit(0))).drop("spent").where("left >= 0 and tokens <= left"))
    taken = open_.drop("left").where("false")
    while kept.seen["n"]:
        small = F.when(F.col("left") == 0, 0).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("left") + 1e-9))).cast("long")
        now = kept.keep(open_.withColumn("small", small).withColumn("part", F.when(F.col("tokens") <= F.col("small"), F.col("tokens")).otherwise(0)))
        now = running(kept, now, ["pos"], ["task"], adds=["part"])
        after = F.col("left") - F.col("run_part")
        easy = F.col("tokens") <= F.col("small")
        ends = F.when(easy, after < F.col("small")).otherwise(F.col("tokens") <= after)
        stop = kept.keep(now.groupBy("task").agg(F.min(F.when(ends, F.col("pos"))).alias("stop")))
        now = now.join(stop, "task").withColumn("stop", F.coalesce("stop", F.lit(2**62)))
        mine = (F.col("pos") <= F.col("stop")) & (easy | (F.col("pos") == F.col("stop")))
        now = kept.keep(now.withColumn("mine", mine).drop("run_part", "part", "small"))
        taken = kept.keep(taken.unionByName(now.where("mine").select(*taken.columns)))
        used = now.where("mine").groupBy("task").agg(F.sum("tokens").alias("used"))
        open_ = now.where("pos > stop").join(used, "task").withColumn("left", F.col("left") - F.col("used")).where("tokens <= left").select(*open_.columns)
        open_ = kept.keep(open_)
    # a source's n-th item is worth DISCOUNT ** (n - 1); the first one worth too little is the task's last
    n = F.row_number().over(Window.partitionBy("task", "source").orderBy("pos"))
    ranked = taken.withColumn("n", n)
    last = ranked.where(F.pow(F.lit(DISCOUNT), F.col("n") - 1) < WORTHLESS).groupBy("task").agg(F.min("pos").alias("last"))
    return ranked.join(last, "task", "left").where("last is null or pos <= last").select("task", "item", "source", "level", "tokens")


def complete(required: DataFrame, chosen: DataFrame, items: DataFrame) -> DataFrame:
    """``task, ok, missing, questions``: required keys that no chosen item covers, and those that nothing could.

    ``required``: ``task, key, resolvable``; ``chosen`` and ``items`` as in ``assembled``.
    """
    covered = chosen.select("task", "item").join(items.select("task", "item", F.explode("covers").alias("key")), ["task", "item"]).select("task", "key", F.lit(True).alias("has")).distinct()
    r = required.groupBy("task", "key").agg(F.bool_and("resolvable").alias("resolvable")).join(covered, ["task", "key"], "left")
    gone = ~F.col("resolvable") | F.col("has").isNull()
    return r.groupBy("task").agg((F.count_if(gone) == 0).alias("ok"), F.count_if(gone).alias("missing"), F.count_if(~F.col("resolvable")).alias("questions"))
