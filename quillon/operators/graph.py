"""Iterative graph operators on edge tables: one job a round, whose table is kept in the shared folder until the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.rounds import Rounds


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 60, tol: float = 1e-9) -> DataFrame:
    """``id, rank`` over weighted edges ``src, dst, w``; dangling mass is spread evenly.

    Self-edges and edges to unknown nodes are dropped, parallel edges add up.
    """
    kept = Rounds(nodes.sparkSession, "page-rank")
    nodes = kept.keep(nodes.select("id").distinct())
    n = kept.seen["n"]
    e = edges.where("src <> dst and w > 0").join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = e.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    e = kept.keep(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    loose = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))
    sources = e.select(F.col("src").alias("id"), F.lit(False).alias("dangling")).distinct()
    rank = kept.keep(nodes.join(sources, "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling"), F.lit(1.0 / max(n, 1)).alias("rank")), loose=loose)
    for _ in range(rounds if n else 0):
        base = (1 - damping) / n + damping * kept.seen["loose"] / n
        got = e.join(rank, e["src"] == rank["id"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("x"))
        new = rank.join(got, rank["id"] == got["dst"], "left").select("id", "dangling", F.col("rank").alias("old"), (F.lit(base) + damping * F.coalesce("x", F.lit(0.0))).alias("rank"))
        new = kept.keep(new, loose=loose, moved=F.sum(F.abs(F.col("rank") - F.col("old"))))
        kept.drop(rank)
        rank = new
        if kept.seen["moved"] < tol:
            break
    return kept.result(rank.select("id", "rank"))


def impact(edges: DataFrame, starts: DataFrame, decay: float = 0.85, threshold: float = 0.1, hops: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """``id, strength, hops``: best product of edge confidences on a path to a start, walked backwards.

    Edges are ``src, dst, w`` (src depends on dst); starts are never entered again.  Of equally strong paths the one found first counts.
    With ``by``, starts are ``*by, id`` and each of its values has starts and results of its own, all walked together.
    """
    kept = Rounds(edges.sparkSession, "impact")
    key = [*by, "id"]
    e = kept.keep(edges.groupBy(F.col("dst").alias("id"), F.col("src").alias("to")).agg(F.max("w").alias("w")).where("w is not null"))
    fronts = [kept.keep(starts.select(*key).distinct().select(*key, F.lit(1.0).alias("strength"), F.lit(0).alias("hops")))]
    # a round writes only what it reached more strongly than all before; no offer is better than a start
    best = F.when(F.col("hops") == 0, float("inf")).otherwise(F.col("strength"))
    for hop in range(1, hops + 1):
        step = fronts[-1].join(e, "id").select(*by, F.col("to").alias("id"), (F.col("strength") * F.col("w") * decay).alias("offer")).where(F.col("offer") >= threshold)
        step = step.withColumn("best", F.lit(None).cast("double"))
        for f in fronts:
            step = step.union(f.select(*key, F.lit(None).cast("double"), best))
        new = step.groupBy(*key).agg(F.max("offer").alias("offer"), F.max("best").alias("best")).where("offer > coalesce(best, 0.0)")
        fronts.append(kept.keep(new.select(*key, F.col("offer").alias("strength"), F.lit(hop).alias("hops"))))
        if not kept.seen["n"]:
            break
    found = fronts[0].where("false")
    for f in fronts[1:]:
        found = found.union(f)
    return kept.result(found.groupBy(*key).agg(F.max("strength").alias("strength"), F.max("hops").alias("hops")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable).

    Every id holds a label, at first itself.  In a round each edge offers the label's label of its one end to the other end and
    to that end's label, and every id takes the least of its offers, so trees of labels merge and flatten at once.
    """
    kept = Rounds(nodes.sparkSession, "components")
    out = kept.result(labelled(kept, nodes, edges))
    return out


def labelled(kept: Rounds, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The rounds of ``components`` in a run that others go on with."""
    both = kept.keep(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    label = kept.keep(nodes.select("id", F.col("id").alias("label")).distinct())
    while True:
        up = label.select(F.col("id").alias("label"), F.col("label").alias("above"))
        near = label.join(up, "label")
        low = both.join(near.select(F.col("id").alias("dst"), F.col("above").alias("m")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("m").alias("m"))
        met = near.join(low, "id", "left")
        own = met.select("id", F.least("above", "m").alias("x"), F.col("label").alias("old"))
        offers = own.union(met.where("m is not null").select("label", "m", F.lit(None)))
        new = kept.keep(offers.groupBy("id").agg(F.min("x").alias("label"), F.max("old").alias("old")), moved=F.count_if(F.col("label") != F.col("old")))
        kept.drop(label)
        label = new
        if not kept.seen["moved"]:
            return label.select("id", F.col("label").alias("component"))


def strong_components(edges: DataFrame) -> DataFrame:
    """``id, component`` (largest id in it) of nodes on a cycle of two or more; edges are ``src, dst``.

    Nodes with a single way out make chains, which pointers that double follow to their ends: a cycle of such nodes is a component,
    any other chain is drawn together into the node at its end.  Only nodes with several ways out are left for ``_coloured``;
    a chain's node belongs to the component at its end if that component leads into the chain at or before the node.
    """
    kept = Rounds(edges.sparkSession, "strong-components")
    live = kept.keep(edges.select("src", "dst").where("src <> dst").distinct())
    out = kept.keep(live.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("to"), F.count("*").alias("ways")), single=F.count_if(F.col("ways") == 1))
    single, branches = kept.seen["single"], kept.seen["n"] - (kept.seen["single"] or 0)
    if not single:
        return kept.result(_coloured(kept, kept.keep(live)))
    # where each lies 1, 2, 4, ... steps on (at the end of the chain, if that comes first), and the largest id on the way there
    jumps = [kept.keep(out.where("ways = 1").select("id", "to", F.col("id").alias("top")))]
    while 2 ** (len(jumps) - 1) < single:
        far = jumps[-1].select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("top").alias("over"))
        new = jumps[-1].join(far, "to", "left").select("id", F.coalesce("far", "to").alias("to"), F.greatest("top", "over").alias("top"), F.col("far").isNotNull().alias("moved"))
        jumps.append(kept.keep(new, moved=F.count_if(F.col("moved"))))
        if not kept.seen["moved"]:
            break
    chain = jumps[0].select("id")
    ring = kept.keep(jumps[-1].select(F.col("to").alias("id")).distinct().join(chain, "id", "left_semi"))  # after so many steps one is on a cycle or at an end
    done = jumps[-1].join(ring, "id").select("id", F.col("top").alias("component"))
    if not branches:
        return kept.result(done)
    branch = out.where("ways > 1").select("id")
    ends = kept.keep(jumps[-1].join(branch.withColumnRenamed("id", "to"), "to", "left_semi").select("id", F.col("to").alias("end")))
    tied = live.join(branch.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left").select("src", "dst", F.coalesce("end", "dst").alias("end"))
    tied = kept.keep(tied.join(branch.withColumnRenamed("id", "end"), "end", "left_semi"))
    core = _coloured(kept, kept.keep(tied.where("src <> end").select("src", F.col("end").alias("dst")).distinct()))
    group = kept.keep(branch.join(core, "id", "left").select("id", F.coalesce("component", "id").alias("g")))
    of = lambda c, g: group.select(F.col("id").alias(c), F.col("g").alias(g))
    back = tied.where("dst <> end").join(of("src", "a"), "src").join(of("end", "b"), "end").where("a = b")
    marked = kept.keep(back.select(F.col("dst").alias("id")).distinct())
    for jump in jumps:
        marked = kept.keep(marked.union(jump.join(marked, "id", "left_semi").select(F.col("to").alias("id")).join(ends, "id", "left_semi")).distinct())
    members = kept.keep(group.union(ends.join(marked, "id", "left_semi").join(of("end", "g"), "end").select("id", "g")))
    large = members.groupBy("g").agg(F.max("id").alias("component"), F.count("*").alias("k")).where("k > 1").select("g", "component")
    return kept.result(done.union(members.join(large, "g").select("id", "component")))


def _coloured(kept: Rounds, live: DataFrame) -> DataFrame:
    """Components by forward colours: every node takes the largest id that reaches it.

    A colour's own node together with the nodes of that colour that reach it is a component; the rest goes on.  ``live`` was kept last.
    """
    done = live.select(F.col("src").alias("id"), F.col("dst").alias("component")).where("false")
    while kept.seen["n"]:
        nodes = live.select(F.col("src").alias("id")).union(live.select("dst")).distinct()
        colour = kept.keep(nodes.select("id", F.col("id").alias("c")))
        while True:
            got = live.join(colour, live["src"] == colour["id"]).groupBy("dst").agg(F.max("c").alias("m"))
            new = colour.join(got, colour["id"] == got["dst"], "left").select("id", F.greatest("c", "m").alias("c"), F.col("c").alias("old"))
            new = kept.keep(new, moved=F.count_if(F.col("c") != F.col("old")))
            kept.drop(colour)
            colour = new
            if not kept.seen["moved"]:
                break
        inside = live.join(colour.select(F.col("id").alias("src"), "c"), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("c = cd").select("src", "dst", "c")
        inside = kept.keep(inside)
        back = kept.keep(colour.where("id = c").select("id", "c", F.lit(True).alias("fresh")))
        while kept.seen.get("fresh", kept.seen["n"]):
            step = inside.join(back.where("fresh").select(F.col("id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c", F.lit(True).alias("fresh"))
            new = back.withColumn("fresh", F.lit(False)).union(step).groupBy("id", "c").agg(F.min("fresh").alias("fresh"))
            new = kept.keep(new, fresh=F.count_if(F.col("fresh")))
            kept.drop(back)
            back = new
        found = back.join(back.groupBy("c").agg(F.count("*").alias("k")).where("k > 1"), "c", "left_semi").select("id", F.col("c").alias("component"))
        done = kept.keep(done.union(found))
        left = live.join(back.select(F.col("id").alias("src")), "src", "left_anti").join(back.select(F.col("id").alias("dst")), "dst", "left_anti")
        live = kept.keep(left.select("src", "dst"))
    return done
