"""Choke points: vertices whose removal disconnects a graph, by parallel biconnectivity.

A spanning forest (every component hooks to its smallest neighbour) gives the roots.  From them a breadth-first forest is grown, level by
level; preorder numbers, subtree sizes, the least and greatest number that each subtree touches, and the topmost tree edge on a common
cycle go up and down its levels, so every vertex is handled once for each of them.  Only the topmost edges, and what links them, are
left for the components whose members are the blocks.

A forest deeper than ``LEVELS`` is given up for an Euler tour of the spanning forest (list ranking by pointer doubling), with range minima by
doubling: every step then takes a number of rounds that grows with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..sources.rounds import Rounds
from .graph import labelled
from .running import running

#: Levels of a breadth-first forest that is worked through level by level.
LEVELS = 24


def chokepoints(nodes: DataFrame | None, edges: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``id, splits``: how many further parts each choke point's removal makes; other vertices have no row.

    ``nodes``: ``id``; ``edges``: ``src, dst``, taken without direction, repeats, loops and unknown ends.  Null ids take no part.
    Without ``nodes`` all ends of edges are known, and long ids are taken as they are.
    """
    kept = Rounds(edges.sparkSession, "chokepoints")
    names, ends = None, edges.where("src <> dst").select("src", "dst")
    if nodes is None and all(isinstance(edges.schema[c].dataType, LongType) for c in ("src", "dst")):
        pairs = ends.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    else:
        nodes = ends.select(F.col("src").alias("id")).union(ends.select("dst")) if nodes is None else nodes
        names = kept.keep(nodes.select("id").where("id is not null").distinct().withColumn("one", F.lit(1).cast("long")))
        names = kept.keep(running(kept, names, ["id"], adds=["one"]).select("id", F.col("run_one").alias("v")))
        by = lambda c, to: names.select(F.col("id").alias(c), F.col("v").alias(to))
        pairs = ends.join(by("src", "a"), "src").join(by("dst", "b"), "dst")
    e = kept.keep(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    forest = _spanning_forest(kept, e)
    roots = kept.keep(forest.select("u").union(forest.select("v")).distinct().join(forest.select(F.col("c").alias("u")), "u", "left_anti"))
    grown = _breadth_first(kept, e, roots, levels)
    if grown is None:
        tree = _preorder(kept, forest, roots)
        blocks = _blocks(kept, e, forest.select("u", "v"), tree)
    else:
        placed = _numbered(kept, grown)
        tree = _all(placed)
        blocks = _blocks_by_level(kept, e, placed)
    # every block at a vertex has a tree edge at it: the one to its parent or to a child
    at = blocks.select("p", "block").union(blocks.select("up", "block")).distinct().groupBy("p").agg((F.count("*") - 1).alias("splits")).where("splits > 0")
    found = at.join(tree.select("p", "v"), "p")
    return kept.result(found.select(F.col("v").alias("id"), "splits") if names is None else found.join(names, "v").select("id", "splits"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _breadth_first(kept: Rounds, e: DataFrame, roots: DataFrame, levels: int) -> list[DataFrame] | None:
    """``v, parent`` of each level of a breadth-first forest, the roots first; none where there are more than ``levels`` below them."""
    both = kept.keep(e.select(F.col("u").alias("parent"), "v").union(e.select("v", "u")))
    grown = [kept.keep(roots.select(F.col("u").alias("v"), F.lit(None).cast("long").alias("parent")))]
    while kept.seen["n"]:
        if len(grown) > levels + 1:
            return None
        # a neighbour of a level is in it, in the one before or in the next
        near = both.join(grown[-1].select(F.col("v").alias("parent")), "parent").groupBy("v").agg(F.min("parent").alias("parent"))
        grown.append(kept.keep(near.join(_all(grown[-2:]).select("v"), "v", "left_anti")))
    return grown[: max(len(grown) - 1, 1)]


def _numbered(kept: Rounds, grown: list[DataFrame]) -> list[DataFrame]:
    """Each level with ``v, p, up, size, over``: preorder number, its parent's (null: root), the size of the subtree and of the parent's."""
    sized = [kept.keep(grown[-1].withColumn("size", F.lit(1).cast("long")))]
    for level in grown[-2::-1]:
        below = sized[-1].groupBy(F.col("parent").alias("v")).agg(F.sum("size").alias("below"))
        sized.append(kept.keep(level.join(below, "v", "left").select("v", "parent", (F.coalesce("below", F.lit(0)) + 1).alias("size"))))
    none = F.lit(None).cast("long")
    top = running(kept, sized[-1], ["v"], adds=["size"])
    out = [kept.keep(top.select("v", (F.col("run_size") - F.col("size") + 1).alias("p"), none.alias("up"), "size", none.alias("over")))]
    for level in sized[-2::-1]:
        mine = running(kept, level, ["v"], group=["parent"], adds=["size"])
        above = out[-1].select(F.col("v").alias("parent"), F.col("p").alias("up"), F.col("size").alias("over"))
        out.append(kept.keep(mine.join(above, "parent").select("v", (F.col("up") + 1 + F.col("run_size") - F.col("size")).alias("p"), "up", "size", "over")))
    return out


def _blocks_by_level(kept: Rounds, e: DataFrame, placed: list[DataFrame]) -> DataFrame:
    """``p, up, block`` of every tree edge, known by its lower end ``p``."""
    tree = _all(placed)
    end = lambda c, to, up: tree.select(F.col("v").alias(c), F.col("p").alias(to), F.coalesce("up", F.lit(0)).alias(up))
    rest = e.join(end("u", "a", "ua"), "u").join(end("v", "b", "ub"), "v").where("ua <> b and ub <> a").select("a", "b")
    rest = kept.keep(rest)  # in a breadth-first forest these never join a vertex with one above it
    reach = kept.keep(rest.select(F.col("a").alias("p"), F.col("b").alias("q")).union(rest.select("b", "a")).groupBy("p").agg(F.min("q").alias("low"), F.max("q").alias("high")))
    found: list[DataFrame] = []
    for level in placed[:0:-1]:  # what the subtrees touch, from the lowest level up
        own = level.join(reach, "p", "left")
        if found:
            below = found[-1].groupBy(F.col("up").alias("p")).agg(F.min("low").alias("low2"), F.max("high").alias("high2"))
            own = own.join(below, "p", "left").withColumns({"low": F.least("low", "low2"), "high": F.greatest("high", "high2")})
        found.append(kept.keep(own.select("p", "up", "over", F.least("low", "p").alias("low"), F.greatest("high", "p").alias("high"))))
    if not found:
        return placed[0].select("p", "up", F.col("p").alias("block")).where("false")
    tops = [found[-1].select("p", "up", F.col("p").alias("top"))]  # nothing is above the edges at a root
    for level in found[-2::-1]:
        joined = (F.col("low") < F.col("up")) | (F.col("high") >= F.col("up") + F.col("over"))
        above = tops[-1].select(F.col("p").alias("up"), F.col("top").alias("above"))
        tops.append(kept.keep(level.join(above, "up").select("p", "up", F.when(joined, F.col("above")).otherwise(F.col("p")).alias("top"))))
    edges = _all(tops)
    to = lambda c, t: edges.select(F.col("p").alias(c), F.col("top").alias(t))
    links = rest.join(to("a", "src"), "a").join(to("b", "dst"), "b").where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    of = labelled(kept, edges.where("p = top").select(F.col("p").alias("id")), kept.keep(links))
    return kept.keep(edges.join(of.select(F.col("id").alias("top"), F.col("component").alias("block")), "top").select("p", "up", "block"))


def _spanning_forest(kept: Rounds, e: DataFrame) -> DataFrame:
    """Edges ``u, v`` of ``e`` that make a spanning forest, each with the component ``c`` that hooked by it; a root hooks never."""
    cross = kept.keep(e.select(F.col("u").alias("cu"), F.col("v").alias("cv"), "u", "v"))
    forest = e.where("false").withColumn("c", F.col("u"))
    while kept.seen["n"]:
        low, high = F.least("cu", "cv"), F.greatest("cu", "cv")
        hooks = kept.keep(cross.groupBy(high.alias("c")).agg(F.min(F.struct(low.alias("to"), "u", "v")).alias("h")).select("c", "h.to", "h.u", "h.v"))
        forest = kept.keep(forest.union(hooks.select("u", "v", "c")))
        up = kept.keep(hooks.select("c", "to"))
        while True:  # flatten the hooks; they go to smaller numbers, so there are no cycles
            above = up.select(F.col("c").alias("to"), F.col("to").alias("top"))
            new = kept.keep(up.join(above, "to", "left").select("c", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("moved")), moved=F.count_if(F.col("moved")))
            kept.drop(up)
            up = new
            if not kept.seen["moved"]:
                break
        for side in ("cu", "cv"):
            cross = cross.join(up.select(F.col("c").alias(side), F.col("to").alias("_new")), side, "left").withColumn(side, F.coalesce("_new", side)).drop("_new")
        cross = kept.keep(cross.where("cu <> cv").select("cu", "cv", "u", "v"))
    return forest


def _preorder(kept: Rounds, forest: DataFrame, roots: DataFrame) -> DataFrame:
    """``v, p, up, size`` of every vertex with an edge: preorder number, its parent's (null: root) and the size of its subtree."""
    one = F.lit(1).cast("long").alias("one")
    arcs = kept.keep(forest.select("u", "v", one).union(forest.select("v", "u", one)))
    arcs = kept.keep(running(kept, arcs, ["u", "v"], adds=["one"]).select("u", "v", F.col("run_one").alias("arc")))
    # around each vertex its arcs go in order of their number, and after the last comes the first
    first = arcs.groupBy("u").agg(F.min("arc").alias("first"))
    after = arcs.select((F.col("arc") - 1).alias("arc"), F.col("u").alias("same"))
    turn = arcs.join(after, "arc", "left").withColumn("last", ~F.coalesce(F.col("same") == F.col("u"), F.lit(False)))
    ring = turn.where("not last").select("u", "v", (F.col("arc") + 1).alias("turn")).union(turn.where("last").join(first, "u").select("u", "v", F.col("first").alias("turn")))
    # the tour leaves a vertex by the arc after the one that came in; it ends before a root's first arc
    roots = roots.join(first, "u").select(F.col("first").alias("turn"), F.lit(True).alias("cut"))
    ring = ring.join(roots, "turn", "left").select(F.col("v").alias("u"), F.col("u").alias("v"), F.when(F.col("cut").isNull(), F.col("turn")).alias("next"))
    tour = arcs.join(ring, ["u", "v"]).select("arc", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("left"), F.coalesce("next", "arc").alias("end"))
    tour = kept.keep(tour, open=F.count_if(F.col("next").isNotNull()))
    while kept.seen["open"]:  # pointer doubling: how many arcs are left to the end, and which is the end
        jump = tour.select(F.col("arc").alias("next"), F.col("next").alias("far"), F.col("left").alias("more"), F.col("end").alias("last"))
        new = tour.join(jump, "next", "left").select("arc", F.col("far").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"), F.coalesce("last", "end").alias("end"))
        new = kept.keep(new, open=F.count_if(F.col("next").isNotNull()))
        kept.drop(tour)
        tour = new
    placed = kept.keep(arcs.join(tour.select("arc", "left", "end"), "arc"))
    back = placed.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("left").alias("back"))
    both = kept.keep(placed.join(back, ["u", "v"]))
    down = both.where("left > back")
    seen = down.select("end", (-F.col("left")).alias("turn"), F.col("v"), F.col("u").alias("parent"), ((F.col("left") - F.col("back") + 1) / 2).cast("long").alias("size"), one)
    # a root stands before its tour, which ends with the arc into it
    end = both.where("arc = end").select("end", F.lit(-(2**62)).alias("turn"), F.col("v"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("size"), one)
    numbered = running(kept, kept.keep(seen.union(end)), ["end", "turn"], adds=["one"]).withColumnRenamed("run_one", "p")
    numbered = kept.keep(numbered.select("v", "p", "parent", "size", "end"))
    whole = numbered.groupBy("end").agg(F.count("*").alias("all"))
    top = numbered.where("parent is null").join(whole, "end").select("v", "p", F.lit(None).cast("long").alias("up"), F.col("all").alias("size"))
    under = numbered.where("parent is not null").join(numbered.select(F.col("v").alias("parent"), F.col("p").alias("up")), "parent").select("v", "p", "up", "size")
    return kept.keep(under.union(top))


def _blocks(kept: Rounds, e: DataFrame, forest: DataFrame, tree: DataFrame) -> DataFrame:
    """``p, up, block`` of every tree edge, known by its lower end ``p``."""
    number = tree.select("v", "p", "size")
    rest = e.join(forest, ["u", "v"], "left_anti").join(number.select(F.col("v").alias("u"), F.col("p").alias("a"), F.col("size").alias("sa")), "u").join(number.select("v", F.col("p").alias("b"), F.col("size").alias("sb")), "v")
    rest = kept.keep(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("sa")).otherwise(F.col("sb")).alias("size")))
    touched = rest.select(F.col("a").alias("p"), F.col("b").alias("q")).union(rest.select("b", "a")).union(tree.select("p", "p"))
    reach = kept.keep(touched.groupBy("p").agg(F.min("q").alias("low"), F.max("q").alias("high")))
    # reach of 2**k numbers from p on; a subtree is two such stretches
    level = F.floor(F.log2("size") + 1e-9).cast("int")
    wide = kept.keep(tree.where("up is not null").withColumn("k", level), deepest=F.max("k"))
    deepest = -1 if kept.seen["deepest"] is None else kept.seen["deepest"]
    found = None
    for k in range(deepest + 1):
        mine = wide.where(F.col("k") == k).withColumn("q", F.col("p") + F.col("size") - 2**k)
        one = mine.join(reach, "p").join(reach.select(F.col("p").alias("q"), F.col("low").alias("low2"), F.col("high").alias("high2")), "q")
        one = one.select("p", "up", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high"))
        found = kept.keep(one if found is None else found.union(one))
        if k < deepest:
            next_ = reach.select((F.col("p") - 2**k).alias("p"), F.col("low").alias("low2"), F.col("high").alias("high2"))
            new = kept.keep(reach.join(next_, "p", "left").select("p", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")))
            kept.drop(reach)
            reach = new
    if found is None:
        return wide.select("p", "up", F.col("p").alias("block"))
    over = wide.select(F.col("p").alias("up"), F.col("size").alias("over"))  # parents that are not roots
    on_cycle = found.join(over, "up").where((F.col("low") < F.col("up")) | (F.col("high") >= F.col("up") + F.col("over"))).select(F.col("up").alias("src"), F.col("p").alias("dst"))
    apart = rest.where("a + size <= b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    of = labelled(kept, wide.select(F.col("p").alias("id")), kept.keep(on_cycle.union(apart)))
    return kept.keep(wide.select("p", "up").join(of.select(F.col("id").alias("p"), F.col("component").alias("block")), "p").select("p", "up", "block"))
