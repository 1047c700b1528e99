"""URL verdicts: explicit rules first, then trust and distrust spread over links between hosts.

All steps are DataFrame functions.  A page whose url a rule fits has that rule's verdict.  Each such page is also one unit of
evidence about its host: allowed pages seed trust, blocked pages seed distrust.  Trust is a personalised page rank along the
links between hosts, distrust the same along the links reversed, so it reaches hosts that link to blocked ones.  A host
without links in the direction of travel keeps what it has.  Scores are whole millionths of a page and every share is rounded
down, so the result does not depend on the order of sums.  A page without a rule is blocked where its host's distrust
exceeds its trust by more than ``share`` of the host's pages, and allowed otherwise (also without a host).

Links are the absolute ones in ``href`` attributes; a host's links to itself say nothing and are left out, repeated links
count once.  Null html has no links; a null url, or one without ``://``, has an empty host and path, which no rule fits.
Repeated rows are judged and counted each.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _util as U
from .running import lookup

#: Score of one page.
UNIT = 1_000_000
#: Per cent of a score that travels on in a round, and rounds at most.
TRAVELS = 85
ROUNDS = 20
#: Rules are given by the caller and stand in every plan.
MOST_RULES = 1_000
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of ``(action, host/path)`` that fits, as a struct of rule and action; of two equally long ones the first by code points."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; join them by host instead")
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    out = None
    for action, rule in reversed(ordered):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        said = F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, said) if out is None else F.when(fits, said).otherwise(out)
    return out if out is not None else F.lit(None).cast("struct<rule: string, action: string>")


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst``: distinct links from a page's host to other hosts."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), 1))
    e = pages.select(host_of(F.col("url")).alias("src"), F.explode(found).alias("dst"))
    e = e.withColumn("dst", F.translate("dst", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return e.where("src <> '' AND dst <> '' AND src <> dst").distinct()


def spread(links: DataFrame, seeds: DataFrame, travels: int = TRAVELS, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust``: personalised page rank of ``host, trust, distrust`` seeds (longs) along the links, and reversed for distrust.

    Both directions are one table, so a round is one join and one sum.  A round is written to the shared folder; it ends when
    nothing changes, or after ``rounds``.  A host that very many links leave meets them by broadcast (at most 4,096 such hosts).
    """
    e = links.select(F.lit("trust").alias("way"), "src", "dst").unionByName(links.select(F.lit("distrust").alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = U.stored(e, "links")
    n_links = e.count()
    degree = e.groupBy("way", "src").agg(F.count("*").alias("n"))
    seed = U.stored(seeds.unpivot(["host"], ["trust", "distrust"], "way", "seed").where("seed > 0").select("way", F.col("host").alias("src"), "seed"), "seeds")
    score = U.stored(seed.withColumnRenamed("seed", "score").join(degree, ["way", "src"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")), "scores")
    for _ in range(rounds if n_links else 0):
        moved = _flow(e, score, n_links, travels)
        back = seed.select("way", "src", F.expr(f"seed * {100 - travels} div 100").alias("part"))
        kept = score.where("n = 0").select("way", "src", F.expr(f"score * {travels} div 100").alias("part"))
        new = moved.unionByName(back).unionByName(kept).groupBy("way", "src").agg(F.sum("part").alias("score"))
        new = U.stored(new.join(degree, ["way", "src"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")), "scores")
        same = new.join(score.withColumnRenamed("score", "before"), ["way", "src"], "full").where("NOT (score <=> before)").isEmpty()
        U.drop_stored(score, settle_=False)
        score = new
        if same:
            break
    out = U.stored(score.groupBy(F.col("src").alias("host")).agg(*(F.coalesce(F.sum(F.when(F.col("way") == w, F.col("score"))), F.lit(0)).cast("long").alias(w) for w in ("trust", "distrust"))), "trust")
    U.drop_stored(e, seed, score, settle_=False)
    return out


def _flow(e: DataFrame, score: DataFrame, n_links: int, travels: int) -> DataFrame:
    """Each link's share of its source's score."""
    share = score.where("n > 0").select("way", "src", "n", F.expr(f"score * {travels} div (100 * n)").alias("part"))
    return lookup(e, share, ["way", "src"], "n", n_links).select("way", F.col("dst").alias("src"), "part")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], share: float = 0.5, travels: int = TRAVELS, rounds: int = ROUNDS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page, with its host's ``trust`` and ``distrust`` in millionths of a page."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.withColumn("hit", fitting_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "hit.rule", "hit.action")
    p = U.stored(p, "judged")
    by = lambda a: (F.count_if(F.col("action") == a) * UNIT).alias({"allow": "trust", "block": "distrust"}[a])
    hosts = U.stored(p.groupBy("host").agg(F.count("*").alias("n"), by("allow"), by("block")), "hosts")
    links = host_links(pages)
    scores = spread(links, hosts.where("host <> ''").select("host", "trust", "distrust"), travels, rounds)
    known = hosts.select("host", "n").join(scores, "host", "left").select(
        "host", "n", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("trust", "distrust"))
    )
    known = known.withColumn("method", F.when(F.col("distrust") - F.col("trust") > (F.col("n") * int(share * UNIT)), "block").otherwise("allow"))
    out = lookup(p, known, ["host"], "n", p.count()).select("page_id", "host", "path", "rule", F.coalesce("action", "method").alias("verdict"), "trust", "distrust")
    done = U.stored(out, "verdicts")
    U.drop_stored(p, hosts, scores, settle_=False)
    return done
