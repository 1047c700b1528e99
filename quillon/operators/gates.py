"""Path classes, gates, lenses and their consensus, promotion rules, and checks of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import clamp01, noisy_or

#: The folder in which a tool keeps its own state, and the files there that count as documents; parameters of every gate.
STATE_FOLDER = ".ledger/"
STATE_FILES = ("state.md", "decisions.md")
# Path rules, in the order in which they are tried.
INTERNAL = r"(?i:(^|/)(agents|claude|gemini)\.md$)"
DOCS = r"\.md$"
TESTS = r"(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*\.py$|\.(test|spec)\.[a-z]+$"
CONFIGS = r"\.(ya?ml|toml|json|ini)$|(^|/)(Dockerfile|Makefile)$"
CODE = r"\.(js|ts|py|go|rs|java|c|cpp|rb|sh)$"
# Lens weight, family, and whether it may block alone.
LENSES = {
    "tests": (0.8, "outcome", True),
    "symbols": (0.4, "structural", False),
    "impact": (0.35, "structural", False),
    "docsdrift": (0.3, "structural", False),
    "secrets": (0.9, "security", True),
    "speclock": (0.4, "structural", False),
    "reviewer": (0.3, "model", False),
}
BLOCK_AT = 0.5
# The completeness logistic and its ask limit.
COMPLETENESS = {"bias": -0.858, "concreteness": 1.44, "specifics": 0.5, "vagueness": -1.3, "length": 0.6}
ASK_BELOW = 0.6
BLAST = 25


def path_class(path: Column, folder: str = STATE_FOLDER) -> Column:
    p = F.regexp_replace(path, r"\\", "/")
    return (
        F.when(p.isin(*(folder + f for f in STATE_FILES)), "docs").when(p.startswith(folder) | p.rlike(INTERNAL), "internal").when(p.rlike(DOCS), "docs").when(p.rlike(TESTS), "test").when(p.rlike(CONFIGS), "config").when(p.rlike(CODE), "code").otherwise("other")
    )


def stop_gate(changed: DataFrame, by: str, path: str, verified: str, state_touched: str, folder: str = STATE_FOLDER) -> DataFrame:
    """``by, allow, row``: the first row of the ordered decision table that holds for the changed paths of each group."""
    c = changed.withColumn("_c", path_class(F.col(path), folder))
    n = {k: F.count_if(F.col("_c") == k).alias(k) for k in ("code", "test", "config", "docs", "internal")}
    g = c.groupBy(by).agg(*n.values(), F.count(path).alias("all"), F.bool_or(verified).alias("verified"), F.bool_or(state_touched).alias("state"))
    tested = F.col("verified") | (F.col("test") > 0)
    documented = (F.col("docs") > 0) | F.col("state")
    row = (
        F.when((F.col("all") == F.col("internal")) & ~F.col("state"), "no-changes")
        .when((F.col("code") > 0) & ~tested, "code-without-test-evidence")
        .when((F.col("code") > 0) & ~documented, "code-without-docs")
        .when(F.col("code") > 0, "code-with-evidence")
        .when((F.col("test") > 0) & (F.col("config") == 0), "test-only")
        .when((F.col("config") > 0) & ~documented, "config-without-docs")
        .when(documented, "docs-touched")
        .otherwise("no-code-class")
    )
    return g.withColumn("row", row).select(by, (~F.col("row").isin("code-without-test-evidence", "code-without-docs", "config-without-docs")).alias("allow"), "row")


def commit_gate(staged: DataFrame, by: str, path: str, secret: str, mode: str = "warn", folder: str = STATE_FOLDER) -> DataFrame:
    """``by, row``: blocked by a secret in any mode but off, and in mode block by code without docs; warned or clean otherwise."""
    c = path_class(F.col(path), folder)
    g = staged.groupBy(by).agg(F.bool_or(secret).alias("secret"), ((F.count_if(c == "code") > 0) & (F.count_if(c == "docs") == 0)).alias("bare"))
    blocked = F.col("secret") | (F.col("bare") & F.lit(mode == "block"))
    row = F.when(F.lit(mode == "off"), "kill-switch").when(blocked, "blocked").when(F.col("bare"), "warned").otherwise("clean")
    return g.select(by, row.alias("row"))


def enforced(underspecified: Column, context_ok: Column, questions: Column, fresh: Column, blast: Column) -> Column:
    """Why an enforcing gate blocks, or null."""
    return F.when(underspecified, "underspecified").when(~context_ok & (questions > 0), "context").when(F.coalesce(fresh, F.lit(True)) & (blast >= BLAST), "blast")


def consensus(events: DataFrame, by: str) -> DataFrame:
    """``by, p, families, residual, status``: noisy-or of the firing lenses, and what the lenses that ran leave unchecked.

    Needs ``lens, ran, s``; unknown lenses are ignored.  A block needs two families or a lens that may block alone.
    """
    table = F.create_map(*[x for k, (w, fam, solo) in LENSES.items() for x in (F.lit(k), F.struct(F.lit(w).alias("w"), F.lit(fam).alias("fam"), F.lit(solo).alias("solo")))])
    e = events.where(F.col("lens").isin(*LENSES) & F.coalesce("ran", F.lit(True))).withColumn("_l", table[F.col("lens")]).withColumn("_s", clamp01(F.coalesce("s", F.lit(0.0))))
    firing = F.col("_s") > 0
    bits = F.create_map(*[x for i, fam in enumerate(sorted({fam for _, fam, _ in LENSES.values()})) for x in (F.lit(fam), F.lit(1 << i))])
    g = e.groupBy(by).agg(
        noisy_or(F.col("_l.w") * F.col("_s")).alias("p"),
        F.bit_count(F.coalesce(F.bit_or(F.when(firing, F.element_at(bits, F.col("_l.fam")))), F.lit(0))).cast("long").alias("families"),  # a count of distinct ones would group each change's rows twice
        F.product(1 - F.col("_l.w")).alias("residual"),
        F.bool_or(firing & F.col("_l.solo")).alias("_solo"),
    )
    fires = (F.col("families") >= 2) | F.col("_solo")
    return g.select(by, "p", "families", "residual", F.when(fires & (F.col("p") >= BLOCK_AT), "block").when(F.col("p") > 0, "advise").otherwise("pass").alias("status"))


def lens_row(lens: str, ran: Column, s: Column) -> Column:
    """A lens that did not run abstains with strength 0."""
    return F.struct(F.lit(lens).alias("lens"), F.coalesce(ran, F.lit(False)).alias("ran"), F.when(F.coalesce(ran, F.lit(False)), clamp01(s)).otherwise(0.0).alias("s"))


def mistake_class(p: Column, fires: Column) -> Column:
    return F.when(fires & (p >= 0.7), "distill").when(p >= 0.4, "accumulate").otherwise("discard")


def completeness(features: dict[str, Column]) -> Column:
    z = F.lit(COMPLETENESS["bias"])
    for name, x in features.items():
        z = z + COMPLETENESS[name] * x
    return 1 / (1 + F.exp(-z))


def length_signal(words: Column) -> Column:
    return F.tanh((words - 12) / 12)


def must_ask(score: Column, concrete: Column, words: Column, vague: Column, specific: Column) -> Column:
    return (score < ASK_BELOW) | ((concrete == 0) & ((words <= 10) | ((vague >= 1) & (specific == 0))))


def edit_features(callers: Column, churn: Column, tested: Column, signature: Column, callers_updated: Column) -> Column:
    """The clamped features of an edit that the risk heuristic takes."""
    return F.struct(
        clamp01(callers / 10).alias("caller_fanout"), clamp01(churn / 10).alias("churn"), F.when(tested, 0.0).otherwise(1.0).alias("test_coverage_gap"),
        F.when(signature, 1.0).otherwise(0.0).alias("signature_change"), F.when(signature & ~callers_updated, 1.0).otherwise(0.0).alias("no_caller_update"),
    )


def promoted(n: Column, baseline: Column, candidate: Column, margin: float = 0.02, least: int = 20, lower: bool = True) -> Column:
    """``candidate`` where there are enough samples and it beats the baseline by the margin."""
    beats = candidate <= baseline - margin if lower else candidate >= baseline + margin
    return F.when((n >= least) & F.coalesce(beats, F.lit(False)), "candidate").otherwise("baseline")


def kill_criteria(n: Column, heuristic: Column, learned: Column, least: int = 20, floor: float = 0.6, margin: float = 0.05) -> Column:
    return F.when(n < least, "heuristic").when(heuristic < floor, "disabled").when(learned >= heuristic + margin, "learned").otherwise("heuristic")


def all_ok(checks: DataFrame, by: str, ok: str) -> DataFrame:
    return checks.groupBy(by).agg(F.coalesce(F.bool_and(F.coalesce(F.col(ok), F.lit(False))), F.lit(False)).alias("ok"))


def roll_up(issues: DataFrame, by: str, severity: str) -> DataFrame:
    """``by, errors, warnings, ok``: sound unless an issue is an error."""
    errors = F.count_if(F.col(severity) == "error")
    return issues.groupBy(by).agg(errors.alias("errors"), F.count_if(F.col(severity) == "warning").alias("warnings"), (errors == 0).alias("ok"))


def first_distinct(rows: DataFrame, by: str, order: str, keys: list[str], limit: int = 5) -> DataFrame:
    """The first ``limit`` distinct ``keys`` of each group, in order of first appearance."""
    seen = rows.groupBy(by, *keys).agg(F.min(order).alias("_at"))
    return seen.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("_at", *keys))).where(F.col("rank") <= limit).drop("_at")


def latest(log: DataFrame, order: str, limit: int) -> DataFrame:
    """The last rows of a log, and the number that the next one gets."""
    top = log.agg((F.max(order) + 1).alias("next_id"))  # one row
    return log.orderBy(F.desc(order)).limit(limit).join(F.broadcast(top))


def confusion(rows: DataFrame, truth: str, said: str, cost: str, premium: str) -> DataFrame:
    """One row: the confusion counts, and the share of the premium cost that was saved."""
    t, s = F.col(truth), F.col(said)
    return rows.agg(
        F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"), F.count_if(~t & ~s).alias("tn"), (1 - F.sum(cost) / F.sum(premium)).alias("saved"),
    )


def size_risk(lines: Column, files: Column) -> Column:
    """Band of a file set: any file over 800 lines or many files cost much to change."""
    return F.when((lines > 800) | (files > 50), "high").when((lines > 300) | (files > 15), "medium").otherwise("low")


def reconciled(documented: DataFrame, implemented: DataFrame, key: str) -> DataFrame:
    """``key, state``: in both, only documented (phantom) or only implemented (undocumented)."""
    a = documented.select(key).distinct().withColumn("_a", F.lit(True))
    b = implemented.select(key).distinct().withColumn("_b", F.lit(True))
    state = F.when(F.col("_a").isNull(), "undocumented").when(F.col("_b").isNull(), "phantom").otherwise("ok")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def stale(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, change``: what was added, removed or changed between two inventories."""
    both = before.select(key, F.col(digest).alias("_x")).join(after.select(key, F.col(digest).alias("_y")), key, "full_outer")
    change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(F.col("_x") != F.col("_y"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def formatting_only(added: Column, removed: Column) -> Column:
    """Whether two blocks of text differ in white space and trailing commas at most."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r",([)\]}])", "$1")
    return (bare(added) == bare(removed)) & (bare(added) != "")


def slug(heading: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(heading)), r"[^a-z0-9 _-]", ""), " ", "-")


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def quoted_names(text: Column) -> Column:
    """Distinct identifiers between backticks."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"`([A-Za-z_][A-Za-z0-9_]*)(?:\(\))?`"), F.lit(1)))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars at prices for a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6
