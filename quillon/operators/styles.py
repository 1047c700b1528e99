"""Style fingerprints: distance from stock templates, conformance with a project, and the gate on both.

A fingerprint is a row ``hues array<double>, palette int, spacing array<double>, base double,
fonts array<string>, radii array<double>, radius_levels int, shadow_levels int``; ``hues`` are
the chromatic ones, ``palette`` counts all colours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import once

# Hues, spacing base, steps, fonts, radii, radius levels and shadow levels of the stock templates.
TEMPLATES = {
    "tailwind-default": ((217, 239), 8, 3, 1, (12,), 1, 1),
    "bootstrap-default": ((216,), 8, 4, 1, (6,), 1, 1),
    "ai-landing-gradient": ((258, 271), 8, 3, 1, (16,), 1, 2),
}
SLOP_BELOW, CONFORM_UPTO = 0.25, 0.5


def hue_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 360
    return F.least(d, 360 - d)


def _nearest(x: Column, others: Column) -> Column:
    return F.array_min(F.transform(others, lambda z: hue_distance(x, z)))


def _mean(xs: Column, f) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x)) / F.size(xs)


def _part(d: Column, present: Column) -> Column:
    return F.when(present, F.round(d, 3))


def _share(parts: list[Column]) -> Column:
    """Mean of the parts that are there, rounded; null without any."""
    there = F.array_compact(F.array(*parts))
    return F.round(F.aggregate(there, F.lit(0.0), lambda acc, x: acc + x) / F.when(F.size(there) > 0, F.size(there)), 3)


def template_parts(name: str) -> dict[str, Column]:
    """Distance of each exhibited feature from a stock template."""
    hues, base, steps, fonts, radii, levels, shadows = TEMPLATES[name]
    col = F.col
    wanted = F.array(*[F.lit(float(h)) for h in hues])
    palette = F.when(F.size("hues") > 0, _mean(col("hues"), lambda h: _nearest(h, wanted)) / 180).otherwise(1.0)
    spacing = (F.when(col("base") == base, 0.0).otherwise(1.0) + F.least(F.lit(1.0), F.abs(F.size("spacing") - steps) / 8)) / 2
    near = F.array_min(F.transform("radii", lambda r: F.least(F.lit(1.0), *[F.abs(r - z) / 16 for z in radii])))
    shape = (near + F.least(F.lit(1.0), F.abs(col("radius_levels") - levels) / 3)) / 2
    parts = {
        "palette": _part(palette, col("palette") > 0),
        "spacing": _part(spacing, F.size("spacing") > 0),
        "type": _part(F.least(F.lit(1.0), F.abs(F.size("fonts") - fonts) / 2), F.size("fonts") > 0),
        "shape": _part(shape, F.size("radii") > 0),
    }
    shown = F.coalesce(*parts.values()).isNotNull() | (col("shadow_levels") > 0)
    return parts | {"elevation": _part(F.least(F.lit(1.0), F.abs(col("shadow_levels") - shadows) / 3), shown)}


def nearest_template() -> Column:
    """``distance, name`` of the nearest stock template, the first of equal ones; null without any feature."""
    found = [F.struct(_share(list(template_parts(n).values())).alias("distance"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(TEMPLATES)]
    return F.get(F.array_sort(F.filter(F.array(*found), lambda x: x["distance"].isNotNull())), 0)


def slop_distance() -> Column:
    return F.coalesce(nearest_template()["distance"], F.lit(1.0))


def _apart(a: Column, b: Column) -> Column:
    """1 - Jaccard of two arrays as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def _on_scale(values: Column, base: Column) -> Column:
    """Share of the values within half a unit of a multiple of the base."""
    return F.size(F.filter(values, lambda v: F.abs(v - F.floor(v / base + 0.5) * base) <= 0.5)) / F.size(values)


def conformance(own: str, project: str) -> Column:
    """How far the fingerprint struct ``own`` is from ``project``: the mean over what either exhibits."""
    a, b = (lambda f: F.col(f"{own}.{f}")), (lambda f: F.col(f"{project}.{f}"))
    both = (_mean(a("hues"), lambda h: _nearest(h, b("hues"))) + _mean(b("hues"), lambda h: _nearest(h, a("hues")))) / 2 / 180
    none_a, none_b = F.size(a("hues")) == 0, F.size(b("hues")) == 0
    palette = F.when(none_a & none_b, 0.0).when(none_a | none_b, 1.0).otherwise(both)
    base = lambda x: F.when(F.coalesce(x, F.lit(0)) == 0, 1.0).otherwise(x)
    spacing = (F.least(F.lit(1.0), F.abs(F.log2(base(a("base")) / base(b("base")))) / 2) + 1 - _on_scale(a("spacing"), base(b("base")))) / 2
    levels = F.least(F.lit(1.0), F.abs(a("radius_levels") - b("radius_levels")) / 3)
    return _share([
        _part(palette, (a("palette") > 0) | (b("palette") > 0)),
        _part(spacing, (F.size(a("spacing")) > 0) & (F.size(b("spacing")) > 0)),
        _part(_apart(a("fonts"), b("fonts")), (F.size(a("fonts")) > 0) | (F.size(b("fonts")) > 0)),
        _part((_apart(a("radii"), b("radii")) + levels) / 2, (F.size(a("radii")) > 0) | (F.size(b("radii")) > 0)),
        F.round(F.least(F.lit(1.0), F.abs(a("shadow_levels") - b("shadow_levels")) / 3), 3),
    ])


def gate(slop: Column, conform: Column) -> Column:
    """Why a style does not pass, or null: too near a stock template, or too far from the project."""
    return F.when(slop < SLOP_BELOW, "slop").when(conform > CONFORM_UPTO, "conform")


def latest_live(fingerprints: DataFrame, by: str, t: str, retired: str, name: str) -> DataFrame:
    return fingerprints.where(~F.coalesce(F.col(retired), F.lit(False))).groupBy(by).agg(F.max_by(name, F.struct(t, name)).alias(name))


# What leaves a request open.
OPEN_WORDS = (r"\bsome(how|thing)?\b", r"\betc\.?\b", r"\band so on\b", r"\bas needed\b", r"\bappropriate(ly)?\b", r"\bproper(ly)?\b", r"\ba few\b", r"\bseveral\b", r"\bmake it work\b", r"\bhandle (the )?errors?\b", r"\bvarious\b", r"\band more\b")


def open_words(text: Column) -> Column:
    """Distinct first hits of each pattern that leaves a request open, lower-cased, in the patterns' order."""
    hits = F.array(*[F.lower(F.trim(F.regexp_extract(text, f"(?i)({p})", 1))) for p in OPEN_WORDS])
    return F.array_distinct(F.filter(hits, lambda h: h != ""))


def named_files(text: Column) -> Column:
    """Distinct path-like words: with a slash, or with a code file's ending."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z_$][\w$./-]*)"), F.lit(1))
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"[.,;:]+$", ""))
    return once(bare, lambda b: F.array_distinct(F.filter(b, lambda w: w.contains("/") | w.rlike(r"\.(js|ts|py|go|rs|java|json|md|sh|css|html)$"))))


def lesson_state(events: Column, half_life: int = 45) -> Column:
    """``status, confirmed, contradicted, reconfirms, last_day`` after (day, confirm) events in order.

    A quarantined lesson comes back after two confirmations and is retired by a contradiction;
    an active one is quarantined when a contradiction takes its confidence below .3.
    """
    start = F.struct(F.lit("candidate").alias("status"), F.lit(0).alias("confirmed"), F.lit(0).alias("contradicted"), F.lit(0).alias("reconfirms"), F.lit(0).alias("last_day"))

    def step(s: Column, e: Column) -> Column:
        held = s["status"] == "quarantined"
        back = held & (s["reconfirms"] + 1 >= 2)
        confidence = F.pow(F.lit(0.5), F.greatest(F.lit(0), e["day"] - s["last_day"]) / half_life) * (1 + s["confirmed"]) / (3 + s["confirmed"] + s["contradicted"])
        up = F.struct(F.when(held & ~back, "quarantined").otherwise("active").alias("status"), (s["confirmed"] + 1).alias("confirmed"), s["contradicted"].alias("contradicted"), F.when(held & ~back, s["reconfirms"] + 1).otherwise(0).alias("reconfirms"), e["day"].alias("last_day"))
        down = F.struct(F.when(held, "retired").when(confidence < 0.3, "quarantined").otherwise(s["status"]).alias("status"), s["confirmed"].alias("confirmed"), (s["contradicted"] + 1).alias("contradicted"), s["reconfirms"].alias("reconfirms"), s["last_day"].alias("last_day"))
        return F.when(s["status"] == "retired", s).when(e["confirm"], up).otherwise(down)

    return F.aggregate(events, start, step)


# What a deliberate system keeps to: share of spacing on the scale, levels of radius and shadow, colours.
ON_SCALE_AT_LEAST, RADIUS_LEVELS, SHADOW_LEVELS, PALETTE = 0.9, 3, 3, 8


def scale_checks(prints: DataFrame, key: str, base: Column | None = None, slack: float = 0.5) -> DataFrame:
    """``key, id, pass, found, off``: one row for each rule of a fingerprint; ``found`` is the measured figure, ``off`` the spacing values that a base does not divide.

    ``base`` is the declared spacing base, else the inferred one.  A feature that is not there passes.
    """
    base = F.col("base") if base is None else F.coalesce(base, F.col("base"))
    off = F.when(base.isNull() | (base == 0), F.array().cast("array<double>")).otherwise(F.filter("spacing", lambda v: F.abs(v - F.floor(v / base + 0.5) * base) > slack))
    share = F.when(F.size("spacing") > 0, 1 - F.size(off) / F.size("spacing")).otherwise(1.0)
    none = F.array().cast("array<double>")
    row = lambda name, found, ok, rest=none: F.struct(F.lit(name).alias("id"), ok.alias("pass"), found.cast("double").alias("found"), rest.alias("off"))
    most = lambda name, c, limit: row(name, F.col(c), F.col(c) <= limit)
    rules = F.array(row("spacing-scale", share, share >= ON_SCALE_AT_LEAST, off), most("radius-levels", "radius_levels", RADIUS_LEVELS), most("shadow-levels", "shadow_levels", SHADOW_LEVELS), most("palette-size", "palette", PALETTE))
    return prints.select(key, F.explode(rules).alias("r")).select(key, "r.*")
