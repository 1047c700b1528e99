"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def noisy_or(p: Column) -> Column:
    """Aggregate 1 - prod(1 - p): at least one of several independent causes."""
    return 1 - F.product(1 - p)


def once(value: Column, f) -> Column:
    """``f(value)`` with the value worked out a single time, though ``f`` uses it in inner lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def cosine(a: str, b: str) -> Column:
    """Cosine of two arrays over their common length; 0 for a zero vector."""
    pairs = F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y"))

    def total(f):
        return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.coalesce(f(p["x"].cast("double"), p["y"].cast("double")), F.lit(0.0)))

    norm = F.sqrt(total(lambda x, y: x * x)) * F.sqrt(total(lambda x, y: y * y))
    return F.when(norm == 0, 0.0).otherwise(total(lambda x, y: x * y) / norm)


def set_overlap(a: Column, b: Column) -> Column:
    """Common elements over the smaller set's size; 0 when either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least <= 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def shingles(text: Column, n: int = 4) -> Column:
    """Distinct n-token shingles of lower-cased alphanumeric tokens; a shorter text is one shingle."""

    def of(tokens: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(tokens, i, n)))
        return F.when(F.size(tokens) >= n, many).when(F.size(tokens) > 0, F.array(F.concat_ws(" ", tokens))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(once(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""), of))


def band(score: Column, cuts: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """Name of the band that a score falls into: names[i] below cuts[i], the last name otherwise."""
    out = F.lit(names[-1])
    for cut, name in sorted(zip(cuts, names), reverse=True):
        out = F.when(score < cut, name).otherwise(out)
    return out


def _off_base(s: Column, u: int) -> Column:
    return F.abs(s - F.floor(s / u + 0.5) * u)


def spacing_base(values: Column, bases: tuple[int, ...] = (2, 4, 8)) -> Column:
    """Largest base that the values miss by at most half a unit each on average, else the one they miss least; null without values."""

    def total(u: int) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, s: acc + _off_base(s, u))

    missed = {u: total(u) for u in bases}
    good = F.coalesce(*[F.when(missed[u] <= 0.5 * F.size(values), u) for u in sorted(bases, reverse=True)])
    least = F.least(*missed.values())
    return F.when(F.size(values) > 0, F.coalesce(good, *[F.when(missed[u] == least, u) for u in bases]))


def on_scale(values: Column, base: Column, slack: float = 0.5) -> Column:
    """Share of values within ``slack`` of a multiple of the base; 1 without values or base."""
    near = F.size(F.filter(values, lambda s: F.abs(s - F.floor(s / base + 0.5) * base) <= slack))
    return F.when((F.size(values) <= 0) | base.isNull() | (base == 0), 1.0).otherwise(near / F.size(values))


def checkpoint_cadence(p_err: Column, tokens: Column, cost: Column, check_cost: Column, most: int = 50) -> Column:
    """Steps between checks, 1 to ``most``: no risk gives ``most``, missing or undefined figures give 1."""
    risk = p_err * tokens * cost
    n = F.ceil(check_cost / F.when(risk != 0, risk))
    bad = F.isnan(risk.cast("double")) | risk.isNull() | check_cost.isNull() | ((risk == 0) & (check_cost == 0))
    return F.when(bad, 1).when(risk == 0, most).otherwise(F.least(F.greatest(n, F.lit(1)), F.lit(most))).cast("long")


def change_scale(lines: Column) -> Column:
    """Factor by which a change of so many lines (1 at least) raises its signals, up to 1.22."""
    return 1 + 0.22 * F.least(F.lit(1.0), F.log2(1 + F.greatest(F.lit(1), F.coalesce(lines, F.lit(1)))) / 8)


#: Share of each dimension in the mean signal.
SIGNAL_WEIGHTS = {"runtime": 0.22, "contract": 0.2, "verification": 0.18, "docs": 0.1, "config": 0.12, "delivery": 0.12, "merge": 0.06}


def overall(signal: dict[str, Column], criticality: Column) -> Column:
    """Seven parts the peak and three the weighted mean of the signals, raised by the artifact's criticality."""
    given = {k: clamp01(signal[k]) if k in signal else F.lit(0.0) for k in SIGNAL_WEIGHTS}
    base = clamp01(0.7 * F.greatest(*given.values()) + 0.3 * sum((given[k] * w for k, w in SIGNAL_WEIGHTS.items()), F.lit(0.0)))
    return clamp01(1 - (1 - base) * (1 - clamp01(0.28 * clamp01(criticality) * base)))


#: Share of the work that a hit of each tier saves.
TIER_SHARE = {"exact": 1.0, "near": 0.85, "adapt": 0.5}


def saved_estimate(chars: Column, tier: Column) -> Column:
    """Tokens that a hit avoids: characters / 3.6 by the tier's share, halves rounded up."""
    share = F.when(tier == "exact", 1.0).when(tier == "near", TIER_SHARE["near"]).otherwise(TIER_SHARE["adapt"])
    return F.floor(chars / 3.6 * share + 0.5)


def char_bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, lower-cased; a single character stands for itself."""

    def of(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) == 1, F.array(t)).otherwise(F.array_distinct(pairs))

    return once(F.lower(F.coalesce(text, F.lit(""))), of)
