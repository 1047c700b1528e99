"""Style fingerprints from text: custom properties are put in first, then colours, lengths, fonts and shadows are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour, scores

# Hue and saturation of the utility classes' colour families, and what their other classes stand for.
FAMILIES = {
    "red": (0, 84), "orange": (25, 95), "amber": (38, 92), "yellow": (45, 93), "lime": (84, 81), "green": (142, 71), "emerald": (160, 84), "teal": (173, 80), "cyan": (189, 94), "sky": (199, 89), "blue": (217, 91),
    "indigo": (239, 84), "violet": (258, 90), "purple": (271, 91), "fuchsia": (292, 84), "pink": (330, 81), "rose": (350, 89), "slate": (215, 5), "gray": (220, 5), "zinc": (240, 4), "neutral": (0, 0), "stone": (25, 5),
}
ROUNDED = {"": 4, "none": 0, "sm": 2, "md": 6, "lg": 8, "xl": 12, "2xl": 16, "3xl": 24, "full": 9999}
FONTS = {"sans": "sans-serif", "serif": "serif", "mono": "monospace"}
#: Passes over the declarations, then over the text; cycles keep their ``var(`` and are seen by nothing.
DECLARATION_PASSES, TEXT_PASSES = 4, 3
#: Below this saturation a colour has no hue of its own; radii from here on are all the same pill.
NEUTRAL, PILL = 10, 999
_USE = r"var\(\s*(--[\w-]+)\s*(?:,\s*([^()]*(?:\([^()]*\)[^()]*)*))?\s*\)"
_DECLARED = r"(--[\w-]+)\s*:\s*([^;}]+)"
_STRIPPED = r"^\s+|\s+$"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _property(text: Column, name: str) -> Column:
    """Values of a property; one that is only the end of a longer name does not count."""
    return _all(text, rf"""(?i)(?:^|[;{{\s"'])(?:{name})\s*:\s*([^;}}]+)""")


def substituted(text: Column, names: Column, values: Column) -> Column:
    """``text`` with each use of a custom property replaced: by its value, else by the use's fallback, else not at all."""

    def joined(lits: Column) -> Column:
        uses = F.arrays_zip(_all(text, _USE, 0).alias("whole"), _all(text, _USE, 1).alias("name"), _all(text, _USE, 2).alias("other"))

        def said(u: Column) -> Column:
            at = F.array_position(names, u["name"]).cast("int")
            other = F.when(u["whole"].rlike(r"^var\(\s*--[\w-]+\s*,"), F.regexp_replace(u["other"], _STRIPPED, "")).otherwise(u["whole"])
            return F.when(at > 0, F.get(values, at - 1)).otherwise(other)

        return F.array_join(F.concat(F.transform(F.zip_with(F.slice(lits, 1, F.size(lits) - 1), uses, lambda a, u: F.concat(a, said(u))), lambda x: x), F.slice(lits, -1, 1)), "")

    return F.when(F.contains(text, F.lit("var(")), scores.once(F.split(text, _USE), joined)).otherwise(text)


def resolved(df: DataFrame, css: str) -> DataFrame:
    """``df`` with all uses of custom properties in column ``css`` replaced, in a bounded number of passes; the last declaration of a name counts."""
    found = df.withColumns({"_n": _all(F.col(css), _DECLARED, 1), "_v": F.transform(_all(F.col(css), _DECLARED, 2), lambda v: F.regexp_replace(v, _STRIPPED, ""))})
    found = found.withColumns({"_n": F.reverse("_n"), "_v": F.reverse("_v")})  # the first match is then the last declaration
    for _ in range(DECLARATION_PASSES):
        found = found.withColumn("_v", F.transform("_v", lambda v: substituted(v, F.col("_n"), F.col("_v"))))
    for _ in range(TEXT_PASSES):
        found = found.withColumn(css, substituted(F.col(css), F.col("_n"), F.col("_v")))
    return found.drop("_n", "_v")


def colours(text: Column) -> Column:
    """All colours of a text as ``h, s, l``: hex, rgb, hsl and utility classes; an alpha channel is left out."""

    def of_hex(x: Column) -> Column:
        full = F.when(F.length(x) <= 4, F.regexp_replace(F.substring(x, 1, 3), "(.)", "$1$1")).otherwise(F.substring(x, 1, 6))
        return colour.hsl(*[F.conv(F.substring(full, i, 2), 16, 10).cast("int") for i in (1, 3, 5)])

    def triple(pattern: str, make) -> Column:
        z = F.arrays_zip(*[_all(text, pattern, i).cast("array<double>").alias(c) for i, c in enumerate("abc", 1)])
        return F.transform(z, lambda t: make(t["a"], t["b"], t["c"]))

    half_up = lambda x: F.floor(x + 0.5)
    struct = lambda h, s, l: F.struct(h.cast("long").alias("h"), s.cast("long").alias("s"), l.cast("long").alias("l"))
    sides = "bg|text|border|from|via|to|ring|outline|fill|stroke|accent|caret|decoration|divide|shadow"
    shades = "50|100|200|300|400|500|600|700|800|900|950"
    classed = rf"\b(?:{sides})-({'|'.join(FAMILIES)})-({shades})\b"
    hue, sat = (F.create_map(*[F.lit(v) for k, x in FAMILIES.items() for v in (k, x[i])]) for i in (0, 1))
    light = lambda shade: F.least(F.lit(96), F.greatest(F.lit(4), half_up(100 - shade.cast("double") / 10)))
    tinted = F.zip_with(_all(text, classed, 1), _all(text, classed, 2), lambda f, shade: struct(F.element_at(hue, f), F.element_at(sat, f), light(shade)))
    plain = F.transform(_all(text, r"\b(?:bg|text|border|from|via|to|ring|fill|stroke)-(white|black)\b"), lambda w: struct(F.lit(0), F.lit(0), F.when(w == "white", 100).otherwise(0)))
    return F.concat(
        F.transform(_all(text, r"(?i)#([0-9a-f]{8}|[0-9a-f]{6}|[0-9a-f]{4}|[0-9a-f]{3})\b"), of_hex),
        triple(r"(?i)rgba?\(\s*(\d{1,3})[,\s]+(\d{1,3})[,\s]+(\d{1,3})", colour.hsl),
        triple(r"(?i)hsla?\(\s*([\d.]+)(?:deg)?[,\s]+([\d.]+)%[,\s]+([\d.]+)%", lambda h, s, l: struct(half_up(h) % 360, half_up(s), half_up(l))),
        tinted, plain,
    )


def lengths(values: Column) -> Column:
    """Absolute lengths in px in an array of values, at 16 px an em; zero is none."""
    pattern = r"(-?\d*\.?\d+)(px|rem|em)\b"
    px = lambda v: F.zip_with(_all(v, pattern, 1), _all(v, pattern, 2), lambda n, u: F.floor(F.abs(n.cast("double")) * F.when(u == "px", 1).otherwise(16) * 100 + 0.5) / 100)
    return F.filter(F.flatten(F.transform(values, px)), lambda x: x > 0)


def fingerprints(df: DataFrame, key: str, css: str) -> DataFrame:
    """``key`` and the fingerprint of each text: ``hues, palette, spacing, base, on_scale, fonts, radii, radius_levels, shadow_levels``, and ``colours`` and ``hue_buckets``.

    Null texts exhibit nothing.  Rows with the same key are fingerprints of their own.
    """
    t = F.col("_t")
    d = resolved(df.select(key, F.coalesce(css, F.lit("")).alias("_t")), "_t")
    steps = F.transform(_all(t, r"(?<![\w-])-?(?:[pm][trblxyse]?|gap(?:-[xy])?|space-[xy])-(\d+(?:\.\d+)?|px)(?![\w-])"), lambda n: F.when(n == "px", 1.0).otherwise(n.try_cast("double") * 4))
    rounded = F.create_map(*[F.lit(v) for k, x in ROUNDED.items() for v in (k, float(x))])
    corner = r"(?<![\w-])rounded(?:-(?:ss|se|ee|es|tl|tr|br|bl|t|r|b|l|s|e))?(?:-(none|sm|md|lg|xl|2xl|3xl|full))?(?![\w-])"
    face = lambda v: F.lower(F.regexp_replace(F.regexp_replace(F.get(F.split(v, ","), F.lit(0)), _STRIPPED, ""), r"""^["']|["']$""", ""))
    fonts = F.create_map(*[F.lit(v) for kv in FONTS.items() for v in kv])
    cast_shadow = F.filter(F.transform(_property(t, "box-shadow"), lambda v: F.regexp_replace(F.regexp_replace(v, _STRIPPED, ""), r"\s+", " ")), lambda v: v != "none")
    classed = F.filter(F.transform(_all(t, r"(?<![\w-])shadow(?:-(sm|md|lg|xl|2xl|inner|none))?(?![\w-])"), lambda s: F.concat(F.lit("class:"), s)), lambda s: s != "class:none")
    radius = r"border(?:-(?:top|bottom|start|end)-(?:left|right)?)?-radius"
    d = d.withColumns({
        "colours": F.array_sort(F.array_distinct(colours(t))),
        "spacing": F.array_sort(F.array_distinct(F.concat(lengths(_property(t, r"(?:margin|padding)(?:-[a-z-]+)?")), lengths(_property(t, "(?:row-gap|column-gap|gap)")), F.filter(steps, lambda s: s > 0)))),
        "fonts": F.array_sort(F.array_distinct(F.concat(F.filter(F.transform(_property(t, "font-family"), face), lambda f: (f != "") & ~F.contains(f, F.lit("("))), F.transform(_all(t, r"(?<![\w-])font-(sans|serif|mono)(?![\w-])"), lambda k: F.element_at(fonts, k))))),
        "radii": F.array_sort(F.array_distinct(F.concat(F.transform(lengths(_property(t, radius)), lambda r: F.when(r >= PILL, 9999.0).otherwise(r)), F.filter(F.transform(_all(t, corner), lambda s: F.element_at(rounded, s)), lambda r: r > 0)))),
        "shadow_levels": F.size(F.array_distinct(F.concat(cast_shadow, classed))),
    })
    chromatic = F.filter("colours", lambda c: c["s"] >= NEUTRAL)
    d = d.withColumns({"hues": F.transform(chromatic, lambda c: c["h"].cast("double")), "palette": F.size("colours"), "base": scores.spacing_base(F.col("spacing")).cast("double"), "radius_levels": F.size("radii")})
    d = d.withColumn("on_scale", scores.on_scale(F.col("spacing"), F.col("base")))
    buckets = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda b: F.size(F.filter("hues", lambda h: F.floor(h / 30) == b)))
    return d.select(key, "colours", "hues", buckets.alias("hue_buckets"), "palette", "spacing", "base", "on_scale", "fonts", "radii", "radius_levels", "shadow_levels")
