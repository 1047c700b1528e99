"""Contrast of colours."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _linear(c: Column) -> Column:
    s = c / 255
    return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, 2.4))


def luminance(hex6: Column) -> Column:
    """Relative luminance of "#rrggbb" or "rrggbb"."""
    bare = F.regexp_replace(hex6, "^#", "")
    r, g, b = (_linear(F.conv(F.substring(bare, i, 2), 16, 10).cast("double")) for i in (1, 3, 5))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def contrast_level(ratio: Column, large: bool = False) -> Column:
    aa, aaa = (3, 4.5) if large else (4.5, 7)
    return F.when(ratio >= aaa, "AAA").when(ratio >= aa, "AA").otherwise("fail")


def hsl(r: Column, g: Column, b: Column) -> Column:
    """Struct ``h`` (0-359), ``s``, ``l`` (0-100) of 8-bit channels, halves rounded up."""
    r, g, b = r / 255, g / 255, b / 255
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2
    hue = F.when(d == 0, 0.0).when(top == r, ((g - b) / d + 6) % 6).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    sat = F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(2 * light - 1)))
    return F.struct((F.floor(hue + 0.5) % 360).alias("h"), F.floor(sat * 100 + 0.5).alias("s"), F.floor(light * 100 + 0.5).alias("l"))
