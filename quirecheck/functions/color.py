"""Ink coverage and colour distance as Column expressions. Components run from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tac_rgb(r: Column, g: Column, b: Column) -> Column:
    """Total ink (%) of an RGB colour separated with as much black as possible; pure black is 100 %."""
    black = 1 - F.greatest(r, g, b)
    inks = [(1 - component - black) / (1 - black) for component in (r, g, b)]
    return F.when(black >= 1, F.lit(100.0)).otherwise((inks[0] + inks[1] + inks[2] + black) * 100)


def tac_cmyk(c: Column, m: Column, y: Column, k: Column) -> Column:
    return (c + m + y + k) * 100


def tac_ink(space: Column) -> Column:
    """Total ink of a row of an ink table (space, c, m, y, k, r, g, b, gray, pct)."""
    col = F.col
    return (
        F.when(space == "cmyk", tac_cmyk(col("c"), col("m"), col("y"), col("k")))
        .when(space == "rgb", tac_rgb(col("r"), col("g"), col("b")))
        .when(space == "gray", (1 - col("gray")) * 100)
        .when(space == "spot", col("pct") * 100)
    )


def is_rich_black(space: Column, c: Column, m: Column, y: Column, k: Column) -> Column:
    return F.coalesce((space == "cmyk") & (k >= 0.6) & (c + m + y >= 0.2), F.lit(False))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    return [(1 - ink) * (1 - k) for ink in (c, m, y)]


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    """CIE Lab (D65) of an sRGB colour."""

    def linear(v):
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    def curve(t):
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0)

    red, green, blue = linear(r), linear(g), linear(b)
    # The sRGB to XYZ matrix and the D65 white point.
    x = curve((red * 0.4124 + green * 0.3576 + blue * 0.1805) / 0.95047)
    y = curve(red * 0.2126 + green * 0.7152 + blue * 0.0722)
    z = curve((red * 0.0193 + green * 0.1192 + blue * 0.9505) / 1.08883)
    return [y * 116 - 16, (x - y) * 500, (y - z) * 200]


def delta_e(first: list[Column], second: list[Column]) -> Column:
    """CIE76 distance of two Lab colours."""
    return F.sqrt(sum((p - q) * (p - q) for p, q in zip(first, second)))
