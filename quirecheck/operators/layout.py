"""Verdicts over the pages, boxes, fonts, inks and images of each document.

Every operator is an aggregate Column. :func:`verdicts` evaluates any number of them in one pass
over an element table, keeping documents without elements: nothing to validate is valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quirecheck.functions import color
from quirecheck.functions.values import rounded

BLEED_MARGIN_PT = 3 * 72 / 25.4
BOX_LABELS = {"media": "MediaBox", "crop": "CropBox", "trim": "TrimBox", "bleed": "BleedBox", "art": "ArtBox"}


def verdicts(docs: DataFrame | None, elements: DataFrame, **aggregates: tuple[Column, object]) -> DataFrame:
    """One row per document; each aggregate is (Column, value for a document without elements)."""
    found = elements.groupBy("doc_id").agg(
        *[(F.coalesce(a, F.lit(v)) if v is not None else a).alias(name) for name, (a, v) in aggregates.items()]
    )
    if docs is None:
        return found
    filled = [
        (F.coalesce(name, F.lit(v)) if v is not None else F.col(name)).alias(name)
        for name, (_, v) in aggregates.items()
    ]
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", *filled)


# ---- ink ----


def highest_tac(tac: str = "tac_max") -> Column:
    return rounded(F.max(tac), 1)


def ink_coverage(ink: str = "ink_avg") -> Column:
    # The sum is rounded first, so its value does not depend on the order rows arrive in.
    return rounded(F.round(F.sum(ink), 6) / F.greatest(F.count(ink), F.lit(1)), 1)


def tac_within(limit: float = 300.0, tac: str = "tac_max") -> Column:
    return F.bool_and(F.col(tac) <= limit)


def exact_tac() -> Column:
    return rounded(F.max(color.tac_ink(F.col("space"))), 1)


def has_rich_black() -> Column:
    return F.bool_or(color.is_rich_black(*[F.col(c) for c in ("space", "c", "m", "y", "k")]))


def spot_colors() -> Column:
    """Distinct spot inks, sorted; the reserved names for registration and for none are no inks."""
    real = (F.col("space") == "spot") & ~F.col("spot").isin("All", "None")
    return F.sort_array(F.collect_set(F.when(real, F.col("spot"))))


# ---- strokes and fonts ----


def stroke_below(limit: float, stroke: str = "min_stroke_pt") -> Column:
    """A stroke thinner than the limit; a document without strokes has none."""
    return F.coalesce(F.min(stroke) < limit, F.lit(False))


def strokes_at_least(limit: float, stroke: str = "min_stroke_pt") -> Column:
    return F.coalesce(F.min(stroke) >= limit, F.lit(True))


def has_zero_stroke(width: Column) -> Column:
    return F.bool_or(width == 0)


def all_embedded() -> Column:
    return F.bool_and("embedded")


def embedded_are_subsets() -> Column:
    return F.bool_and(~F.col("embedded") | F.col("subset"))


def fonts_where(condition: Column, label: Column | None = None) -> Column:
    """Sorted distinct names (or labels) of the fonts that meet a condition."""
    shown = F.col("name") if label is None else label
    return F.sort_array(F.collect_set(F.when(condition, shown)))


def licensing_risks() -> Column:
    type3 = F.col("font_type") == "Type3"
    reason = F.when(type3, "Type3").otherwise("not embedded")
    return fonts_where(type3 | ~F.col("embedded"), F.concat("name", F.lit(" ("), reason, F.lit(")")))


def sizes_at_least(limit: float = 6.0, size: str = "size") -> Column:
    return F.bool_and(F.col(size) >= limit)


def first_seen(elements: DataFrame, value: str, position: str, out: str) -> DataFrame:
    """Distinct values of each document in the order they first occur."""
    seen = elements.groupBy("doc_id", value).agg(F.min(position).alias("_at"))
    ordered = F.sort_array(F.collect_list(F.struct("_at", value)))
    return seen.groupBy("doc_id").agg(F.transform(ordered, lambda s: s[value]).alias(out))


# ---- boxes ----


def boxes_present(box: str) -> Column:
    return F.bool_and(F.col(box).isNotNull())


def bleed_clears_trim(margin: float = BLEED_MARGIN_PT) -> Column:
    """The bleed box exceeds the trim box by the margin on all sides; a missing box fails."""
    t, b, need = F.col("trim"), F.col("bleed"), margin - 0.01
    clear = (t[0] - b[0] >= need) & (t[1] - b[1] >= need) & (b[2] - t[2] >= need) & (b[3] - t[3] >= need)
    return F.bool_and(F.coalesce(clear, F.lit(False)))


def printed(number: Column) -> Column:
    """A number as text, without decimals when it is whole."""
    whole = number == F.floor(number)
    return F.when(whole, F.floor(number).cast("string")).otherwise(number.cast("string"))


def page_boxes() -> Column:
    """``Label: [left, bottom, right, top]`` for the boxes a page has."""

    def line(name, label):
        corners = F.array_join(F.transform(name, printed), ", ")
        return F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{label}: ["), corners, F.lit("]")))

    return F.array_compact(F.array(*[line(n, label) for n, label in BOX_LABELS.items()]))


# ---- images ----


def color_mode() -> Column:
    """RGB, CMYK, Mixed, Other or None, from the spaces of all images."""
    rgb, cmyk = F.bool_or(F.contains("color_space", F.lit("RGB"))), F.bool_or(F.contains("color_space", F.lit("CMYK")))
    return F.when(rgb & cmyk, "Mixed").when(rgb, "RGB").when(cmyk, "CMYK").otherwise("Other")


def all_in_space(space: str) -> Column:
    return F.bool_and(F.col("color_space") == space)


def low_resolution(limit: float = 300.0) -> Column:
    return F.bool_or(F.least("dpi_x", "dpi_y") < limit)


# ---- output settings ----


def overprint_off() -> Column:
    return ~F.coalesce(F.bool_or("overprint"), F.lit(False))


def output_intent(expected: str | None = None) -> Column:
    """Is there an output intent, and does it contain ``expected``?"""
    intent = F.max("output_intent")
    return F.coalesce(intent.isNotNull() if expected is None else F.contains(intent, F.lit(expected)), F.lit(False))


def intents_are(expected: str) -> Column:
    return F.coalesce(F.bool_and(F.col("rendering_intent") == expected), F.lit(True))
