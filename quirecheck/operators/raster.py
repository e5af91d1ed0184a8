"""Operators over rasters and pairs of rasters of two document versions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from quirecheck.functions import raster as X
from quirecheck.functions.values import rounded
from quirecheck.operators.checks import ERROR

# Similarity of a page that stayed in place, and of one found elsewhere.
IN_PLACE, MOVED = 0.995, 0.98


def pair_up(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rasters present on both sides, columns w, h, px suffixed _a and _b."""

    def side(df, suffix):
        return df.select(*keys, *[F.col(c).alias(c + suffix) for c in ("w", "h", "px")])

    return side(a, "_a").join(side(b, "_b"), keys)


def to_common_size(pairs: DataFrame) -> DataFrame:
    """Both rasters sampled to the smaller width and height; equal sizes pass unchanged."""
    same = (F.col("w_a") == F.col("w_b")) & (F.col("h_a") == F.col("h_b"))
    sized = pairs.withColumn("_w", F.greatest(F.least("w_a", "w_b"), F.lit(1))).withColumn(
        "_h", F.greatest(F.least("h_a", "h_b"), F.lit(1))
    )

    def sampled(side):
        px = F.col(f"px_{side}")
        resized = X.resize(px, F.col(f"w_{side}"), F.col(f"h_{side}"), F.col("_w"), F.col("_h"))
        return F.when(same, px).otherwise(resized)

    return sized.select(
        *[c for c in pairs.columns if c[:-2] not in ("w", "h", "px")],
        F.col("_w").alias("w"),
        F.col("_h").alias("h"),
        sampled("a").alias("px_a"),
        sampled("b").alias("px_b"),
    )


def similarity() -> Column:
    return rounded(X.ssim(F.col("px_a"), F.col("px_b")), 3)


def with_hash(rasters: DataFrame, out: str = "bits") -> DataFrame:
    px, w, h = F.col("px"), F.col("w"), F.col("h")
    return rasters.withColumn("_block", X.low_frequencies(px, w, h)).withColumn(out, X.hash_bits(F.col("_block"))).drop("_block")


# ---- where did a page of the new version come from ----


def _spread_bucket(square: Column, stabiliser: float, threshold: float) -> Column:
    """Bucket of a non-negative quantity given by its square, so that similar pages are neighbours.

    Each factor of the similarity index is (2pq + c) / (p^2 + q^2 + c) at most, with p, q the means
    or the deviations. With u = sqrt(p^2 + c/2), an index of s needs u and v within the factor T,
    the larger root of s t^2 - 2 t + s, hence neighbouring buckets of log(u) in steps of log(T).
    """
    step = math.log((1 + math.sqrt(1 - threshold * threshold)) / threshold)
    return F.floor(F.log(F.sqrt(square + stabiliser / 2)) / step).cast("int")


def _placed(rasters: DataFrame, threshold: float) -> DataFrame:
    n = F.size("px").cast("double")
    values = F.transform("px", lambda v: v.cast("bigint"))
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("q"))
    sums = F.aggregate(
        values, zero, lambda acc, v: F.struct((acc["s"] + v).alias("s"), (acc["q"] + v * v).alias("q"))
    )
    mean = F.col("_sums.s") / n
    variance = F.greatest(F.col("_sums.q") / n - mean * mean, F.lit(0.0))
    return (
        rasters.withColumn("_sums", sums)
        .withColumn("mean_bucket", _spread_bucket(mean * mean, X.C1, threshold))
        .withColumn("spread_bucket", _spread_bucket(variance, X.C2, threshold))
        .drop("_sums")
    )


def provenance(new: DataFrame, old: DataFrame, same: float = IN_PLACE, moved: float = MOVED) -> DataFrame:
    """(doc_id, page_no, origin): each new page is in place, moved (found at another place) or rewritten.

    A new page whose number the old version does not have is moved or rewritten. All rasters have one size. Only pages out of place are searched for, equal rasters are compared
    once, and only rasters whose mean and spread allow the wanted similarity meet.
    """
    keys = ["doc_id", "page_no"]
    before = old.select(*keys, F.col("px").alias("px_b"))
    pairs = new.select(*keys, F.col("px").alias("px_a")).join(before, keys, "left")
    in_place = F.coalesce(F.when(F.col("px_b").isNotNull(), similarity() >= same), F.lit(False))
    pairs = pairs.select(*keys, F.col("px_a").alias("px"), in_place.alias("in_place"))
    missing = pairs.filter("not in_place").select("doc_id", "page_no", "px")
    limit = moved - 0.0005  # the index is rounded to three decimals before it is compared
    sought = _placed(missing.select("doc_id", "px").distinct(), limit)
    places = _placed(
        old.groupBy("doc_id", "px").agg(F.min("page_no").alias("first"), F.max("page_no").alias("last")), limit
    )
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    places = (
        places.withColumnRenamed("px", "px_b")
        .withColumn("mean_bucket", F.explode(F.transform(near, lambda d: F.col("mean_bucket") + d)))
        .withColumn("spread_bucket", F.explode(F.transform(near, lambda d: F.col("spread_bucket") + d)))
    )
    found = (
        sought.withColumnRenamed("px", "px_a")
        .join(places, ["doc_id", "mean_bucket", "spread_bucket"])
        .filter(similarity() >= moved)
        .groupBy("doc_id", F.col("px_a").alias("px"))
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
    )
    elsewhere = missing.join(found, ["doc_id", "px"]).filter("first <> page_no or last <> page_no").select(
        *keys, F.lit(True).alias("elsewhere")
    )
    origin = F.when(F.col("in_place"), "in place").when(F.col("elsewhere"), "moved").otherwise("rewritten")
    return pairs.drop("px").join(elsewhere, keys, "left").select(*keys, origin.alias("origin"))


def change_scope(pairs: DataFrame, most: int, expected_page: int, same: float = IN_PLACE) -> DataFrame:
    """Per document: changed pages, whether the change stayed in scope, happened at all, and hit one page only."""
    changed = similarity() < same
    return pairs.select("doc_id", "page_no", changed.alias("changed")).groupBy("doc_id").agg(
        F.count_if("changed").alias("changed_pages"),
        (F.count_if("changed") <= most).alias("within_scope"),
        (F.count_if("changed") > 0).alias("something_changed"),
        F.coalesce(F.bool_or(F.when(F.col("page_no") == expected_page, F.col("changed"))), F.lit(False)).alias("expected_changed"),
        F.coalesce(F.bool_and(F.when(F.col("page_no") != expected_page, ~F.col("changed"))), F.lit(True)).alias("rest_unchanged"),
    )


# ---- pixel comparison of colour pages ----


def with_changes(pairs: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Adds the union canvas (width, height) and ``classes``, the class of each of its pixels."""
    c = F.col
    classes = X.changes(c("px_a"), c("w_a"), c("h_a"), c("px_b"), c("w_b"), c("h_b"), threshold)
    return pairs.withColumn("width", F.greatest("w_a", "w_b")).withColumn("height", F.greatest("h_a", "h_b")).withColumn(
        "classes", classes
    )


def page_differences(changed: DataFrame, block: int = 32) -> DataFrame:
    """(doc_id, page_no, diff_percent, areas)"""
    blocks = X.changed_blocks(F.col("classes"), F.col("width"), block)
    return changed.select(
        "doc_id", "page_no", X.diff_percent(F.col("classes")).alias("diff_percent"), F.size(blocks).alias("areas")
    )


def compare_rasters(
    pairs: DataFrame, threshold: float = 0.05, blur: int = 0, align: bool = True, max_offset: int = 32, coarse: int = 8, fine: int = 2, block: int = 32
) -> DataFrame:
    """(doc_id, page_no, dx, dy, diff_percent, areas) of pairs of colour pages: blurred, lined up and compared in one pass.

    Pixels may have an alpha plane; what is transparent, and what lies outside a page, is white.
    """
    c = F.col
    found = X.compare(c("px_a"), c("w_a"), c("h_a"), c("px_b"), c("w_b"), c("h_b"), threshold, blur, align, 3.0, max_offset, coarse, fine, block)
    return pairs.select("doc_id", "page_no", found.alias("found")).select("doc_id", "page_no", "found.dx", "found.dy", "found.diff_percent", "found.areas")


def pixel_findings(differences: DataFrame, max_diff: float = 0.0) -> DataFrame:
    """A finding for every page that differs by more than ``max_diff`` percent; it names the shift, if pages were moved."""
    message = F.format_string(
        "page %d: %.2f%% of the pixels differ, in %d area(s)", "page_no", F.bround("diff_percent", 2), "areas"
    )
    if "dx" in differences.columns:
        moved = (F.col("dx") != 0) | (F.col("dy") != 0)
        message = F.concat(message, F.when(moved, F.format_string(" (aligned by %d, %d px)", "dx", "dy")).otherwise(""))
    return differences.filter(F.col("diff_percent") > max_diff).select(
        "doc_id", F.lit(ERROR).alias("severity"), F.lit("pixel difference").alias("check_name"), message.alias("message")
    )


def pixel_similarity(differences: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """100 minus the mean difference of the pages compared; with ``docs``, 0 where no page was."""
    total = F.round(F.sum("diff_percent"), 6)
    found = differences.groupBy("doc_id").agg((100 - total / F.count("*")).alias("similarity"))
    if docs is None:
        return found
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def change_regions(changed: DataFrame, block: int = 32) -> DataFrame:
    """One row per touched block: (doc_id, page_no, x, y, width, height)."""
    blocks = X.changed_blocks(F.col("classes"), F.col("width"), block)
    return changed.select("doc_id", "page_no", "width", "height", F.explode(blocks).alias("n")).select(
        "doc_id", "page_no", X.block_region(F.col("n"), F.col("width"), F.col("height"), block).alias("r")
    ).select("doc_id", "page_no", "r.x", "r.y", "r.width", "r.height")


def missing_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings for pages that only one of two versions has."""

    def side(df, name):
        return df.select("doc_id", "page_no", F.lit(True).alias(name))

    both = side(old, "_old").join(side(new, "_new"), ["doc_id", "page_no"], "full")
    where = F.when(F.col("_old").isNull(), "the first version").when(F.col("_new").isNull(), "the second version")
    return both.filter(where.isNotNull()).select(
        "doc_id",
        "page_no",
        F.lit(ERROR).alias("severity"),
        F.lit("page count").alias("check_name"),
        F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(" is missing from "), where).alias("message"),
    )


def best_offset(
    pairs: DataFrame, coarse: int = 8, fine: int = 2, max_offset: int = 32, align_above: float = 3.0, threshold: float = 0.05
) -> DataFrame:
    """Adds ``shift`` (dx, dy) that lines ``px_b`` up with ``px_a``; grey rasters of one size w x h.

    Pages that hardly differ are left alone. The rest are searched on a coarse copy, and the winner
    is refined on a fine one.
    """
    w, h = F.col("w"), F.col("h")

    def scaled(n, scale):
        return F.floor((n + (scale - 1)) / scale).cast("int")

    staged = pairs
    for name, scale in (("c", coarse), ("f", fine)):
        for side in "ab":
            staged = staged.withColumn(f"_{name}{side}", X.downsample(F.col(f"px_{side}"), w, h, scale))
    zero = F.lit(0)
    reach = max(max_offset // coarse, 2)
    staged = staged.withColumn("_still", X.rough_diff(F.col("_ca"), F.col("_cb"), threshold) < align_above)
    first = X.best_shift(F.col("_ca"), F.col("_cb"), scaled(w, coarse), scaled(h, coarse), zero, zero, reach)
    staged = staged.withColumn("_first", F.when(~F.col("_still"), first))

    def centre(axis):
        # Truncates toward zero, like the integer division it stands for.
        value = F.col(f"_first.{axis}") * coarse / fine
        return (F.signum(value) * F.floor(F.abs(value))).cast("int")

    second = X.best_shift(
        F.col("_fa"), F.col("_fb"), scaled(w, fine), scaled(h, fine), centre("dx"), centre("dy"), coarse // fine
    )
    staged = staged.withColumn("_second", F.when(~F.col("_still"), second))
    # The search asks where the first page lies in the second, the result says the reverse.
    shift = F.struct(*[F.coalesce(-F.col(f"_second.{a}") * fine, zero).alias(a) for a in ("dx", "dy")])
    return staged.withColumn("shift", shift).select(*pairs.columns, "shift")
