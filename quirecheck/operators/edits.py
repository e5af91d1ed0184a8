"""Edits of the page set of many documents at once.

Page numbers are dense, so every edit renumbers by arithmetic and needs no sort. An edit that is
not valid for a document leaves it as it is; :func:`edit_plan` says why.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quirecheck.functions.values import half_away
from quirecheck.operators.layout import printed
from quirecheck.operators.unions import union_all

N = "page_count"


def with_counts(pages: DataFrame) -> DataFrame:
    """Adds the number of pages of the document."""
    return pages.join(pages.groupBy("doc_id").agg(F.count("*").alias(N)), "doc_id")


def missing_page_error(name: str, page: Column) -> Column:
    message = F.concat(
        F.lit(f"{name}: page "), page.cast("string"), F.lit(" does not exist (the document has "),
        F.col(N).cast("string"), F.lit(")"),
    )
    return F.when((page < 1) | (page > F.col(N)), message)


def delete_error(page: Column) -> Column:
    only = F.when(F.col(N) == 1, F.lit("delete_page: cannot remove the only page of the document"))
    return F.coalesce(missing_page_error("delete_page", page), only)


def order_error(order: Column) -> Column:
    message = F.concat(
        F.lit("reorder_pages: the order must use each page from 1 to "), F.col(N).cast("string"), F.lit(" exactly once")
    )
    # Distinct numbers from 1 to n, n of them: a permutation.
    valid = (
        (F.size(order) == F.col(N)) & (F.size(F.array_distinct(order)) == F.col(N))
        & (F.array_min(order) == 1) & (F.array_max(order) == F.col(N))
    )
    return F.when(~valid, message)


def range_error(first: Column, last: Column) -> Column:
    backwards = F.concat(
        F.lit("split_document: invalid range ("), first.cast("string"), F.lit(" to "), last.cast("string"), F.lit(")")
    )
    return F.coalesce(
        missing_page_error("split_document", first), missing_page_error("split_document", last), F.when(last < first, backwards)
    )


def delete_page(pages: DataFrame, page: Column) -> DataFrame:
    """Drop one page; those after it move up. ``page`` may differ by document."""
    valid = delete_error(page).isNull()
    kept = with_counts(pages).filter(~valid | (F.col("page_no") != page))
    moved = F.when(valid & (F.col("page_no") > page), F.col("page_no") - 1).otherwise(F.col("page_no"))
    return kept.withColumn("page_no", moved).drop(N)


def duplicate_page(pages: DataFrame, page: Column) -> DataFrame:
    """A copy right after the original."""
    n = F.col("page_no")
    valid = missing_page_error("duplicate_page", page).isNull()
    numbers = (
        F.when(valid & (n == page), F.array(n, n + 1)).when(valid & (n > page), F.array(n + 1)).otherwise(F.array(n))
    )
    return with_counts(pages).withColumn("page_no", F.explode(numbers)).drop(N)


def reorder_pages(pages: DataFrame, order: Column) -> DataFrame:
    """Page ``order[k]`` becomes page k."""
    valid = order_error(order).isNull()
    place = F.when(valid, F.array_position(order, F.col("page_no"))).otherwise(F.col("page_no"))
    return with_counts(pages).withColumn("page_no", place.cast("bigint")).drop(N)


def reverse_pages(pages: DataFrame) -> DataFrame:
    """The order n..1, without building it."""
    return with_counts(pages).withColumn("page_no", F.col(N) - F.col("page_no") + 1).drop(N)


def split_document(pages: DataFrame, first: Column, last: Column) -> DataFrame:
    """Pages first..last as a document of their own."""
    inside = range_error(first, last).isNull() & F.col("page_no").between(first, last)
    return with_counts(pages).filter(inside).withColumn("page_no", F.col("page_no") - first + 1).drop(N)


def merge_documents(pages: DataFrame, appended: DataFrame) -> DataFrame:
    """Append pages (doc_id, page_no, ...) after the last page of the document of that number."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias(N))
    moved = appended.join(counts, "doc_id").withColumn("page_no", F.col("page_no") + F.col(N)).drop(N)
    return union_all(pages, moved)


def rotate_pages(pages: DataFrame, degrees: int, page: int = 0) -> DataFrame:
    """Set the rotation of one page, or of all with page 0."""
    if degrees not in (90, 180, 270):
        raise ValueError(f"rotate_page: rotation must be 90, 180 or 270 (got {degrees})")
    turned = F.lit(degrees) if page == 0 else F.when(F.col("page_no") == page, degrees).otherwise(F.col("rotation"))
    return pages.withColumn("rotation", turned)


def set_box(pages: DataFrame, box: str, rect: Sequence[float]) -> DataFrame:
    """Set one box (media, crop, trim, bleed) of every page to [x0, y0, x1, y1]."""
    x0, y0, x1, y1 = rect
    if x1 <= x0 or y1 <= y0:
        raise ValueError(f"set_{box}_box: invalid rectangle (expected x0, y0, x1, y1 with x1 > x0 and y1 > y0)")
    return pages.withColumn(box, F.array(*[F.lit(float(v)) for v in rect]))


def set_page_size(pages: DataFrame, width: float, height: float) -> DataFrame:
    if width <= 0 or height <= 0:
        raise ValueError("set_page_size: dimensions must be positive")
    sized = set_box(pages, "media", (0.0, 0.0, width, height))
    return sized.withColumn("width", F.lit(float(width))).withColumn("height", F.lit(float(height)))


def overlays(pages: DataFrame, watermark: str | None = None, stamp: str | None = None, numbers: bool = False) -> DataFrame:
    """Texts to draw on each page (doc_id, page_no, width, height): kind, text, position, size, angle."""
    for kind, text in (("watermark", watermark), ("stamp", stamp)):
        if text is not None and not text.strip():
            raise ValueError(f"add_{kind} expects the text")
    w, h = F.col("width"), F.col("height")
    page_label = F.concat(F.col("page_no").cast("string"), F.lit(" / "), F.col(N).cast("string"))
    wanted = []
    if watermark is not None:
        wanted.append(("watermark", F.lit(watermark), w * 0.25, h * 0.35, 48.0, 45.0))
    if numbers:
        wanted.append(("number", page_label, w / 2 - 15, F.lit(20.0), 10.0, 0.0))
    if stamp is not None:
        wanted.append(("stamp", F.lit(stamp), w - 140, h - 40, 12.0, 0.0))
    drawn = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"), text.alias("text"), x.alias("x"), y.alias("y"), F.lit(size).alias("size"),
                F.lit(angle).alias("angle"),
            )
            for kind, text, x, y, size, angle in wanted
        ]
    )
    return with_counts(pages).select("doc_id", "page_no", F.explode(drawn).alias("o")).select("doc_id", "page_no", "o.*")


def downsample_plan(images: DataFrame, dpi: float = 300.0) -> DataFrame:
    """Images printed above the target resolution across, and the pixel size that brings them to it."""
    if dpi <= 0:
        raise ValueError("downsample_images: DPI must be positive")
    width, height = F.col("width"), F.col("height")
    inches = width / F.col("dpi_x")
    large = images.filter((F.col("dpi_x") > dpi) & (width >= 2) & (height >= 2) & (inches * 72 > 1))
    new_width = F.greatest(half_away(inches * dpi), F.lit(1))
    return large.select("doc_id", "page_no", "width", "height", new_width.alias("new_width")).withColumn(
        "new_height", F.greatest(half_away(F.col("new_width") * (height / width)), F.lit(1))
    )


def _shown(numbers: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(numbers.cast("array<string>"), ", "), F.lit("]"))


def edit_plan(ops: DataFrame, counts: DataFrame) -> DataFrame:
    """A dry run of queued edits (doc_id, seq, op, page, last_page, degrees, order, text, rect, width, height).

    Each is checked against the original page count: a description, or an error.
    """
    joined = ops.join(counts, "doc_id")
    op, page = F.col("op"), F.col("page")
    number = page.cast("string")
    text = F.concat(F.lit('"'), F.col("text"), F.lit('"'))
    degrees = F.concat(F.col("degrees").cast("string"), F.lit("°"))
    description = (
        F.when(op == "delete_page", F.concat(F.lit("page "), number, F.lit(" removed")))
        .when(op == "duplicate_page", F.concat(F.lit("page "), number, F.lit(" duplicated")))
        .when((op == "rotate_page") & (page == 0), F.concat(F.lit("all pages rotated "), degrees))
        .when(op == "rotate_page", F.concat(F.lit("page "), number, F.lit(" rotated "), degrees))
        .when(op == "reorder_pages", F.concat(F.lit("pages reordered to "), _shown(F.col("order"))))
        .when(op == "split_document", F.concat(F.lit("pages "), number, F.lit("-"), F.col("last_page").cast("string"), F.lit(" saved to "), "text"))
        .when(op == "merge_documents", F.concat(F.lit("pages from "), "text", F.lit(" appended at the end")))
        .when(op == "add_watermark", F.concat(F.lit("watermark "), text, F.lit(" added")))
        .when(op == "add_stamp", F.concat(F.lit("stamp "), text, F.lit(" added")))
        .when(op == "add_page_numbers", F.lit("page numbering added"))
        .when(op == "set_page_size", F.concat(F.lit("page size set to "), printed(F.col("width")), F.lit("x"), printed(F.col("height")), F.lit("pt")))
        .when(op == "set_crop_box", F.concat(F.lit("CropBox set to "), _shown(F.col("rect"))))
        .when(op == "set_trim_box", F.concat(F.lit("TrimBox set to "), _shown(F.col("rect"))))
        .when(op == "set_bleed_box", F.concat(F.lit("BleedBox set to "), _shown(F.col("rect"))))
    )
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    rect = F.col("rect")
    bad_rect = (F.get(rect, F.lit(2)) <= F.get(rect, F.lit(0))) | (F.get(rect, F.lit(3)) <= F.get(rect, F.lit(1)))
    error = (
        F.when(op == "delete_page", delete_error(page))
        .when(op == "duplicate_page", missing_page_error("duplicate_page", page))
        .when(
            (op == "rotate_page") & ~F.col("degrees").isin(90, 180, 270),
            F.concat(F.lit("rotate_page: rotation must be 90, 180 or 270 (got "), F.col("degrees").cast("string"), F.lit(")")),
        )
        .when((op == "rotate_page") & (page != 0), missing_page_error("rotate_page", page))
        .when(op == "reorder_pages", order_error(F.col("order")))
        .when(op == "split_document", range_error(page, F.col("last_page")))
        .when(op.isin("add_watermark", "add_stamp", "merge_documents") & blank, F.concat(op, F.lit(" expects a text")))
        .when((op == "set_page_size") & ((F.col("width") <= 0) | (F.col("height") <= 0)), F.lit("set_page_size: dimensions must be positive"))
        .when(op.isin("set_crop_box", "set_trim_box", "set_bleed_box") & bad_rect, F.concat(op, F.lit(": invalid rectangle")))
    )
    return joined.select("doc_id", "seq", "op", F.when(error.isNull(), description).alias("description"), error.alias("error"))
