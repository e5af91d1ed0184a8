"""Operators over page tables (doc_id, page_no, text, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quirecheck.functions.text import strip


def whole_text(pages: DataFrame) -> DataFrame:
    """One row per document: page texts in order, joined with newlines, and the page count.

    The result is one value per document by definition, so a document has to fit one row.
    """
    ordered = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(ordered.alias("p"), F.count("*").alias("page_count")).select(
        "doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), "page_count"
    )


def page_text(pages: DataFrame, page_no: int) -> DataFrame:
    """Text of one page; a document without that page gets an error message instead."""
    wanted = F.max(F.when(F.col("page_no") == page_no, F.struct("text")))["text"]
    found = pages.groupBy("doc_id").agg(
        wanted.alias("text"),
        F.max(F.when(F.col("page_no") == page_no, F.lit(True))).alias("found"),
        F.count("*").alias("n"),
    )
    missing = F.concat(
        F.lit(f"page {page_no} does not exist (the document has "), F.col("n").cast("string"), F.lit(")")
    )
    return found.select("doc_id", "text", F.when(F.col("found").isNull(), missing).alias("error"))


def text_in_regions(
    spans: DataFrame, regions: list[tuple[str, float, float, float, float]], separator: str = ""
) -> DataFrame:
    """Text of the spans (doc_id, page_no, pos, text, x, y) inside each region of each page, borders included.

    ``regions`` are (name, x, y, width, height), a short list written in the check. Spans outside
    all of them are dropped before the shuffle; ``pos`` orders the spans of a page.
    """
    hits = F.array(
        *[
            F.when(
                F.col("x").between(x, x + w) & F.col("y").between(y, y + h), F.lit(name)
            )
            for name, x, y, w, h in regions
        ]
    )
    inside = spans.select("doc_id", "page_no", "pos", "text", F.explode(F.array_compact(hits)).alias("name"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return inside.groupBy("doc_id", "page_no", "name").agg(ordered.alias("s"), F.count("*").alias("spans")).select(
        "doc_id", "page_no", "name", F.array_join(F.transform("s", lambda x: x["text"]), separator).alias("text"), "spans"
    )


def text_of_pages_in_regions(
    pages: DataFrame, regions: list[tuple[str, float, float, float, float]], separator: str = ""
) -> DataFrame:
    """As :func:`text_in_regions`, for pages (doc_id, page_no, spans) that bring their spans, an array of (pos, text, x, y).

    What a page needs is in its row, so nothing is shuffled.
    """

    def found(name, x, y, w, h):
        inside = F.filter("spans", lambda s: s["x"].between(x, x + w) & s["y"].between(y, y + h))
        return F.struct(F.lit(name).alias("name"), F.sort_array(F.transform(inside, lambda s: F.struct(s["pos"].alias("pos"), s["text"].alias("text")))).alias("s"))

    hits = F.filter(F.array(*[found(*r) for r in regions]), lambda r: F.size(r["s"]) > 0)
    return pages.select("doc_id", "page_no", F.explode(hits).alias("r")).select(
        "doc_id", "page_no", "r.name", F.array_join(F.transform("r.s", lambda s: s["text"]), separator).alias("text"), F.size("r.s").cast("bigint").alias("spans")
    )


def text_in_page_regions(
    spans: DataFrame, pages: DataFrame, page_no: int, regions: list[tuple[str, float, float, float, float]], separator: str = ""
) -> DataFrame:
    """(doc_id, name, text, error) for one page of every document: '' where a region is empty.

    A document without that page gets an error message instead of a text.
    """
    asked = page_text(pages, page_no).select("doc_id", "error", F.explode(F.array(*[F.lit(r[0]) for r in regions])).alias("name"))
    found = text_in_regions(spans.filter(F.col("page_no") == page_no), regions, separator).drop("page_no", "spans")
    text = F.when(F.col("error").isNull(), F.coalesce("text", F.lit("")))
    return asked.join(found, ["doc_id", "name"], "left").select("doc_id", "name", text.alias("text"), "error")


def rasterized_text(pages: DataFrame, images: DataFrame, share: float = 0.5) -> DataFrame:
    """Documents with a page that has no text but an image covering ``share`` of its area."""
    area = F.col("width") * F.col("height")
    blank = pages.select(
        "doc_id", "page_no", area.alias("area"), ((strip(F.col("text")) == "") & (area > 0)).alias("blank")
    )
    image_area = (
        F.col("width") / (F.greatest("dpi_x", F.lit(1.0)) / 72)
        * (F.col("height") / (F.greatest("dpi_y", F.lit(1.0)) / 72))
    )
    # One row per page on the image side, so the join never multiplies rows.
    largest = images.groupBy("doc_id", "page_no").agg(F.max(image_area).alias("image_area"))
    covered = F.col("blank") & F.coalesce(F.col("image_area") >= F.col("area") * share, F.lit(False))
    return blank.join(largest, ["doc_id", "page_no"], "left").groupBy("doc_id").agg(
        F.bool_or(covered).alias("suspect")
    )


# ---- page specifications such as 1-10,3 ----

#: Pages a range may list, as lists are built in one row; and no limit, where no list is built.
MAX_PAGES, ANY_LENGTH = 1_000_000, 1 << 62
_PIECE = r"\A\s*\+?([0-9]{1,18})\s*(?:-\s*\+?([0-9]{1,18})\s*)?\z"


def _bounds(spec: Column, most: int) -> Column:
    """Array of (piece, first, last); the numbers are null in a broken piece, or one of more than ``most`` pages."""

    def parsed(piece):
        first = F.regexp_extract(piece, _PIECE, 1).try_cast("bigint")
        last = F.coalesce(F.regexp_extract(piece, _PIECE, 2).try_cast("bigint"), first)
        ok = (first >= 1) & (last >= first) & (last - first < F.lit(most))
        return F.struct(piece.alias("piece"), F.when(ok, first).alias("first"), F.when(ok, last).alias("last"))

    pieces = F.filter(F.transform(F.split(spec, ","), strip), lambda p: p != "")
    return F.transform(pieces, parsed)


def range_error(spec: Column, max_pages: int = MAX_PAGES) -> Column:
    """The first piece that is not a page or a range of at most ``max_pages``, else null."""
    return F.get(F.filter(_bounds(spec, max_pages), lambda b: b["first"].isNull()), F.lit(0))["piece"]


def in_range(spec: Column, page_no: Column) -> Column:
    """Is the page selected? Null when the specification is broken. No page list is built, so ranges have no limit."""
    inside = F.exists(_bounds(spec, ANY_LENGTH), lambda b: page_no.between(b["first"], b["last"]))
    return F.when(range_error(spec, ANY_LENGTH).isNull(), inside)


def page_list(spec: Column, max_pages: int = MAX_PAGES) -> Column:
    """Sorted distinct page numbers; null when the specification is broken or names a range above ``max_pages``."""
    numbers = F.flatten(F.transform(_bounds(spec, max_pages), lambda b: F.sequence(b["first"], b["last"])))
    return F.when(range_error(spec, max_pages).isNull(), F.sort_array(F.array_distinct(numbers)))
