"""Element tables (pages, images, fonts, boxes, inks, codes, ...) derived from the given tables.

A real deployment reads these tables from an extraction job. Here each one is a projection of a
TPC-H-like or text table, so that every operator has whole-table input that grows with the data.
Derivations that need no element number avoid the window that computes it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quirecheck.functions.values import let
from quirecheck.sources.reading import dealt, spread, tasks
from quirecheck.operators.tiles import gathered
from quirecheck.operators.unions import union_all

MAX_PIXEL = 255


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


# ---- elements of an order: one line item is one page, image, font use or ink ----


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


def numbered_lines(spark, d) -> DataFrame:
    """Line items with ``pos``, the 1-based element number within the order."""
    lines = table(spark, d, "lineitem")
    return dealt(lines, lines, "l_orderkey").withColumn("pos", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("bigint"))


def _color_space():
    flag = F.col("l_returnflag")
    return (
        F.when(flag == "A", "DeviceRGB").when(flag == "N", "DeviceCMYK").otherwise("DeviceGray")
    )


def _image_columns():
    qty = F.col("l_quantity")
    return [
        F.col("l_orderkey").alias("doc_id"),
        (qty * 24).cast("bigint").alias("width"),
        (qty * 32).cast("bigint").alias("height"),
        (F.lit(50) + qty * 10).alias("dpi_x"),
        (F.lit(60) + qty * 9).alias("dpi_y"),
        _color_space().alias("color_space"),
        (F.col("l_discount") * 3000).alias("tac_max"),
        (F.col("l_tax") * 1000).alias("ink_avg"),
        F.when(F.col("l_tax") != 0, F.col("l_tax") * 10).alias("min_stroke_pt"),
    ]


def images(spark, d, numbered: bool = False) -> DataFrame:
    """One image (and its page's ink readings) per line item; ``page_no`` only when numbered."""
    if not numbered:
        return table(spark, d, "lineitem").select(*_image_columns())
    return numbered_lines(spark, d).select(F.col("pos").alias("page_no"), *_image_columns())


def fonts(spark, d) -> DataFrame:
    """One font use per line item; ``pos`` orders the uses of a document, without numbering them."""
    lines = table(spark, d, "lineitem")
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    if tasks(lines):  # if the planner sorts both sides for the join, it follows this number
        part = dealt(part, lines, "p_partkey")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("doc_id"),
        F.struct(*LINE_ORDER).alias("pos"),
        F.col("p_brand").alias("name"),
        (F.col("l_linestatus") == "F").alias("embedded"),
        (F.col("l_returnflag") == "N").alias("subset"),
        F.when(F.col("p_size") % 7 == 0, "Type3").otherwise("TrueType").alias("font_type"),
        (F.col("p_size") % 5 == 0).alias("missing_widths"),
    )


def boxes(spark, d, numbered: bool = False) -> DataFrame:
    """Page boxes as arrays [left, bottom, right, top] on a 595 x 842 page; null when absent."""
    lines = numbered_lines(spark, d) if numbered else table(spark, d, "lineitem")
    bleed = F.lit(10.0) - F.col("l_discount") * 200

    def box(offset):
        return F.array(offset, offset, F.lit(595.0) - offset, F.lit(842.0) - offset)

    return lines.select(
        F.col("l_orderkey").alias("doc_id"),
        *([F.col("pos").alias("page_no")] if numbered else []),
        F.lit(595.0).alias("width"),
        F.lit(842.0).alias("height"),
        box(F.lit(0.0)).alias("media"),
        F.lit(None).cast("array<double>").alias("crop"),
        F.when(F.col("l_tax") != 0, box(F.lit(10.0))).alias("trim"),
        F.when(F.col("l_discount") != 0, box(bleed)).alias("bleed"),
        F.lit(None).cast("array<double>").alias("art"),
    )


def inks(spark, d, numbered: bool = False) -> DataFrame:
    lines = numbered_lines(spark, d) if numbered else table(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    c, m, y = F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50
    return lines.select(
        F.col("l_orderkey").alias("doc_id"),
        *([F.col("pos").alias("page_no")] if numbered else []),
        F.when(flag == "A", "rgb").when(flag == "N", "cmyk").otherwise("spot").alias("space"),
        c.alias("c"),
        m.alias("m"),
        y.alias("y"),
        F.when(F.col("l_linestatus") == "O", 0.7).otherwise(0.2).alias("k"),
        c.alias("r"),
        m.alias("g"),
        y.alias("b"),
        c.alias("gray"),
        F.when(F.col("l_suppkey") % 3 == 0, "All")
        .otherwise(F.concat(F.lit("PANTONE "), (F.col("l_suppkey") % 9).cast("string")))
        .alias("spot"),
        y.alias("pct"),
    )


# ---- codes and the reference table ----


def _gtin13():
    number = F.lit(789000000000) + F.col("p_partkey") * 37
    # Digits by arithmetic: a quotient of numbers below 10^15 never rounds up to a whole number.
    weighted = sum(F.floor(number / 10 ** (12 - i)) % 10 * (1 if i % 2 else 3) for i in range(1, 13))
    right = (F.lit(10) - weighted % 10) % 10
    return F.concat(number.cast("string"), ((right + F.col("p_partkey") % 2) % 10).cast("string"))


def codes(spark, d) -> DataFrame:
    """One GTIN-13 per part, four parts to a document; odd parts carry a wrong check digit."""
    return spread(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")).select(
        F.floor(F.col("p_partkey") / 4).alias("doc_id"),
        F.col("p_partkey").alias("code_no"),
        (F.col("p_partkey") % 7 + 1).alias("page_no"),
        F.when(F.col("p_size") % 4 == 0, "QR_CODE")
        .when(F.col("p_size") % 4 == 1, "CODE_128")
        .otherwise("EAN_13")
        .alias("format"),
        _gtin13().alias("text"),
        (F.col("p_size") * 10.0).alias("x"),
        (F.col("p_retailprice") / 2).alias("y"),
    )


def reference_rows(spark, d) -> DataFrame:
    """Reference table as (row_no, cells): a header row, then gtin, name, brand by part number."""
    header = spark.range(1).select(
        F.lit(0).cast("bigint").alias("row_no"),
        F.array(F.lit("gtin"), F.lit("name"), F.lit("brand")).alias("cells"),
    )
    rows = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand")).select(
        (F.col("p_partkey") + 1).alias("row_no"),
        F.array(
            _gtin13(),
            F.concat_ws(" ", F.col("p_name"), F.col("p_partkey").cast("string")),
            F.col("p_brand"),
        ).alias("cells"),
    )
    return union_all(header, rows)


# ---- text pages, versions, conversations, web metadata ----


def text_pages(spark, d) -> DataFrame:
    """Each line of a document is a page."""
    return documents(spark, d).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")
    ).select("doc_id", (F.col("line") + 1).cast("bigint").alias("page_no"), "text")


def version_two(spark, d) -> DataFrame:
    """Second version of :func:`text_pages`: pages dropped, reworded and inserted by a fixed rule.

    New page numbers are positions in the edited page array, so no window is needed.
    """
    lines = F.split("text", "\n")

    def edited(line, i):
        key = F.col("doc_id") + i + 1
        space = F.instr(line, " ")
        tail = F.when(space == 0, F.lit("")).otherwise(F.substr(line, space))
        reworded = F.when(key % 7 == 0, F.concat(F.lit("CHANGED"), tail)).otherwise(line)
        inserted = F.concat(F.lit("INSERTED PAGE "), (i + 1).cast("string"))
        none = F.array().cast("array<string>")
        return F.concat(
            F.when(key % 11 != 0, F.array(reworded)).otherwise(none),
            F.when(key % 13 == 0, F.array(inserted)).otherwise(none),
        )

    return documents(spark, d).select(
        "doc_id", F.posexplode(F.flatten(F.transform(lines, edited))).alias("line", "text")
    ).select("doc_id", (F.col("line") + 1).cast("bigint").alias("page_no"), "text")


def conversation_pages(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "text"
    )


def web_meta(spark, d) -> DataFrame:
    """Metadata triples (doc_id, pos, key, value) of web pages."""
    html = F.col("html")
    pairs = F.array(
        F.struct(F.lit("Title").alias("key"), F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("value")),
        F.struct(F.lit("Lang").alias("key"), F.regexp_extract(html, 'lang="([^"]*)"', 1).alias("value")),
        F.struct(F.lit("Charset").alias("key"), F.regexp_extract(html, 'charset="([^"]*)"', 1).alias("value")),
        F.struct(F.lit("Keywords").alias("key"), F.lit("").alias("value")),
    )
    return table(spark, d, "pages").select(
        F.col("page_id").alias("doc_id"), F.posexplode(pairs).alias("pos", "pair")
    ).select("doc_id", "pos", "pair.key", "pair.value")


def glossary(spark, d) -> DataFrame:
    """Two-word terms taken from the benchmark texts, numbered by item."""
    words = F.split(F.regexp_replace("text", "[\r\n]", ""), " ")
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("term_no"), F.array_join(F.slice(words, 1, 2), " ").alias("term")
    )


# ---- rasters ----


def rasters(spark, d) -> DataFrame:
    """Embeddings as 8 x 8 grey rasters: one row per raster, row-major ``px ARRAY<INT>``."""
    grey = F.transform(
        "embedding",
        lambda e: F.least(
            F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.5) * 255).cast("int"))
        ),
    )
    return spread(table(spark, d, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("page_id"), F.lit(8).alias("w"), F.lit(8).alias("h"), grey.alias("px")
    )


def color_rasters(spark, d) -> DataFrame:
    """Grey rasters turned into colour: (v, 255 - v, v of the next element, wrapping)."""

    def colored(px):
        return F.transform(
            px,
            lambda v, i: F.struct(v.alias("r"), (F.lit(MAX_PIXEL) - v).alias("g"), F.get(px, (i + 1) % 64).alias("b")),
        )

    return rasters(spark, d).select("page_id", "w", "h", let(F.col("px"), colored).alias("px"))


SCAN_WIDTH = 96


def text_scans(spark, d) -> DataFrame:
    """Texts as colour pages, (page, side, page_w, page_h, planes): a pixel for each byte, white to the end of the last row.

    The new version, side 1, is moved right and down by a few pixels, and some of its pixels are inverted.
    """

    def rows(batches):
        values = np.arange(256, dtype=np.int64)
        ink = np.stack([values * k % 256 for k in (7, 13, 29)]).astype(np.uint8)
        for batch in batches:
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.empty(0, np.uint8)
                w, h, doc = SCAN_WIDTH, -(-len(data) // SCAN_WIDTH), batch.column("page")[i].as_py()["doc_id"]
                old = np.full((3, w * h), MAX_PIXEL, np.uint8)
                old[:, : len(data)] = ink[:, data]
                old = old.reshape(3, h, w)
                new, dx, dy = np.full_like(old, MAX_PIXEL), 2 * (doc % 4), 2 * (doc // 4 % 3)
                new[:, dy:, dx:] = old[:, : max(h - dy, 0), : w - dx]
                inverted = ((np.arange(w) * 31)[None, :] + (np.arange(h) * 17)[:, None] + doc) % 97 == 0
                np.subtract(MAX_PIXEL, new, out=new, where=inverted)
                for side, page in enumerate((old, new)):
                    yield batch.column("page").slice(i, 1), side, w, h, page.tobytes()

    def run(batches):
        return gathered(rows(batches), {"side": pa.int32(), "page_w": pa.int32(), "page_h": pa.int32(), "planes": pa.binary()})

    pages = documents(spark, d).select(F.struct("doc_id").alias("page"), "text")
    return pages.mapInArrow(run, "page struct<doc_id: bigint>, side int, page_w int, page_h int, planes binary")


# ---- arrivals and the object graph ----


def arrivals(spark, d) -> DataFrame:
    """Events as file arrivals: path, content hash, exit code, in arrival order ``seq``."""
    return as_arrivals(table(spark, d, "events"))


def as_arrivals(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("path"),
        F.sha2(F.floor("value").cast("string"), 256).alias("sha256"),
        F.when(kind == "error", 2).when(kind == "purchase", 1).otherwise(0).cast("bigint").alias("exit"),
        F.col("ts"),
    )


def edges(spark, d) -> DataFrame:
    """Reference graph region -> nation -> customer -> order as (src, dst) node names."""

    def node(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    nation = table(spark, d, "nation").select(node("r", "n_regionkey").alias("src"), node("n", "n_nationkey").alias("dst"))
    customer = table(spark, d, "customer").select(node("n", "c_nationkey").alias("src"), node("c", "c_custkey").alias("dst"))
    order = table(spark, d, "orders").select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst"))
    return union_all(nation, customer, order)


def nodes(spark, d) -> DataFrame:
    """Every object of the graph with a kind and a size."""

    def listed(name, prefix, key, kind, size):
        return table(spark, d, name).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node"),
            F.col(key).cast("bigint").alias("obj_id"),
            F.lit(kind).alias("kind"),
            size.cast("bigint").alias("size"),
        )

    return union_all(
        listed("region", "r", "r_regionkey", "Catalog", F.length("r_name")),
        listed("nation", "n", "n_nationkey", "XRef", F.length("n_name")),
        listed("customer", "c", "c_custkey", "Font", F.length("c_name")),
        listed("orders", "o", "o_orderkey", "Stream/Image", F.floor("o_totalprice")),
    )
