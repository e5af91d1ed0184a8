"""Barcodes and QR codes of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quirecheck.functions.text import matches

CHUNK = 1000


def code_counts() -> dict[str, tuple[Column, object]]:
    """Aggregates for :func:`quirecheck.operators.layout.verdicts`."""
    return {
        "has_codes": (F.lit(True), False),
        "has_qr": (F.bool_or(F.col("format") == "QR_CODE"), False),
        "codes": (F.count("*"), 0),
        "has_code128": (F.bool_or(F.col("format") == "CODE_128"), False),
    }


def all_match(pattern: str) -> Column:
    """Every code matches the pattern somewhere; with no code at all the verdict is false."""
    return F.bool_and(matches(F.col("text"), pattern))


def all_inside(x0: float, y0: float, x1: float, y1: float) -> Column:
    return F.bool_and(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def codes_in_text(codes: DataFrame, docs: DataFrame) -> DataFrame:
    """Does every code of a document occur in its raw text? False for a document without codes.

    Codes travel in chunks, so a text meets its codes once per chunk and no chunk is unbounded.
    """
    chunks = codes.groupBy("doc_id", F.floor(F.col("code_no") / CHUNK).alias("chunk")).agg(
        F.collect_set("text").alias("codes")
    )
    checked = docs.select("doc_id", "text").join(chunks, "doc_id", "left").select(
        "doc_id",
        F.coalesce(F.forall("codes", lambda c: F.contains(F.col("text"), c)), F.lit(False)).alias("ok"),
    )
    return checked.groupBy("doc_id").agg(F.bool_and("ok").alias("ok"))
