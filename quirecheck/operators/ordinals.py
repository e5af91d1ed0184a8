"""Row numbers within groups that may be far too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

SPAN = 100_000


def ordinal(df: DataFrame, keys: list[str], order: str, out: str, span: int = SPAN) -> DataFrame:
    """1-based position of each row within ``keys`` by the integer column ``order``.

    A group is cut into spans of ``order`` values that are numbered apart; a span starts after the
    rows of the spans before it. Those counts are one row per span, and only spans after the
    first one carry an offset, so ordinary groups join nothing.
    """
    cut = df.withColumn("_span", F.floor(F.col(order) / span))
    before = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_span")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.sum("_n").over(before))
        .filter("_offset > 0")
        .drop("_n")
    )
    local = cut.withColumn("_row", F.row_number().over(W.partitionBy(*keys, "_span").orderBy(order)))
    # Null-safe, since a key such as a message may be missing.
    same = [local[k].eqNullSafe(offsets[k]) for k in [*keys, "_span"]]
    joined = local.join(offsets, same, "left").select(
        *[local[c] for c in df.columns],
        (local["_row"] + F.coalesce(offsets["_offset"], F.lit(0))).cast("bigint").alias(out),
    )
    return joined


def around(df: DataFrame, keys: list[str], order: str, before: dict[str, str], after: dict[str, str], span: int = SPAN) -> DataFrame:
    """Running extremes next to each row: ``before[out]`` is the maximum of a column over all earlier
    rows of the group, ``after[out]`` the minimum over all later ones; null where there are none.

    As in :func:`ordinal`, spans of ``order`` values are scanned apart and joined to one row per span; the result
    keeps its ``_span``, and rows that have one are not dealt again. ``order`` is unique within a group.
    """
    cut = df if "_span" in df.columns else df.withColumn("_span", F.floor(F.col(order) / span))
    spans = cut.groupBy(*keys, "_span").agg(
        *[F.max(c).alias(f"_{o}") for o, c in before.items()], *[F.min(c).alias(f"_{o}") for o, c in after.items()]
    )
    order_spans = W.partitionBy(*keys)
    # Later rows are earlier ones backwards: Spark sums up a frame that shrinks anew for each row.
    earlier = (W.unboundedPreceding, -1)
    forth, back = F.col("_span").asc(), F.col("_span").desc()
    outer = spans.select(
        *keys,
        "_span",
        F.count("*").over(W.partitionBy(*keys)).alias("_spans"),
        *[F.max(f"_{o}").over(order_spans.orderBy(forth).rowsBetween(*earlier)).alias(f"_{o}") for o in before],
        *[F.min(f"_{o}").over(order_spans.orderBy(back).rowsBetween(*earlier)).alias(f"_{o}") for o in after],
    ).filter("_spans > 1")
    inner = W.partitionBy(*keys, "_span")
    local = cut.select(
        "*",
        *[F.max(c).over(inner.orderBy(F.col(order).asc()).rowsBetween(*earlier)).alias(o) for o, c in before.items()],
        *[F.min(c).over(inner.orderBy(F.col(order).desc()).rowsBetween(*earlier)).alias(o) for o, c in after.items()],
    )
    joined = local.join(outer, [*keys, "_span"], "left")
    return joined.select(
        *cut.columns,
        *[F.greatest(o, f"_{o}").alias(o) for o in before],
        *[F.least(o, f"_{o}").alias(o) for o in after],
    )


def nth_element(df: DataFrame, order: list[str], n: int, what: str) -> DataFrame:
    """The ``n``-th element of each document, or a message where it has fewer.

    Spark keeps only the first ``n`` rows per document before the shuffle, however many there are.
    """
    nth = (
        df.withColumn("_row", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)))
        .filter(F.col("_row") == n)
        .drop("_row")
        .withColumn("_found", F.lit(True))
    )
    total = df.groupBy("doc_id").agg(F.count("*").alias("_total"))
    missing = F.concat(
        F.lit(f"{what} {n} does not exist (found: "), F.col("_total").cast("string"), F.lit(")")
    )
    return (
        total.join(nth, "doc_id", "left")
        .withColumn("error", F.when(F.col("_found").isNull(), missing))
        .drop("_found", "_total")
    )
