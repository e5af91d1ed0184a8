"""Rectangles on a page, in points with the origin at the bottom left."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def region(x: Column, y: Column, width: Column, height: Column, name: str = "") -> Column:
    """A region, or null where its width or height is not positive."""
    made = F.struct(
        F.lit(name).alias("name"), x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height")
    )
    return F.when((width > 0) & (height > 0), made)


def right(r: Column) -> Column:
    return r["x"] + r["width"]


def top(r: Column) -> Column:
    return r["y"] + r["height"]


def area(r: Column) -> Column:
    return r["width"] * r["height"]


def contains_point(r: Column, x: Column, y: Column) -> Column:
    """Borders count as inside."""
    return x.between(r["x"], right(r)) & y.between(r["y"], top(r))


def intersects(a: Column, b: Column) -> Column:
    """Sharing only a border is not an intersection."""
    return (a["x"] < right(b)) & (b["x"] < right(a)) & (a["y"] < top(b)) & (b["y"] < top(a))


def expand(r: Column, by: Column) -> Column:
    return F.struct(
        r["name"].alias("name"),
        (r["x"] - by).alias("x"),
        (r["y"] - by).alias("y"),
        (r["width"] + by * 2).alias("width"),
        (r["height"] + by * 2).alias("height"),
    )


def inset(r: Column, by: Column) -> Column:
    """The smaller region, or null where nothing would be left (see :func:`inset_error`)."""
    left = (r["width"] - by * 2 > 0) & (r["height"] - by * 2 > 0)
    return F.when(left, expand(r, -by))


def inset_error(r: Column, by: Column) -> Column:
    message = F.concat(F.lit("an inset of "), by.cast("string"), F.lit("pt would leave the region with no area"))
    return F.when((r["width"] - by * 2 <= 0) | (r["height"] - by * 2 <= 0), message)


def coordinates(r: Column) -> Column:
    """[left, bottom, right, top]"""
    return F.array(r["x"], r["y"], right(r), top(r))
