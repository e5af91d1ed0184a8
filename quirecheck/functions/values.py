"""Script-value semantics as Column expressions: truth, arithmetic, equality, lists, units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Points per unit. A percentage keeps its number.
POINTS = {"pt": 1.0, "mm": 72 / 25.4, "cm": 720 / 25.4, "in": 72.0, "%": 1.0}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression named inside a lambda is evaluated again for every element, and the optimizer may
    move a column's definition into the lambda that uses it. A lambda variable is only read.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def truthy(c: Column, boolean: bool = True) -> Column:
    """Only null and false are falsy: any number, string or list counts as true."""
    return F.coalesce(c, F.lit(False)) if boolean else c.isNotNull()


def logical_and(left: Column, right: Column, boolean: bool = True) -> Column:
    """The right operand when the left is truthy, otherwise the left one itself."""
    return F.when(truthy(left, boolean), right).otherwise(left)


def logical_or(left: Column, right: Column, boolean: bool = True) -> Column:
    return F.when(truthy(left, boolean), left).otherwise(right)


def divide(a: Column, b: Column) -> Column:
    """Quotient as a double, null for a zero divisor (see :func:`divide_error`)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def divide_exact(a: Column, b: Column) -> Column:
    """The integer quotient when two integers divide exactly, else null."""
    return F.when((b != 0) & (F.try_mod(a, b) == 0), F.floor(F.try_divide(a, b)).cast("bigint"))


def divide_error(b: Column) -> Column:
    return F.when(b == 0, F.lit("division by zero"))


def half_away(c: Column) -> Column:
    """Round to an integer, halves away from zero."""
    return (F.signum(c) * F.floor(F.abs(c) + 0.5)).cast("bigint")


def rounded(c: Column, places: int) -> Column:
    """Binary rounding ``round(v * 10^p) / 10^p``, halves away from zero."""
    scale = 10.0**places
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale


def list_get(items: Column, n: int) -> Column:
    """The 1-based ``n``-th item; out of range is null here and a message in ``list_get_error``."""
    return F.try_element_at(items, F.lit(n)) if n >= 1 else F.lit(None)


def list_get_error(items: Column, n: int) -> Column:
    message = F.concat(
        F.lit(f"item {n} does not exist (the list has "), F.size(items).cast("string"), F.lit(")")
    )
    return F.when((F.lit(n) < 1) | (F.size(items) < n), message)


def list_join(items: Column, separator: str = ", ") -> Column:
    """Nulls print as ``null``."""
    return F.array_join(items, separator, "null")


def to_points(c: Column) -> Column:
    """A length literal such as ``3mm`` or ``1.5in`` in points; unknown units give null."""
    shape = r"\A([0-9]+(?:\.[0-9]+)?)([a-z%]*)\z"
    number = F.regexp_extract(c, shape, 1).try_cast("double")
    unit = F.regexp_extract(c, shape, 2)
    factor = F.when(unit == "", 1.0)
    for name, points in POINTS.items():
        factor = factor.when(unit == name, points)
    return number * factor


def unit_error(c: Column) -> Column:
    unit = F.regexp_extract(c, r"([A-Za-z%]*)\z", 1)
    return F.when(
        ~unit.isin("", *POINTS), F.format_string("unknown unit: '%s' (use pt, mm, cm, in or %%)", unit)
    )
