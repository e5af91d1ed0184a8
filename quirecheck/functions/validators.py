"""Check digits, dates, phones and PDF date strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The names of the two date formats.
DAY_FIRST = "dd/mm/aaaa"
ISO = "aaaa-mm-dd"


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _digit(s: Column, i: int) -> Column:
    """The 1-based ``i``-th ASCII digit; never raises, whatever the string holds."""
    return F.ascii(F.substring(s, i, 1)) - 48


def _weighted(s: Column, weights: list[int]) -> Column:
    return sum(_digit(s, i + 1) * w for i, w in enumerate(weights))


def _not_uniform(s: Column, length: int) -> Column:
    return (F.length(s) == length) & (s != F.repeat(F.substring(s, 1, 1), length))


def cpf_valid(c: Column) -> Column:
    """Eleven digits, not all equal, with both mod-11 check digits right."""
    d = digits_of(c)

    def check(n):
        rest = _weighted(d, list(range(n + 1, 1, -1))) * 10 % 11
        return F.when(rest == 10, 0).otherwise(rest) == _digit(d, n + 1)

    return _not_uniform(d, 11) & check(9) & check(10)


def cnpj_valid(c: Column) -> Column:
    """Fourteen digits, not all equal; weights run 2..9 from the right, cyclically."""
    d = digits_of(c)

    def check(n):
        rest = _weighted(d, [2 + (n - 1 - i) % 8 for i in range(n)]) % 11
        return F.when(rest < 2, 0).otherwise(11 - rest) == _digit(d, n + 1)

    return _not_uniform(d, 14) & check(12) & check(13)


def gtin_valid(c: Column) -> Column:
    """GTIN-8/12/13/14: digits only, weights 3 and 1 alternating from the right."""
    padded = F.lpad(c, 14, "0")
    total = _weighted(padded, [3 if i % 2 == 0 else 1 for i in range(13)])
    return c.rlike(r"\A(?:[0-9]{8}|[0-9]{12,14})\z") & ((10 - total % 10) % 10 == _digit(padded, 14))


def date_valid(c: Column, date_format: str | None = None) -> Column:
    """A date that exists in the calendar. Without a format, day-first and ISO are both accepted.

    An unknown format name is a mistake in the check, so it raises while the plan is built.
    """
    if date_format not in (None, DAY_FIRST, ISO):
        raise ValueError(f"unknown date format {date_format!r} (use {DAY_FIRST} or {ISO})")
    s = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

    def exists(pattern, day, month, year):
        # A shape mismatch yields '' and then null, which the caller turns into false.
        part = {n: F.regexp_extract(s, pattern, i).try_cast("int") for i, n in ((day, "d"), (month, "m"), (year, "y"))}
        leap = (part["y"] % 4 == 0) & ((part["y"] % 100 != 0) | (part["y"] % 400 == 0))
        last = (
            F.when(part["m"] == 2, F.when(leap, 29).otherwise(28))
            .when(part["m"].isin(4, 6, 9, 11), 30)
            .otherwise(31)
        )
        ok = part["m"].between(1, 12) & (part["y"] >= 1) & part["d"].between(1, last)
        return F.coalesce(ok, F.lit(False))

    accepted = []
    if date_format in (None, DAY_FIRST):
        accepted.append(exists(r"\A([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\z", 1, 2, 3))
    if date_format in (None, ISO):
        accepted.append(exists(r"\A([0-9]{4})-([0-9]{2})-([0-9]{2})\z", 3, 2, 1))
    return accepted[0] if len(accepted) == 1 else accepted[0] | accepted[1]


def phone_valid(c: Column) -> Column:
    """Area code and eight or nine digits, with optional punctuation; ten or eleven in all."""
    s = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    shape = s.rlike(r"(?U)\A\(?\d{2}\)?\s?9?\d{4}-?\d{4}\z")
    return shape & F.length(digits_of(c)).isin(10, 11)


def pdf_date(c: Column) -> Column:
    """``D:20260802173622...`` to ``2026-08-02 17:36:22``; missing parts are 00, other text is kept."""
    s = F.regexp_replace(c, r"\AD:", "")

    def part(start):
        piece = F.substring(s, start, 2)
        return F.when(piece.rlike(r"\A[0-9]{2}\z"), piece).otherwise("00")

    stamp = F.format_string(
        "%s-%s-%s %s:%s:%s",
        F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2), part(9), part(11), part(13),
    )
    return F.when(s.rlike(r"\A[0-9]{8}"), stamp).otherwise(c)
