"""Text rules as Column expressions: normalising, splitting, language, matching, personal data."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from quirecheck.functions.distance import coded, text_distance
from quirecheck.functions.validators import cnpj_valid, cpf_valid
from quirecheck.functions.values import let

#: Texts whose lengths multiply to more are compared with bit vectors instead of cell by cell.
FEW_CELLS = 1 << 20
SPACE = r"(?U)\s+"
_EDGE = r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$"

# The stop words that decide a language. A tie goes to the language listed first.
STOP_WORDS = {
    "pt": ["de", "que", "não", "uma", "para", "com", "os", "das", "dos", "isso", "são", "é"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "with", "are"],
    "es": ["el", "la", "los", "las", "una", "por", "del", "es", "en", "y", "que", "para"],
}

# The shapes of personal data, in the order they are reported.
PII_SHAPES = {
    "CPF": r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b",
    "CNPJ": r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b",
    "E-mail": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "Phone": r"\(\d{2}\)\s*9?\d{4}-\d{4}",
}

# The date shapes masked before two versions are compared, and their marker.
DATE_SHAPES = [
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2} de [a-zç]+ de \d{4}\b",
    r"D:\d{8,14}",
]
DATE_MARKER = "<data>"


def strip(c: Column) -> Column:
    """Remove Unicode white space from both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """Collapse Unicode white space, trim, lowercase."""
    return F.lower(F.trim(F.regexp_replace(c, SPACE, " ")))


def tokens(c: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def split_words(c: Column) -> Column:
    """White-space tokens without punctuation at their edges; empty ones dropped."""
    trimmed = F.transform(F.split(c, SPACE), lambda w: F.regexp_replace(w, _EDGE, ""))
    return F.filter(trimmed, lambda w: w != "")


def count_words(c: Column) -> Column:
    return F.size(split_words(c)).cast("bigint")


def _pieces(c: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(c, separator), strip), lambda s: s != "")


def split_sentences(c: Column) -> Column:
    return _pieces(c, r"(?U)[.!?]+\s+")


def split_paragraphs(c: Column) -> Column:
    return _pieces(c, r"(?U)\n\s*\n")


def lines(c: Column) -> Column:
    """Trimmed non-blank lines."""
    return _pieces(c, "\n")


def detect_language(c: Column) -> Column:
    """pt, en, es or unknown, by the number of stop words among the lowercased words."""
    found = F.aggregate(
        split_words(F.lower(c)),
        F.struct(*[F.lit(0).alias(lang) for lang in STOP_WORDS]),
        lambda acc, w: F.struct(
            *[(acc[lang] + w.isin(stop).cast("int")).alias(lang) for lang, stop in STOP_WORDS.items()]
        ),
        lambda acc: F.when(F.greatest(*[acc[lang] for lang in STOP_WORDS]) == 0, "unknown")
        .when((acc["pt"] >= acc["en"]) & (acc["pt"] >= acc["es"]), "pt")
        .when(acc["en"] >= acc["es"], "en")
        .otherwise("es"),
    )
    return found


def contains_text(c: Column, term: Column) -> Column:
    """Containment after normalising both sides (the negation forbids the text)."""
    return F.contains(normalize(c), normalize(term))


def matches(c: Column, pattern: str) -> Column:
    """A match anywhere in the raw text, with Unicode character classes."""
    return c.rlike("(?U)" + pattern)


def matches_whole(c: Column, pattern: str) -> Column:
    return c.rlike(rf"(?U)\A(?:{pattern})\z")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, by code points; two empty strings are equal."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    long = F.char_length(a).cast("bigint") * F.char_length(b) > FEW_CELLS
    far = text_distance(F.when(long, a), F.when(long, b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.when(long, far).otherwise(F.levenshtein(a, b)) / longer)


def fuzzy_match(a: Column, b: Column) -> Column:
    return similarity(normalize(a), normalize(b))


def personal_data(c: Column) -> Column:
    """Array of (label, value): CPF and CNPJ only with right check digits, e-mails, phones."""
    checks = {"CPF": cpf_valid, "CNPJ": cnpj_valid}

    def found(label, shape):
        hits = F.regexp_extract_all(c, F.lit("(?U)" + shape), F.lit(0))
        if label in checks:
            hits = F.filter(hits, checks[label])
        return F.transform(hits, lambda v: F.struct(F.lit(label).alias("label"), v.alias("value")))

    return F.concat(*[found(label, shape) for label, shape in PII_SHAPES.items()])


#: Bytes of lines that are compared at once.
STRETCH = 4 << 20


def _in_stretches(kernel: Callable[[pa.Array, pa.Array], pa.Array]) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """``kernel`` on a few rows of two columns of lines after the other, so what it makes of them is never made of a whole batch."""

    def ends(lists: pa.Array) -> np.ndarray:
        sizes = np.r_[0, np.cumsum(pc.binary_length(lists.flatten()).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)]
        return sizes[np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        total = ends(left) + ends(right)
        parts, at = [], 0
        while at < len(left) or not parts:
            end = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + STRETCH, "right")), at + 1)
            parts.append(kernel(left.slice(at, end - at), right.slice(at, end - at)))
            at = end
        return pa.concat_arrays(parts)

    return run


def _only(left: pa.Array, right: pa.Array) -> list[tuple[pa.Array, np.ndarray]]:
    """Lines that the other side of their row lacks, copies kept, and their rows: of the left, then of the right side.

    A line and its row are one number, looked up among those of the other side, for a whole batch at once.
    """
    x, x_at, y, y_at = coded(left, right)
    kinds = int(max(x.max(initial=0), y.max(initial=0))) + 2
    x_row, y_row = (np.repeat(np.arange(len(at) - 1), np.diff(at)) for at in (x_at, y_at))
    x_key, y_key = x_row * kinds + x + 1, y_row * kinds + y + 1
    gone = np.flatnonzero(~np.isin(x_key, y_key))
    new = np.flatnonzero(~np.isin(y_key, x_key))
    return [(left.flatten().take(pa.array(gone)), x_row[gone]), (right.flatten().take(pa.array(new)), y_row[new])]


def _both(left: pa.Array, right: pa.Array) -> pa.Array:
    return pc.and_(left.is_valid(), right.is_valid())


def _dealt(rows: np.ndarray, values: pa.Array, known: pa.Array) -> pa.Array:
    """``values`` as one list per row, the rows in order; null where a row is not known."""
    ends = np.searchsorted(rows, np.arange(len(known) + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pc.invert(known))


def line_diff(a: Column, b: Column) -> Column:
    """Lines of ``a`` missing from ``b`` as ``-line``, then the reverse as ``+line``; copies kept. Null where a text is null."""

    def changed(left: pa.Array, right: pa.Array) -> pa.Array:
        known = _both(left, right)
        left, right = pc.if_else(known, left, None), pc.if_else(known, right, None)
        (gone, gone_row), (new, new_row) = _only(left, right)
        rows = np.concatenate([gone_row, new_row])
        order = np.argsort(rows, kind="stable")
        marked = pa.concat_arrays([pc.binary_join_element_wise("-", gone, ""), pc.binary_join_element_wise("+", new, "")])
        return _dealt(rows[order], marked.take(pa.array(order)), known)

    return F.arrow_udf(_in_stretches(changed), "array<string>")(lines(a), lines(b))


def diff_sample(a: Column, b: Column, limit: int = 3) -> Column:
    """The first lines that changed, at most ``limit`` from each side, each after `` | ``. Null where a text is null."""

    def sample(left: pa.Array, right: pa.Array) -> pa.Array:
        known = _both(left, right)
        left, right = pc.if_else(known, left, None), pc.if_else(known, right, None)
        sides = []
        for (found, rows), sign in zip(_only(left, right), (" | -", " | +")):
            first = np.flatnonzero(np.arange(len(rows)) - np.searchsorted(rows, rows) < limit)
            marked = pc.binary_join_element_wise(sign, found.take(pa.array(first)), "")
            sides.append(pc.binary_join(_dealt(rows[first], marked, known), ""))
        return pc.binary_join_element_wise(*sides, "")

    return F.arrow_udf(_in_stretches(sample), "string")(lines(a), lines(b))


def mask_dates(c: Column) -> Column:
    for shape in DATE_SHAPES:
        c = F.regexp_replace(c, "(?U)" + shape, DATE_MARKER)
    return c


def prepare(c: Column, ignore_dates: bool = False, normalized: bool = False) -> Column:
    """Text of a page as two versions are compared."""
    if ignore_dates:
        c = mask_dates(c)
    return normalize(c) if normalized else c
