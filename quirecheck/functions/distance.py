"""Edit distance of long sequences: bit vectors along a diagonal band that widens until it holds the answer."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Half the width of the first band; each further band is four times as wide.
FIRST_BAND = 64
#: From so many symbols of one kind in a band on, their bits are packed at once.
PACKED = 12


class _Places:
    """Where each symbol of a sequence stands, as bits of a window of it."""

    def __init__(self, symbols: np.ndarray):
        order = np.argsort(symbols, kind="stable")
        kinds, starts = np.unique(symbols[order], return_index=True)
        self.places = dict(zip(kinds.tolist(), np.split(order, starts[1:])))
        self.lists = {}

    def window(self, symbol: int, start: int, width: int) -> int:
        """Bit t stands for place ``start + t``."""
        places = self.lists.get(symbol)
        if places is None:
            if symbol not in self.places:
                return 0
            places = self.lists[symbol] = self.places[symbol].tolist()
        low, high = bisect_left(places, start), bisect_left(places, start + width)
        if high - low < PACKED:
            bits = 0
            for p in places[low:high]:
                bits |= 1 << (p - start)
            return bits
        flags = np.zeros(width, dtype=np.uint8)
        flags[self.places[symbol][low:high] - start] = 1
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _banded(places: _Places, m: int, text: list[int], k: int) -> int:
    """Distance if it is at most ``k``, else any number above ``k``; the pattern of ``m`` symbols is not shorter than ``text``.

    In column j the window holds the rows j - k to j + k, the lowest row in the highest bit. ``up`` and
    ``down`` say where a cell exceeds the cell above it by one or falls short of it. The distance is followed
    along the lowest diagonal to the last row, and then along that row.
    """
    n, width = len(text), 2 * k + 1
    every, last = (1 << width) - 1, 1 << (width - 1)
    up, down = every ^ ((1 << k) - 1), 0
    distance, diagonal = k, m - k
    for column, symbol in enumerate(text, 1):
        equal = places.window(symbol, column - k - 1, width)
        # Cells that equal their neighbour one up and one left.
        same = ((((equal & up) + up) ^ up) | equal | down) & every
        right_up = down | (every & ~(same | up))
        right_down = same & up
        if column <= diagonal:
            distance += not same & last
        else:
            row = last >> (column - diagonal)
            distance += bool(right_up & row) - bool(right_down & row)
        if distance > k + n - max(column, diagonal):
            return distance
        shifted = same >> 1
        up = right_down | (every & ~(shifted | right_up))
        down = shifted & right_up
    return distance


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """Insertions, deletions and replacements that turn ``a`` into ``b`` (arrays of whole numbers).

    What both ends have in common is cut off. The rest takes time in proportion to its length times the
    distance divided by a machine word, and memory in proportion to its length.
    """
    size = min(len(a), len(b))
    differs = a[:size] != b[:size]
    head = int(differs.argmax()) if differs.any() else size
    a, b, size = a[head:], b[head:], size - head
    differs = a[len(a) - size :][::-1] != b[len(b) - size :][::-1]
    tail = int(differs.argmax()) if differs.any() else size
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    places, text, m = _Places(a), b.tolist(), len(a)
    k = min(m, max(FIRST_BAND, m - len(b)))
    while True:
        found = _banded(places, m, text, k)
        if found <= k:
            return found
        k = min(m, 4 * k)


def _rows(c: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All elements of a list column and where each row's begin; null rows are empty."""
    return c.flatten(), np.concatenate([[0], np.cumsum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def coded(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements of two list columns as numbers, equal where the elements are, and the bounds of their rows."""
    (x, x_at), (y, y_at) = _rows(left), _rows(right)
    codes = pa.concat_arrays([x, y]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return codes[: len(x)], x_at, codes[len(x) :], y_at


def list_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of strings, element by element; null where an array is null."""

    def found(left: pa.Array, right: pa.Array) -> pa.Array:
        x, x_at, y, y_at = coded(left, right)
        known = left.is_valid().to_numpy(zero_copy_only=False) & right.is_valid().to_numpy(zero_copy_only=False)
        rows = [distance(x[x_at[r] : x_at[r + 1]], y[y_at[r] : y_at[r + 1]]) if known[r] else None for r in range(len(known))]
        return pa.array(rows, pa.int64())

    return F.arrow_udf(found, "bigint")(a, b)


def text_distance(a: Column, b: Column) -> Column:
    """Edit distance of two texts by code points; null where a text is null."""

    def found(left: pa.Array, right: pa.Array) -> pa.Array:
        points = lambda s: np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)
        rows = zip(left.to_pylist(), right.to_pylist())
        return pa.array([None if x is None or y is None else distance(points(x), points(y)) for x, y in rows], pa.int64())

    return F.arrow_udf(found, "bigint")(a, b)
