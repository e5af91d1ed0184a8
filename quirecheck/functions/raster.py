"""Raster arithmetic as Column expressions.

A raster is one row: width ``w``, height ``h`` and row-major ``px``, an array of grey values 0..255
(or of structs r, g, b and, if pages can be transparent, a). One page is one value, so no operator
explodes pixels or shuffles them. Arithmetic over pixels runs on Arrow batches: each function looks at
the values of a page in place, as vectors. A null raster gives null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from quirecheck.functions.values import let, rounded

# The stabilisers of the similarity index, (0.01 * 255)^2 and (0.03 * 255)^2.
C1, C2 = 6.5025, 58.5225
# The longest distance of two colours, weights of luminance, and the luminance that still counts as equal.
LONGEST_RGB = 441.67
WEIGHTS = {"r": 0.299, "g": 0.587, "b": 0.114}
SAME_WEIGHT = 8.0
#: Classes of a pixel, by number.
CLASSES = ["same", "removed", "added", "recoloured"]


def _view(array: pa.Array) -> Callable[[int], object]:
    """Row i of a column: a vector of its values, a dict of vectors for structs, or the plain value."""
    if not (pa.types.is_list(array.type) or pa.types.is_large_list(array.type)):
        values = array.to_pylist()
        return values.__getitem__
    at, values, known = array.offsets.to_numpy(), array.values, array.is_valid().to_pylist()
    if pa.types.is_struct(values.type):
        fields = {f.name: values.field(f.name).to_numpy(zero_copy_only=False) for f in values.type}
        return lambda i: {k: v[at[i] : at[i + 1]] for k, v in fields.items()} if known[i] else None
    flat = values.to_numpy(zero_copy_only=False)
    return lambda i: flat[at[i] : at[i + 1]] if known[i] else None


ARROW = {"integer": pa.int32(), "byte": pa.int8(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _per_raster(kernel: Callable, returns: str, *columns: Column | int) -> Column:
    """``kernel`` of each row's values, null where one of them is null."""
    kind = T.DataType.fromDDL(returns)

    def run(*arrays: pa.Array) -> pa.Array:
        views = [_view(a) for a in arrays]
        rows = ([v(i) for v in views] for i in range(len(arrays[0])))
        found = [None if any(x is None for x in row) else kernel(*row) for row in rows]
        if isinstance(kind, T.ArrayType):
            sizes = [0 if x is None else len(x) for x in found]
            flat = np.concatenate([x for x in found if x is not None] or [np.empty(0)])
            inner = ARROW[kind.elementType.typeName()]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.astype(inner.to_pandas_dtype())))
            absent = pa.array([x is None for x in found])
            return pa.ListArray.from_arrays(lists.offsets, lists.values, mask=absent) if absent.true_count else lists
        return pa.array(found, ARROW.get(kind.typeName()))

    return F.arrow_udf(run, kind)(*[F.lit(c) if isinstance(c, int) else c for c in columns])


def grid(count: Column) -> Column:
    """0 .. count - 1"""
    return F.sequence(F.lit(0), count - 1)


def _div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("int")


def _sample(p: np.ndarray, w: int, h: int, to_w: int, to_h: int) -> np.ndarray:
    y, x = np.arange(to_h) * h // to_h, np.arange(to_w) * w // to_w
    return p[y[:, None] * w + x[None, :]].ravel()


def resize(px: Column, w: Column, h: Column, new_w: Column, new_h: Column) -> Column:
    """Nearest neighbour: target x takes source ``x * w div new_w``."""
    return _per_raster(_sample, "array<int>", px, w, h, new_w, new_h)


def _sampled(kernel: Callable, side: int | None) -> Callable:
    """``kernel(p, w, h)`` of a sample of ``side`` x ``side``, one raster at a time, so no batch of enlarged rasters is held."""
    return kernel if side is None else lambda p, w, h: kernel(_sample(p, w, h, side, side), side, side)


def ssim(a: Column, b: Column) -> Column:
    """Global structural similarity of two rasters of one size; the sums are exact integers."""

    def index(p, q):
        n = min(len(p), len(q))
        if not n:
            return 1.0
        x, y = p[:n].astype(np.int64), q[:n].astype(np.int64)
        sum_a, sum_b, aa, bb, ab = (int(v) for v in (x.sum(), y.sum(), x @ x, y @ y, x @ y))
        mean_a, mean_b, square = sum_a / n, sum_b / n, float(n * n)
        var_a, var_b, cov = (n * aa - sum_a * sum_a) / square, (n * bb - sum_b * sum_b) / square, (n * ab - sum_a * sum_b) / square
        return ((mean_a * mean_b * 2 + C1) * (cov * 2 + C2)) / ((mean_a * mean_a + mean_b * mean_b + C1) * (var_a + var_b + C2))

    return _per_raster(index, "double", a, b)


def pixel_diff(a: Column, b: Column, tolerance: int = 10) -> Column:
    """Share (0..1) of pixels whose grey values differ by more than the tolerance."""

    def share(p, q):
        n = min(len(p), len(q))
        return float((np.abs(p[:n] - q[:n]) > tolerance).sum() / n) if n else 0.0

    return _per_raster(share, "double", a, b)


# ---- perceptual hash ----

SIDE, LOW = 32, 8
#: cos((2x + 1) u pi / 64) for the eight lowest frequencies u.
COSINES = np.array([[math.cos((2 * x + 1) * u * math.pi / (2 * SIDE)) for x in range(SIDE)] for u in range(LOW)])


def low_frequencies(px: Column, w: Column, h: Column) -> Column:
    """The low 8 x 8 block of the cosine transform of a 32 x 32 sample; index v * 8 + u.

    Values are rounded to 1e-6, so bits do not depend on the order of floating-point sums.
    """

    def block(p, w, h):
        return np.round((COSINES @ p.reshape(h, w).astype(np.float64) @ COSINES.T).ravel(), 6)

    return _per_raster(_sampled(block, SIDE), "array<double>", px, w, h)


def hash_bits(block: Column) -> Column:
    """Bit i is set where block value i exceeds the median of the values after the first."""

    def bits(values):
        median = np.sort(values[1:])[(LOW * LOW - 1) // 2]
        return int(np.packbits(values > median, bitorder="little").view("<i8")[0])

    return _per_raster(bits, "bigint", block)


def hash_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


# ---- quality ----


def blockiness(px: Column, w: Column, h: Column, side: int | None = None) -> Column:
    """Mean step across 8-pixel block borders over the mean step elsewhere, of the raster or of a ``side`` x ``side`` sample."""

    def ratio(p, w, h):
        if w < 16 or h < 16:
            return 1.0
        steps = np.abs(np.diff(p.reshape(h, w), axis=1)).sum(0, dtype=np.int64)
        border = np.arange(1, w) % 8 == 0
        borders = (w - 1) // 8 * h
        on, off = int(steps[border].sum()) / borders, int(steps[~border].sum()) / ((w - 1) * h - borders)
        return 1.0 if on < 0.01 else on / max(off, 0.05)

    return _per_raster(_sampled(ratio, side), "double", px, w, h)


def quality(block: Column) -> Column:
    """0..100: blocking is penalised."""
    score = 100 - F.greatest(block - 1, F.lit(0.0)) * 60
    return rounded(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), 3)


def is_posterized(px: Column) -> Column:
    """A wide range of values of which few occur."""
    return _per_raster(lambda p: bool(len(p)) and bool(int(p.max()) - int(p.min()) > 60 and len(np.unique(p)) < 24), "boolean", px)


def line_is_banded(line: np.ndarray) -> bool:
    """A gradient in few wide steps: regular jumps of at least 4, most in one direction."""
    steps = np.diff(line.astype(np.int64))
    places = np.flatnonzero(steps)
    if not 4 <= len(places) <= len(line) // 8:
        return False
    jumps = places[np.abs(steps[places]) >= 4]
    if len(jumps) < 3:
        return False
    up = int((steps[jumps] > 0).sum())
    return max(up, len(jumps) - up) * 5 >= len(jumps) * 4 and (jumps[-1] - jumps[0]) / (len(jumps) - 1) >= 4


def is_banded(px: Column, w: Column, h: Column, side: int | None = None) -> Column:
    """At least three suspicious lines among sampled columns and rows of the middle half, or of that of a ``side`` x ``side`` sample."""

    def banded(p, w, h):
        if w < 32 or h < 32:
            return False
        page = p.reshape(h, w)
        columns = (page[:, x] for x in range(w // 4, w * 3 // 4, max(w // 16, 1)))
        rows = (page[y] for y in range(h // 4, h * 3 // 4, max(h // 16, 1)))
        return sum(line_is_banded(x) for x in (*columns, *rows)) >= 3

    return _per_raster(_sampled(banded, side), "boolean", px, w, h)


# ---- colour comparison ----


def _on_white(p: dict, c: str) -> np.ndarray:
    """A colour plane as it looks on white paper."""
    plane = p[c].astype(np.float64)
    if "a" not in p:
        return plane
    alpha = p["a"] / 255.0
    return plane * alpha + 255.0 * (1.0 - alpha)


def _luminance(p: dict) -> np.ndarray:
    light = p["r"] * WEIGHTS["r"] + p["g"] * WEIGHTS["g"] + p["b"] * WEIGHTS["b"]
    return light if "a" not in p else light * (p["a"] / 255.0) + 255.0 * (1.0 - p["a"] / 255.0)


def to_grey(px: Column) -> Column:
    """Luminance of colour pixels, truncated to an integer."""
    return _per_raster(_luminance, "array<int>", px)


def _canvas(plane: np.ndarray, w: int, h: int, width: int, height: int, dx: int = 0, dy: int = 0) -> np.ndarray:
    """A page of w x h on a white canvas, moved by (dx, dy); what leaves the canvas is cut off."""
    out = np.full((height, width), 255.0)
    x0, y0, x1, y1 = max(dx, 0), max(dy, 0), min(w + dx, width), min(h + dy, height)
    if x0 < x1 and y0 < y1:
        out[y0:y1, x0:x1] = plane.reshape(h, w)[y0 - dy : y1 - dy, x0 - dx : x1 - dx]
    return out.ravel()


def _classes(p: dict, w_a: int, h_a: int, q: dict, w_b: int, h_b: int, threshold: float, dx: int, dy: int) -> np.ndarray:
    width, height = max(w_a, w_b), max(h_a, h_b)

    def pair(plane):
        return _canvas(plane(p), w_a, h_a, width, height), _canvas(plane(q), w_b, h_b, width, height, dx, dy)

    square = 0.0
    for c in "rgb":
        one, other = pair(lambda page, c=c: _on_white(page, c))
        square = square + (one - other) * (one - other)
    distance = np.sqrt(square) / LONGEST_RGB
    one, other = pair(_luminance)
    lighter = other - one
    kind = np.where(np.abs(lighter) <= SAME_WEIGHT, 3, np.where(lighter > 0, 1, 2))
    return np.where(distance <= threshold, 0, kind).astype(np.int8)


def changes(
    a: Column, w_a: Column, h_a: Column, b: Column, w_b: Column, h_b: Column, threshold: float = 0.05,
    dx: Column | int = 0, dy: Column | int = 0,
) -> Column:
    """Class (a number, see CLASSES) of every pixel of the union canvas; outside a page is white. ``b`` is moved by (dx, dy)."""
    kernel = lambda p, w, h, q, v, u, x, y: _classes(p, w, h, q, v, u, threshold, x, y)
    return _per_raster(kernel, "array<tinyint>", a, w_a, h_a, b, w_b, h_b, dx, dy)


def class_name(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, CLASSES)), number.cast("int"))


def diff_percent(classes: Column) -> Column:
    return _per_raster(lambda c: float(np.count_nonzero(c) / len(c) * 100) if len(c) else None, "double", classes)


def _blocks(classes: np.ndarray, width: int, block: int) -> np.ndarray:
    i = np.flatnonzero(classes)
    return np.unique(i // width // block * (-(-width // block)) + i % width // block)


def changed_blocks(classes: Column, width: Column, block: int = 32) -> Column:
    """Distinct block numbers (by row, then column) that hold a changed pixel."""
    return _per_raster(lambda c, w: _blocks(c, w, block), "array<int>", classes, width)


def block_region(number: Column, width: Column, height: Column, block: int = 32) -> Column:
    """The box of a block, clipped at the page edge."""
    across = _div(width + (block - 1), block)
    x, y = (number % across) * block, _div(number, across) * block
    return F.struct(
        x.alias("x"),
        y.alias("y"),
        (F.least(x + block, width) - x).alias("width"),
        (F.least(y + block, height) - y).alias("height"),
    )


def _box_mean(plane: np.ndarray, w: int, h: int, radius: int) -> np.ndarray:
    page = plane.reshape(h, w).astype(np.int64)
    for axis in (1, 0):
        wide = np.pad(page, [(radius, radius) if d == axis else (0, 0) for d in (0, 1)], mode="edge")
        sums = np.cumsum(wide, axis=axis)
        n = page.shape[axis]
        upper = np.take(sums, np.arange(2 * radius, 2 * radius + n), axis=axis)
        lower = np.take(sums, np.arange(n), axis=axis) - np.take(wide, np.arange(n), axis=axis)
        page = (upper - lower) // (2 * radius + 1)
    return page.ravel()


def blur(px: Column, w: Column, h: Column, radius: int) -> Column:
    """Separable box mean of one channel; edge pixels repeat, divisions truncate."""
    return _per_raster(lambda p, w, h: _box_mean(p, w, h, radius), "array<int>", px, w, h)


# ---- alignment of shifted pages ----


def _boxes(plane: np.ndarray, w: int, h: int, scale: int) -> np.ndarray:
    """h x w means of scale x scale boxes, truncated; boxes at the edge average what they have."""
    sums = np.add.reduceat(np.add.reduceat(plane.reshape(h, w).astype(np.int64), np.arange(0, h, scale), axis=0), np.arange(0, w, scale), axis=1)
    rows, columns = np.minimum(scale, h - np.arange(0, h, scale)), np.minimum(scale, w - np.arange(0, w, scale))
    return sums // (rows[:, None] * columns[None, :])


def downsample(px: Column, w: Column, h: Column, scale: int) -> Column:
    """Means of scale x scale boxes, truncated; boxes at the edge average what they have."""
    return _per_raster(lambda p, w, h: _boxes(p, w, h, scale).ravel(), "array<int>", px, w, h)


def _rough(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    return float((np.abs(a[:h, :w] - b[:h, :w]) / 255 > threshold).sum() / (h * w) * 100) if h * w else 0.0


def rough_diff(a: Column, b: Column, threshold: float = 0.05) -> Column:
    """Percentage of grey values that differ by more than the threshold."""
    return _per_raster(lambda p, q: _rough(p[None, :], q[None, :], threshold), "double", a, b)


def _shift(a: np.ndarray, b: np.ndarray, centre_x: int, centre_y: int, reach: int) -> tuple[int, int]:
    best = None
    for dy in range(centre_y - reach, centre_y + reach + 1):
        for dx in range(centre_x - reach, centre_x + reach + 1):
            y0, y1 = max(0, -dy), min(a.shape[0], b.shape[0] - dy)
            x0, x1 = max(0, -dx), min(a.shape[1], b.shape[1] - dx)
            mean = math.inf
            if y0 < y1 and x0 < x1:
                mean = int(np.abs(a[y0:y1, x0:x1] - b[y0 + dy : y1 + dy, x0 + dx : x1 + dx]).sum()) / ((y1 - y0) * (x1 - x0))
            if best is None or mean < best[0]:
                best = (mean, dx, dy)
    return best[1], best[2]


def best_shift(a: Column, b: Column, w: Column, h: Column, centre_x: Column, centre_y: Column, reach: int) -> Column:
    """Struct (dx, dy): the shift around the centre with the least mean difference, first in scan order."""

    def search(p, q, w, h, x, y):
        dx, dy = _shift(p.reshape(h, w), q.reshape(h, w), x, y, reach)
        return {"dx": dx, "dy": dy}

    return _per_raster(search, "struct<dx:int,dy:int>", a, b, w, h, centre_x, centre_y)


def compare(
    a: Column, w_a: Column, h_a: Column, b: Column, w_b: Column, h_b: Column, threshold: float = 0.05, blur: int = 0, align: bool = True,
    align_above: float = 3.0, max_offset: int = 32, coarse: int = 8, fine: int = 2, block: int = 32,
) -> Column:
    """Everything about a pair of colour pages in one pass: struct (dx, dy, diff_percent, areas, width, height).

    Both pages are blurred, the second is moved to where it fits best, and each pixel is classified; null
    where a page has no pixels.
    """

    def blurred(p, w, h):
        return {c: _box_mean(v, w, h, blur) for c, v in p.items()} if blur else p

    def find(p, w_a, h_a, q, w_b, h_b):
        light = [(_luminance(x).astype(np.int64), w, h) for x, w, h in ((p, w_a, h_a), (q, w_b, h_b))]
        rough = [_boxes(*x, coarse) for x in light]
        if _rough(*rough, threshold) < align_above:
            return 0, 0
        dx, dy = _shift(*rough, 0, 0, max(max_offset // coarse, 2))
        dx, dy = _shift(*(_boxes(*x, fine) for x in light), int(dx * coarse / fine), int(dy * coarse / fine), coarse // fine)
        return -dx * fine, -dy * fine

    def run(p, w_a, h_a, q, w_b, h_b):
        if not (w_a * h_a and w_b * h_b):
            return None
        p, q = blurred(p, w_a, h_a), blurred(q, w_b, h_b)
        dx, dy = find(p, w_a, h_a, q, w_b, h_b) if align else (0, 0)
        classes = _classes(p, w_a, h_a, q, w_b, h_b, threshold, dx, dy)
        width, height = max(w_a, w_b), max(h_a, h_b)
        return {"dx": dx, "dy": dy, "diff_percent": float(np.count_nonzero(classes) / len(classes) * 100), "areas": len(_blocks(classes, width, block)), "width": width, "height": height}

    return _per_raster(run, "struct<dx:int,dy:int,diff_percent:double,areas:int,width:int,height:int>", a, w_a, h_a, b, w_b, h_b)


# ---- ink estimates ----


def _tac(p: dict) -> np.ndarray:
    r, g, b = (p[c] / 255 for c in "rgb")
    black = 1 - np.maximum(np.maximum(r, g), b)
    with np.errstate(divide="ignore", invalid="ignore"):
        inks = [(1 - c - black) / (1 - black) for c in (r, g, b)]
        return np.where(black >= 1, 100.0, (inks[0] + inks[1] + inks[2] + black) * 100)


def tac_of_pixels(px: Column) -> Column:
    """Total ink (%) of every colour pixel."""
    return _per_raster(_tac, "array<double>", px)


def highest_tac(px: Column) -> Column:
    """Highest total ink (%) of colour pixels; null where there are none."""
    return _per_raster(lambda p: float(_tac(p).max()) if len(p["r"]) else None, "double", px)


def mean_tac(px: Column) -> Column:
    """Mean total ink (%) of colour pixels; 0 where there are none."""
    return _per_raster(lambda p: float(_tac(p).mean()) if len(p["r"]) else 0.0, "double", px)


def crop(px: Column, w: Column, h: Column, region: tuple[float, float, float, float], page: tuple[float, float]) -> Column:
    """Pixels inside (x, y, width, height) in points with the origin at the bottom left."""
    (x, y, width, height), (page_w, page_h) = region, page

    def clamp(fraction, n):
        return F.floor(F.least(F.greatest(fraction * n, F.lit(0.0)), n.cast("double"))).cast("int")

    x0, x1 = clamp(F.lit(x / page_w), w), clamp(F.lit((x + width) / page_w), w)
    y0, y1 = clamp(F.lit(1.0 - (y + height) / page_h), h), clamp(F.lit(1.0 - y / page_h), h)
    return F.filter(px, lambda p, i: (i % w >= x0) & (i % w < x1) & (_div(i, w) >= y0) & (_div(i, w) < y1))
