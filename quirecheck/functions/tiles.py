"""Kernels over tiles of rasters: arrays (plane, y, x) of bytes, the planes r, g, b and, if pages can be transparent, a."""

from __future__ import annotations

import math

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from quirecheck.functions.raster import LONGEST_RGB, WEIGHTS

WHITE = 255


def luminance(planes: np.ndarray) -> np.ndarray:
    """Weighted sum of the colours, truncated; what is transparent is white."""
    r, g, b = (planes[i] * WEIGHTS[c] for i, c in enumerate("rgb"))
    light = r + g + b
    if len(planes) == 4:
        alpha = planes[3] / 255.0
        light = light * alpha + 255.0 * (1.0 - alpha)
    return light.astype(np.uint8)


def box_means(window: np.ndarray, radius: int) -> np.ndarray:
    """Means of 2 radius + 1 values along x, then along y, both truncated; the window loses its margin of ``radius``."""
    size = 2 * radius + 1
    for axis in (2, 1):
        n = window.shape[axis] - 2 * radius
        cut = [slice(None)] * 3
        total = np.zeros([n if a == axis else s for a, s in enumerate(window.shape)], np.uint16 if size < 257 else np.uint32)
        for k in range(size):
            cut[axis] = slice(k, k + n)
            total += window[tuple(cut)]
        window = (total // size).astype(np.uint8)
    return window


def box_greys(light: np.ndarray, scale: int) -> np.ndarray:
    """Truncated means of scale x scale boxes; boxes at the edge average what they have."""
    h, w = light.shape
    rows, columns = np.arange(0, h, scale), np.arange(0, w, scale)
    sums = np.add.reduceat(np.add.reduceat(light, rows, 0, np.uint32), columns, 1, np.uint32)
    counts = np.minimum(scale, h - rows)[:, None] * np.minimum(scale, w - columns)[None, :]
    return (sums // counts).astype(np.uint8)


def furthest_equal(threshold: float) -> int:
    """The largest squared distance of two opaque colours that does not pass ``threshold`` of the longest distance."""
    at = int((threshold * LONGEST_RGB) ** 2)
    while math.sqrt(at + 1) / LONGEST_RGB <= threshold:
        at += 1
    while at >= 0 and math.sqrt(at) / LONGEST_RGB > threshold:
        at -= 1
    return at


def differing(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """True where two colours over white are further apart than ``threshold`` of the longest distance."""
    if len(a) == 3:
        total = np.zeros(a.shape[1:], np.int32)
        for p, q in zip(a, b):
            d = np.subtract(p, q, dtype=np.int16)
            total += np.multiply(d, d, dtype=np.int32)
        return total > furthest_equal(threshold)
    over = [[p[c] * (p[3] / 255.0) + 255.0 * (1.0 - p[3] / 255.0) for c in range(3)] for p in (a, b)]
    return np.sqrt(sum((p - q) * (p - q) for p, q in zip(*over))) / LONGEST_RGB > threshold


def touched(mask: np.ndarray, block: int) -> int:
    """Number of blocks with a set pixel."""
    h, w = mask.shape
    rows = np.logical_or.reduceat(mask, np.arange(0, h, block), 0)
    return int(np.count_nonzero(np.logical_or.reduceat(rows, np.arange(0, w, block), 1)))


def shift_sums(a: np.ndarray, window: np.ndarray, known: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For every shift (dy, dx) up to ``reach``, in scan order: the sum of differences of ``a`` and the window there, and their number.

    The window has a margin of ``reach`` around ``a``; only its ``known`` values count.
    """
    h, w = a.shape
    n = 2 * reach + 1
    views, there = (sliding_window_view(x, (h, w)) for x in (window, known.view(np.uint8)))
    whole = bool(known.all())
    # As many rows of shifts at a time as stay small.
    step = max(1, 2**20 // (n * h * w))
    sums = []
    for at in range(0, n, step):
        view = views[at : at + step]
        apart = np.maximum(view, a) - np.minimum(view, a)
        if not whole:
            apart *= there[at : at + step]
        sums.append(apart.reshape(-1, h * w).sum(1, dtype=np.int64))
    # What is known above and to the left of each place.
    before = np.zeros((known.shape[0] + 1, known.shape[1] + 1), np.int64)
    before[1:, 1:] = known.cumsum(0).cumsum(1)
    counts = before[h:, w:] - before[:-h, w:] - before[h:, :-w] + before[:-h, :-w]
    return np.concatenate(sums), counts.ravel()


def searched(a: np.ndarray, window: np.ndarray, known: np.ndarray, reach: int, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """``shift_sums``, and how many values differ by more than ``threshold`` at the centre."""
    h, w = a.shape
    centre = slice(reach, reach + h), slice(reach, reach + w)
    apart = np.abs(np.subtract(a, window[centre], dtype=np.int16)) / 255 > threshold
    return *shift_sums(a, window, known, reach), int(np.count_nonzero(apart & known[centre]))


def _placed(planes: np.ndarray, y: int, x: int, canvas: np.ndarray, known: np.ndarray | None = None) -> None:
    """Puts planes on a canvas, their first pixel at (y, x), as far as they are on it."""
    h, w = planes.shape[-2:]
    tall, wide = canvas.shape[-2:]
    top, bottom, left, right = max(y, 0), min(y + h, tall), max(x, 0), min(x + w, wide)
    if top < bottom and left < right:
        canvas[..., top:bottom, left:right] = planes[..., top - y : bottom - y, left - x : right - x]
        if known is not None:
            known[top:bottom, left:right] = True


def on_white(planes: np.ndarray, y: int, x: int, tall: int, wide: int) -> np.ndarray:
    """A white canvas with the planes at (y, x)."""
    if (y, x) == (0, 0) and planes.shape[1:] == (tall, wide):
        return planes
    canvas = np.full((len(planes), tall, wide), WHITE, np.uint8)
    _placed(planes, y, x, canvas)
    return canvas


def lined_up(a: dict[int, np.ndarray], b: dict[int, np.ndarray], coarse: int, fine: int, reach: int, threshold: float, align_above: float) -> tuple[int, int]:
    """(dx, dy) by which a new page of one tile is moved to fit the old one, from grey copies by scale."""

    def best(scale: int, cx: int, cy: int, reach: int) -> tuple[int, int, float] | None:
        h, w = a[scale].shape
        window, known = np.zeros((h + 2 * reach, w + 2 * reach), np.uint8), np.zeros((h + 2 * reach, w + 2 * reach), bool)
        _placed(b[scale], reach - cy, reach - cx, window, known)
        if not known.any():
            return None
        sums, counts, rough = searched(a[scale], window, known, reach, threshold)
        # The smallest mean, the first place in scan order among equal ones.
        at = int(np.argmin(np.divide(sums, counts, out=np.full(len(sums), np.inf), where=counts > 0)))
        common = int(counts[(2 * reach + 1) * reach + reach])
        return at % (2 * reach + 1) - reach, at // (2 * reach + 1) - reach, rough / common * 100 if common else 0.0

    x, y, share = best(coarse, 0, 0, reach)
    if share < align_above:
        return 0, 0
    # Truncates toward zero, like the integer division it stands for.
    cx, cy = (int(v * coarse / fine) for v in (x, y))
    found = best(fine, cx, cy, coarse // fine)
    return (0, 0) if found is None else (-(cx + found[0]) * fine, -(cy + found[1]) * fine)


def moments(a: np.ndarray, b: np.ndarray) -> list[int]:
    """n and the sums of a, b, aa, bb, ab."""
    x, y = a.ravel().astype(np.int64), b.ravel().astype(np.int64)
    return [len(x), int(x.sum()), int(y.sum()), int(x @ x), int(y @ y), int(x @ y)]
