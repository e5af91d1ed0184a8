"""Rows of two sides whose word sets overlap, found inside cells of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of a row and a word that are held at once.
STEP = 1 << 20


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _chunks(costs: np.ndarray) -> Iterator[slice]:
    """Stretches whose costs add up to about ``STEP``; what costs more is a stretch of its own."""
    ends, at = np.cumsum(costs), 0
    while at < len(costs):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right"))
        yield slice(at, max(upto, at + 1))
        at = max(upto, at + 1)


def overlapping(cell: np.ndarray, right: np.ndarray, number: np.ndarray, band: np.ndarray, row: np.ndarray, word: np.ndarray, overlap: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the left and of the ``right`` side of one cell whose numbers differ by at most the band and whose sets of words have a Jaccard index of at least ``overlap``.

    ``row`` and ``word`` are the words of rows, as numbers, copies included. ``overlap`` is 3/5: such sets share at
    least 3/5 of either, so they share one of the first ``size - ceil(3/5 size) + 1`` words in any common order. Rare
    words come first. What shares one of those is compared in full.
    """
    kinds = int(word.max(initial=0)) + 1
    rare = np.empty(kinds, np.int64)
    rare[np.argsort(np.bincount(word, minlength=kinds), kind="stable")] = np.arange(kinds)
    keys = np.unique(row * kinds + rare[word])  # words of a row, rare ones first
    of = keys // kinds
    size = np.bincount(of, minlength=len(cell))
    start = np.cumsum(size) - size
    keep = np.where(size > 0, size - (size * 3 + 4) // 5 + 1, 0)

    def first(rows):
        places = _ranges(start[rows], keep[rows])
        owner = np.repeat(rows, keep[rows])
        return owner, cell[owner] * kinds + keys[places] - owner * kinds

    others, other_keys = first(np.flatnonzero(right))
    order = np.argsort(other_keys, kind="stable")
    others, other_keys = others[order], other_keys[order]
    mine, my_keys = first(np.flatnonzero(~right))
    low = np.searchsorted(other_keys, my_keys, "left")
    many = np.searchsorted(other_keys, my_keys, "right") - low
    mine, low, many = mine[many > 0], low[many > 0], many[many > 0]
    rows, at = np.unique(mine, return_index=True)
    bounds = np.r_[at, len(mine)]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for rows_of in _chunks(np.add.reduceat(many, at) if len(at) else many):
        cut = slice(int(bounds[rows_of.start]), int(bounds[rows_of.stop]))
        a = np.repeat(mine[cut], many[cut])
        b = others[_ranges(low[cut], many[cut])]
        near = (np.abs(number[a] - number[b]) <= band[a]) & (np.minimum(size[a], size[b]) * 5 >= np.maximum(size[a], size[b]) * 3)
        pairs = np.unique(a[near] * len(cell) + b[near])
        a, b = pairs // len(cell), pairs % len(cell)
        for some in _chunks(size[a]):
            p, q = a[some], b[some]
            pair = np.repeat(np.arange(len(p)), size[p])
            wanted = keys[_ranges(start[p], size[p])] + (q - p)[pair] * kinds
            held = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted
            shared = np.bincount(pair[held], minlength=len(p))
            match = shared / (size[p] + size[q] - shared) >= overlap
            found.append((p[match], q[match]))
    return tuple(np.concatenate(side) for side in zip(*found))
