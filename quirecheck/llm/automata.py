"""Acyclic automata over word sequences whose edges carry counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Sequences of one length in order of their words, as (ids, weights): a row of ids for each, places in a list of words.
Level = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class CountAutomaton:
    """Sequences of words with a weight each: a path spells a sequence, its last edge has the weight.

    State s has the edges begin[s] to begin[s + 1], in order of their labels; state 0 has none, the last state
    is where paths start. States with equal edges are one. A weight of 0 means that only longer sequences count.
    """

    words: list[bytes]  # in order; none is empty or has a space
    begin: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray

    @classmethod
    def build(cls, words: list[bytes], levels: list[Level]) -> CountAutomaton:
        """From sorted sequences: the deepest states are complete first and are registered, equal ones once."""
        sizes, edges, states = [np.zeros(1, np.int64)], [], 1
        target, below = None, None
        for depth in range(len(levels), 0, -1):
            ids, weight = levels[depth - 1]
            target = np.zeros(len(ids), np.int64)
            if below is not None and len(below[0]):  # sequences that go on, counted themselves or not
                joined, (weight, target) = summed(np.concatenate([ids, below[0]]), [np.r_[weight, np.zeros(len(below[1]), np.int64)], np.r_[target, below[1]]])
                ids = joined
            new = np.r_[True, (ids[1:, :-1] != ids[:-1, :-1]).any(1)][: len(ids)]
            starts = np.flatnonzero(new) if depth > 1 else np.zeros(1, np.int64)
            state, size, edge = _registered(np.stack([ids[:, -1], weight, target], 1), starts, states)
            sizes.append(size)
            edges.append(edge)
            states += len(size)
            below = (ids[starts, :-1] if len(ids) else ids[:, :-1], state)
        label, weight, target = np.concatenate(edges).T if edges else np.empty((3, 0), np.int64)
        return cls(words, np.r_[0, np.cumsum(np.concatenate(sizes))], label, weight, target)

    def levels(self) -> list[Level]:
        """All sequences with a weight, by length, in order."""
        out = []
        state, ids = np.array([len(self.begin) - 2]), np.empty((1, 0), np.int64)
        while len(state):
            fan = self.begin[state + 1] - self.begin[state]
            edge = np.repeat(self.begin[state] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
            ids = np.concatenate([np.repeat(ids, fan, axis=0), self.label[edge, None]], 1)
            counted = self.weight[edge] > 0
            out.append((ids[counted], self.weight[edge][counted]))
            further = self.target[edge] > 0
            state, ids = self.target[edge][further], ids[further]
        return out

    def to_bytes(self) -> bytes:
        parts = [np.frombuffer(b" ".join(self.words), np.uint8), np.diff(self.begin), self.label, self.weight, self.target]
        parts = [p.astype(f"<u{next(n for n in (1, 2, 4, 8) if not len(p) or int(p.max()) < 1 << 8 * n)}") for p in parts]
        head = np.array([x for p in parts for x in (p.itemsize, p.nbytes)], "<u8")
        return b"".join([head.tobytes(), *(p.tobytes() for p in parts)])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountAutomaton:
        head = np.frombuffer(data, "<u8", 10).reshape(5, 2).astype(int).tolist()
        at, parts = 80, []
        for width, size in head:
            parts.append(np.frombuffer(data, f"<u{width}", size // width, at))
            at += size
        words, sizes, label, weight, target = parts
        return cls(words.tobytes().split(b" ") if len(words) else [], np.r_[0, np.cumsum(sizes.astype(np.int64))], *(x.astype(np.int64) for x in (label, weight, target)))


def _registered(edges: np.ndarray, starts: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state of each stretch of ``edges`` (label, weight, target); sizes and edges of the new states, numbered from ``first``."""
    size = np.diff(np.r_[starts, len(edges)])
    state = np.zeros(len(starts), np.int64)
    single = np.flatnonzero(size == 1)
    rows = edges[starts[single]]
    order = np.argsort(codes(rows, apart=True))
    rows = rows[order]
    new = np.r_[True, (rows[1:] != rows[:-1]).any(1)][: len(rows)]
    state[single[order]] = first + np.cumsum(new) - 1
    sizes, kept = [np.ones(int(new.sum()), np.int64)], [rows[new]]
    number = first + int(new.sum())
    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(size != 1).tolist():
        own = edges[starts[i] : starts[i] + size[i]]
        held = seen.setdefault(own.tobytes(), number)
        if held == number:
            kept.append(own)
            sizes.append(size[i : i + 1])
            number += 1
        state[i] = held
    return state, np.concatenate(sizes), np.concatenate(kept)


def codes(ids: np.ndarray, apart: bool = False) -> np.ndarray:
    """One number for each row of ``ids``, in the order of the rows; columns of very different size may be kept ``apart``."""
    if not ids.shape[1]:
        return np.zeros(len(ids), np.int64)
    bits = int(ids.max(initial=0)).bit_length()
    code = ids[:, 0].astype(np.int64)
    used = int(code.max(initial=0)).bit_length()
    for c in range(1, ids.shape[1]):
        bits = int(ids[:, c].max(initial=0)).bit_length() if apart else bits
        if used + bits > 63:  # the rank of what stands before is enough
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            used = len(code).bit_length()
        code = (code << bits) | ids[:, c]
        used += bits
    return code


def summed(ids: np.ndarray, values: list[np.ndarray], how: np.ufunc = np.add) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of ``ids`` in order, equal ones once, with the sums of their values (or what ``how`` makes of them)."""
    if not len(ids):
        return ids, values
    code = codes(ids)
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return ids[order[starts]], [how.reduceat(v[order], starts) for v in values]


def renumbered(words: list[bytes], levels: list[Level]) -> tuple[list[bytes], list[Level]]:
    """The same sequences over no more words than they use."""
    used = np.unique(np.concatenate([np.empty(0, np.int64), *(ids.ravel() for ids, _ in levels)]))
    return [words[i] for i in used.tolist()], [(np.searchsorted(used, ids), weight) for ids, weight in levels]


def union(automata: list[CountAutomaton], depth: int, how: np.ufunc = np.add) -> tuple[list[bytes], list[Level]]:
    """Sequences of all of them with their weights added up (or combined by ``how``), over one list of words."""
    words = sorted(set().union(*(a.words for a in automata)))
    place = {w: i for i, w in enumerate(words)}
    ids: list[list] = [[np.empty((0, m + 1), np.int64)] for m in range(depth)]
    weights: list[list] = [[np.empty(0, np.int64)] for _ in range(depth)]
    for a in automata:
        at = np.fromiter(map(place.__getitem__, a.words), np.int64, len(a.words))
        for m, (own, weight) in enumerate(a.levels()):
            ids[m].append(at[own])
            weights[m].append(weight)
    out = []
    for i, w in zip(ids, weights):
        rows, (sums,) = summed(np.concatenate(i), [np.concatenate(w)], how)
        out.append((rows, sums))
    return words, out


def keys(ids: np.ndarray, depth: int) -> np.ndarray:
    """Rows as byte strings in the same order; a sequence comes before those that it begins."""
    wide = np.zeros((len(ids), depth), ">u4")
    wide[:, : ids.shape[1]] = 2 * ids + 2
    return wide.view(f"S{4 * depth}").ravel()


def places(boundaries: list[tuple[bytes, ...]], words: list[bytes], depth: int) -> np.ndarray:
    """``boundaries`` over other words as keys among the sequences over ``words``, for ``np.searchsorted`` in ``keys``."""
    wide = np.zeros((len(boundaries), depth), ">u4")
    place = {w: i for i, w in enumerate(words)}
    sorted_words = np.array(words, object)
    for row, boundary in zip(wide, boundaries):
        for c, word in enumerate(boundary):
            at = place.get(word)
            if at is None:
                row[c] = 2 * int(np.searchsorted(sorted_words, word)) + 1
                break
            row[c] = 2 * at + 2
    return wide.view(f"S{4 * depth}").ravel()


def cut(words: list[bytes], levels: list[Level], boundaries: list[tuple[bytes, ...]]) -> list[tuple[int, list[Level]]]:
    """The sequences of each range that has some: range 0 ends before the first boundary, and so on."""
    depth = len(levels)
    at = places(boundaries, words, depth)
    ends = np.stack([np.r_[0, np.searchsorted(keys(ids, depth), at), len(ids)] for ids, _ in levels])
    used = np.flatnonzero((np.diff(ends, axis=1) > 0).any(0))
    return [(int(r), [(ids[e[r] : e[r + 1]], weight[e[r] : e[r + 1]]) for (ids, weight), e in zip(levels, ends)]) for r in used]
