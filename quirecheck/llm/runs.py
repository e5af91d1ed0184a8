"""Runs of repeated words, found with string synchronising sets.

Words are numbers, and many texts are one array with a number of its own after each text, so no match
crosses a border. Periods 1 to 3 are found by comparing neighbours. For every scale t = 4, 8, 16, ... the
stretches of t words are named, equal ones alike, and a hash of the names selects positions: a position is
chosen if the least hash of the t + 1 stretches from it on is that of the first or of the last. The choice
depends on the next 2t words only, so inside a run of period q the chosen positions recur every q words.
Stretches that lie in a known run of period t / 4 or less take no part; then t neighbouring positions hold a
chosen one unless all of them lie in such a run, whose period a smaller scale has found. A run of four
periods of t <= q < 2t words has a chosen position among its first t, the same one q words later, and 2t
equal words from both on; 2t > q words recur in the run after q words and not before. So the next chosen
position with equal context is q away, and its distance is a proposal, which is then compared and extended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirecheck.llm.shared import slices

#: Repeats a run has at least, for any q, and its least length.
EXPONENT, LEAST = 4, 6
#: Bytes of text whose words are searched together; a longer text is searched alone.
PIECE = 6_000_000
#: Words compared at once when proposals are extended.
STEP = 32


def word_runs(codes: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least EXPONENT periods, by start, then period.

    ``codes`` are numbers of words; texts end with a number that occurs once, and have at most ``longest`` words.
    """
    n = len(codes)
    runs = [np.empty((0, 3), np.int64)]
    for q in range(1, min(4, longest // EXPONENT + 1)):
        same = np.flatnonzero(codes[:-q] == codes[q:])
        cut = np.flatnonzero(np.diff(same) > 1) + 1
        first, last = same[np.r_[0, cut]] if len(same) else same, same[np.r_[cut - 1, len(same) - 1]] if len(same) else same
        runs.append(np.stack([first, last + 1 + q - first, np.full(len(first), q)], 1))
        runs[-1] = runs[-1][runs[-1][:, 1] >= EXPONENT * q]
    names, scale = codes, 1
    while scale * EXPONENT <= longest:
        if scale >= 4:
            doubled = _named(names, scale)
            runs.append(_of_scale(codes, names, doubled, scale, _smallest(np.concatenate(runs))))
            names = doubled
        else:
            names = _named(names, scale)
        scale *= 2
    found = _smallest(np.concatenate(runs))
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of rows with one start and length the one of the smallest period: the others are its multiples."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)][: len(runs)]]


def _named(names: np.ndarray, scale: int) -> np.ndarray:
    """Numbers of the stretches twice as long: equal stretches have equal numbers."""
    second = np.full(len(names), -1, np.int64)  # the last number occurs once, so stretches over the end are all different
    second[:-scale] = names[scale:]
    return np.unique((names.astype(np.int64) << 32) | (second & 0xFFFFFFFF), return_inverse=True)[1]


def _mixed(names: np.ndarray) -> np.ndarray:
    """Different hashes of different names (each step can be undone), below the largest number."""
    x = names.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chosen(names: np.ndarray, scale: int, runs: np.ndarray) -> np.ndarray:
    """Positions of the synchronising set at ``scale``, given the names of its stretches and all runs of smaller scales."""
    n = len(names)
    none = np.uint64(np.iinfo(np.uint64).max)
    order = _mixed(names)
    inside = runs[(runs[:, 2] * EXPONENT <= scale) & (runs[:, 1] >= scale)]
    if len(inside):
        depth = np.bincount(inside[:, 0], minlength=n + 1) - np.bincount(inside[:, 0] + inside[:, 1] - scale + 1, minlength=n + 1)
        order[np.cumsum(depth)[:n] > 0] = none
    least, width = order, 1
    while width < scale:
        least = np.minimum(least, np.r_[least[width:], np.full(min(width, n), none)][:n])
        width *= 2
    beyond = np.r_[order[scale:], np.full(min(scale, n), none)][:n]
    least = np.minimum(least, beyond)
    return np.flatnonzero((least != none) & ((least == order) | (least == beyond)))


def _of_scale(codes: np.ndarray, names: np.ndarray, doubled: np.ndarray, scale: int, runs: np.ndarray) -> np.ndarray:
    """Runs of a period of ``scale`` words or more, below twice that."""
    at = chosen(names, scale, runs)
    at = at[np.argsort(doubled[at], kind="stable")]
    period = at[1:] - at[:-1]
    good = (doubled[at[1:]] == doubled[at[:-1]]) & (period >= scale) & (period < 2 * scale)
    start, period = at[:-1][good], period[good]
    if not len(start):
        return np.empty((0, 3), np.int64)
    # Proposals of one period whose equal stretches touch are one.
    by = np.lexsort((start, period))
    start, period = start[by], period[by]
    new = np.r_[True, (period[1:] != period[:-1]) | (start[1:] - start[:-1] > 2 * scale)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    begin, end, q = start[first], start[last] + 2 * scale, period[first]  # codes[x] == codes[x + q] for begin <= x < end
    end = end + _equal_words(codes, end, end + q, 1)
    begin = begin - _equal_words(codes, begin - 1, begin + q - 1, -1)
    found = np.stack([begin, end + q - begin, q], 1)
    return np.unique(found[found[:, 1] >= EXPONENT * q], axis=0)


def _equal_words(codes: np.ndarray, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
    """How many words agree from the places a and b on (a < b), forwards or backwards."""
    total = np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    ahead = np.arange(STEP) * way
    while len(todo):
        i, j = a[todo, None] + total[todo, None] * way + ahead, b[todo, None] + total[todo, None] * way + ahead
        there = (i >= 0) & (j < len(codes))
        same = there & (codes[np.where(there, i, 0)] == codes[np.where(there, j, 0)])
        agreed = np.where(same.all(1), STEP, same.argmin(1))
        total[todo] += agreed
        todo = todo[agreed == STEP]
    return total


def _searched(texts: list[bytes], least: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(words, runs, kept words) of each text; texts of like length are searched together."""
    words = [t.split() for t in texts]  # bytes: ASCII white space only
    classes: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        classes.setdefault(max(len(w), 1).bit_length(), []).append(i)
    out: list = [None] * len(texts)
    for members in classes.values():
        number: dict[bytes, int] = {}
        sizes = np.array([len(words[i]) for i in members])
        ends = np.cumsum(sizes + 1)
        codes = np.empty(int(ends[-1]), np.int64)
        for i, end, size in zip(members, ends, sizes):
            codes[end - 1 - size : end - 1] = np.fromiter((number.setdefault(w, len(number)) for w in words[i]), np.int64, size)
        codes[ends - 1] = len(number) + np.arange(len(members))
        runs = word_runs(codes, int(sizes.max()))
        runs = runs[runs[:, 1] >= least]
        depth = np.bincount(runs[:, 0] + runs[:, 2], minlength=len(codes) + 1) - np.bincount(runs[:, 0] + runs[:, 1], minlength=len(codes) + 1)
        dropped = np.cumsum(depth)[:-1] > 0
        begin = ends - 1 - sizes
        cuts = np.searchsorted(runs[:, 0], np.r_[begin, len(codes)])
        for k, i in enumerate(members):
            own = runs[cuts[k] : cuts[k + 1]] - [begin[k], 0, 0]
            kept = words[i] if not len(own) else [w for w, d in zip(words[i], dropped[begin[k] : ends[k] - 1]) if not d]
            out[i] = (len(words[i]), own, b" ".join(kept))
    yield from out


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id_col, n_words, runs, collapsed), one row per row of ``df``.

    ``runs`` is an array of (start, length, period) by start, then period: every stretch of words with
    smallest period q, of at least 4 q and ``least`` words, that no neighbouring word extends keeping period q.
    ``collapsed`` joins by spaces the words outside of the repeats: of each run the first q words stay. Words
    stand between ASCII white space and are compared as they are. A null or empty text has no words. Rows
    are searched one by one, so repeated rows and null ids need no care; other columns are not carried. A
    text of any length is searched whole, in memory that grows with its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices([n or 0 for n in pc.binary_length(batch.column(1)).to_pylist()], PIECE):
                part = batch.slice(a, b - a)
                found = list(_searched([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(1).cast(pa.binary())], least))
                runs = np.concatenate([r for _, r, _ in found])
                entries = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, c])) for c in range(3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r) for _, r, _ in found)]), pa.int32()), entries),
                        pa.array([k for _, _, k in found], pa.binary()).cast(pa.string()),
                    ],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    found = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return found.select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")


def longest_run(runs: Column) -> Column:
    """The run of greatest length; of equal ones the smallest start, then period. Null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("under"))))
    return F.when(best.isNotNull(), F.struct((-best["before"]).alias("start"), best["length"].alias("length"), (-best["under"]).alias("period")))


def listed(runs: Column) -> Column:
    """start,length,period of each run, each on a line of its own."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
