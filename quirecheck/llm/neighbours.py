"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Vectors live in blocks of near ones, which the leaves of a random projection tree give. A block is a row that
holds its vectors and their neighbour lists as matrices, and a node's number names its block. A round of the
descent joins neighbours with neighbours: every node sends its vector to the blocks of those it lists or is
listed by, each block compares the neighbours of each of its nodes that have not met, and what beats the
worst entry of a list is sent to its owner. Rounds end when few entries change. A query starts at a node,
walks greedily inside the block, and goes on to the blocks of the neighbours of its best nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirecheck.llm.shared import in_fraction, partitions
from quirecheck.operators.unions import union_all
from quirecheck.sources.checkpoints import checkpointed, discard, scratch_path, stored

#: Neighbours in a list, nodes remembered that list a node, nodes a search keeps.
LIST, LISTED, BEAM = 32, 32, 160
#: Of either kind, fresh and met, a round compares so many of a node's neighbours; a block offers a node elsewhere so many.
SAMPLED, OFFERED = 16, 8
#: Nodes of a block, about; numbers of the vectors that the trees are fitted on; trees that give the first lists.
BLOCK, SAMPLE, TREES = 4_096, 1_280_000, 2
#: The descent ends when a round changes less than this share of the entries, or after so many rounds.
CHANGED, ROUNDS = 0.15, 12
#: A node's number is its block, then its place in it, in so many bits.
BITS = 20
#: Nodes whose neighbours are compared at once, and better entries held before lists are updated.
ATONCE, HELD = 128, 1 << 20
#: What a row of a block holds: its nodes, who lists them, vectors from elsewhere, better neighbours, queries.
_NODES, _LISTS, _VECTORS, _BETTER, _VISITS = range(5)
_ROW = "block long, kind int, data binary"


def usable(vector: Column) -> Column:
    """True for a vector with finite components, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any shape and kind in one value."""
    heads = [f"{a.dtype.str}:{','.join(map(str, a.shape))}" for a in arrays]
    return ";".join(heads).encode() + b"\n" + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(data: bytes) -> list[np.ndarray]:
    head, at = data[: data.index(b"\n")].decode(), data.index(b"\n") + 1
    out = []
    for one in head.split(";"):
        kind, shape = one.split(":")
        shape = tuple(map(int, shape.split(",")))
        count = int(np.prod(shape))
        out.append(np.frombuffer(data, kind, count, at).reshape(shape))
        at += count * np.dtype(kind).itemsize
    return out


def _units(rows: np.ndarray) -> np.ndarray:
    # Powers of two change no digit, and keep squares from overflowing.
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(1, initial=0, keepdims=True))[1])
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


class Tree:
    """Hyperplanes halfway between two drawn vectors' directions, moved to the median; leaves are numbered."""

    def __init__(self, points: np.ndarray, leaf: float, seed: int):
        rng = np.random.default_rng(seed)
        self.planes, self.cuts, self.children = [], [], []  # a child below 0 is leaf -1 - child
        self.leaves = 0

        def grow(rows: np.ndarray) -> int:
            if len(rows) > max(leaf, 8):
                a, b = rng.choice(rows, 2, replace=False)
                along = points[rows] @ (points[a] - points[b])
                cut = np.median(along)
                left = along < cut
                if left.any():
                    me = len(self.planes)
                    self.planes.append(points[a] - points[b])
                    self.cuts.append(cut)
                    self.children.append([0, 0])
                    self.children[me] = [grow(rows[left]), grow(rows[~left])]
                    return me
            self.leaves += 1
            return -self.leaves

        self.root = grow(np.arange(len(points)))

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.full(len(points), self.root, np.int64)
        while (out >= 0).any():
            for node in np.unique(out[out >= 0]).tolist():
                rows = np.flatnonzero(out == node)
                out[rows] = np.where(points[rows] @ self.planes[node] < self.cuts[node], *self.children[node])
        return -1 - out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` numbers, shorter ones padded with zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v.values.to_numpy()
    return out


def members(rows: DataFrame, k: int) -> tuple[DataFrame, int]:
    """Distinct vectors (v) with their smallest ``k`` + 1 ids, and the largest number of components."""
    distinct = rows.groupBy("id", "v").agg(F.lit(1).alias("one")).select("id", "v")
    ranked = distinct.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    held = checkpointed(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    return held, held.agg(F.max(F.size("v"))).first()[0] or 0


def placed(held: DataFrame, width: int) -> DataFrame:
    """(code, leaf, v, ids): vectors with their numbers, and their leaf in each further tree."""
    spark = held.sparkSession
    total = held.count()
    most = SAMPLE / max(width, 64)
    drawn = held.where(in_fraction(F.xxhash64("v"), most / max(total, 1))).select("v").collect()  # SAMPLE numbers, about
    points = _units(_matrix(pa.array([r["v"] for r in drawn], pa.list_(pa.float64())), width)) if drawn else np.eye(1, width)
    points = points[np.lexsort(points.T)]
    trees = spark.sparkContext.broadcast([Tree(points, BLOCK * len(points) / max(total, 1), seed) for seed in range(TREES)])  # as large as the sample at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(_matrix(batch.column(0), width))
            leaves = np.stack([t.leaf_of(units) for t in trees.value], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(leaves.ravel()), TREES).cast(pa.list_(pa.int64()))], names=["v", "ids", "leaf"])

    vector = held.schema["v"].dataType.simpleString()
    assigned = checkpointed(held.mapInArrow(assign, f"v {vector}, ids array<long>, leaf array<long>"))
    # Leaves of too many nodes, as of one direction, are dealt out; the other trees and the descent link them.
    hashed = F.xxhash64("v")
    for t in range(TREES):
        leaf = F.get("leaf", t)
        sizes = assigned.groupBy(leaf.alias(f"leaf{t}")).agg(F.ceil(F.count("*") / (2 * BLOCK)).alias(f"parts{t}"))
        assigned = assigned.join(sizes, leaf == F.col(f"leaf{t}")).withColumn(f"block{t}", F.shiftleft(F.col(f"leaf{t}"), 22) + F.pmod(hashed, F.col(f"parts{t}")))
    kind = "array<long>"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = None, 0
        for batch in batches:
            codes = []
            for block in batch.column(0).to_pylist():
                last, used = block, used + 1 if block == last else 0
                codes.append((block << BITS) + used)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), *batch.columns[1:]], names=["code", "more", "v", "ids"])

    dealt = assigned.select("block0", F.array(*(f"block{t}" for t in range(1, TREES))).cast(kind).alias("more"), "v", "ids")
    return dealt.repartition(partitions(spark), "block0").sortWithinPartitions("block0", "v").mapInArrow(number, f"code long, more {kind}, v {vector}, ids array<long>")


def _by_block(df: DataFrame, work: Callable[[int, dict[int, list[list[np.ndarray]]]], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """``work`` on what each block has got, by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
        for block, group in groupby(rows, key=lambda row: row[0]):
            got: dict[int, list] = {kind: [] for kind in range(5)}
            for _, kind, data in group:
                got[kind].append(_unpack(data))
            out = list(work(block, got))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["block", "kind", "data"])

    return df.repartition(partitions(df.sparkSession), "block").sortWithinPartitions("block", "kind").mapInArrow(run, _ROW)


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest of each row, the largest first."""
    n = min(n, scores.shape[1])
    at = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n < scores.shape[1] else np.tile(np.arange(n), (len(scores), 1))
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(scores, at, 1), axis=1, kind="stable"), 1)


def _parted(to: np.ndarray, kind: int, *arrays: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Rows of some arrays as one row for each block they go to."""
    order = np.argsort(to, kind="stable")
    edges = np.r_[0, np.flatnonzero(np.diff(to[order])) + 1, len(to)] if len(to) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(to[order[a]]), kind, _pack(*(x[order[a:b]] for x in arrays))


def _filled(rows: np.ndarray, n: int, width: int, order: np.ndarray, *columns: tuple[np.ndarray, float]) -> list[np.ndarray]:
    """Matrices of ``n`` rows from entries at ``rows``, the first ``width`` of each row by ``order``."""
    by = np.lexsort((order, rows))
    rows = rows[by]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = place < width
    out = []
    for values, empty in columns:
        m = np.full((n, width), empty, values.dtype)
        m[rows[keep], place[keep]] = values[by[keep]]
        out.append(m)
    return out


def _merged(lists, scores, fresh, more, more_scores):
    """Lists with further entries: the LIST best of each row; entries new to a list are fresh."""
    ids, s = np.concatenate([lists, more], 1), np.concatenate([scores, more_scores], 1)
    f = np.concatenate([fresh, np.ones(more.shape, bool)], 1)
    by = np.argsort(ids, axis=1, kind="stable")  # of equal entries the held one comes first
    sorted_ids = np.take_along_axis(ids, by, 1)
    again = np.concatenate([np.zeros((len(ids), 1), bool), sorted_ids[:, 1:] == sorted_ids[:, :-1]], 1)
    drop = np.zeros(ids.shape, bool)
    np.put_along_axis(drop, by, again, 1)
    s = np.where(drop | (ids < 0), -np.inf, s).astype(np.float32)
    at = _best(s, LIST)
    s = np.take_along_axis(s, at, 1)
    return np.where(s > -np.inf, np.take_along_axis(ids, at, 1), -1), s, np.take_along_axis(f, at, 1) & (s > -np.inf)


def _among(units: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The LIST nearest of each row among the others: codes and scores, padded with -1."""
    lists, scores = np.full((len(codes), LIST), -1, np.int64), np.full((len(codes), LIST), -np.inf, np.float32)
    for a in range(0, len(codes), 1024):
        s = units[a : a + 1024] @ units.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        at = _best(s, LIST)
        got = np.take_along_axis(s, at, 1)
        scores[a : a + 1024, : at.shape[1]] = got
        lists[a : a + 1024, : at.shape[1]] = np.where(got > -np.inf, codes[at], -1)
    return lists, scores


def first_lists(nodes: DataFrame, width: int) -> DataFrame:
    """Rows of blocks: their nodes with the nearest of the same block, and the nearest that further trees find."""

    def pack(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((b, c, v) for batch in batches for b, c, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _matrix(batch.column(2), width)))
            for block, group in groupby(rows, key=lambda row: row[0]):
                found = [row[1:] for row in group]
                codes, units = np.array([c for c, _ in found]), _units(np.array([v for _, v in found])).astype(np.float32)
                lists, scores = _among(units, codes)
                if number == 0:
                    none = np.full((len(codes), LISTED), -1, np.int64)
                    row, at = np.nonzero(lists >= 0)
                    out = list(_parted(lists[row, at] >> BITS, _LISTS, lists[row, at], codes[row]))
                    out += [(block, _NODES, _pack(units.astype(np.float16), lists, scores, lists >= 0, none, none >= 0, np.zeros(2, np.int64)))]
                else:
                    own, at = np.nonzero(lists >= 0)
                    out = list(_parted(codes[own] >> BITS, _BETTER, codes[own], lists[own, at], scores[own, at]))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["block", "kind", "data"])

        return run

    n = partitions(nodes.sparkSession)
    out = []
    for t in range(TREES):
        block = F.shiftright("code", BITS) if t == 0 else F.get("more", t - 1)
        out.append(nodes.select(block.alias("block"), "code", "v").repartition(n, "block").sortWithinPartitions("block", "code").mapInArrow(pack(t), _ROW))
    return union_all(*out)


def _accepted(lists, scores, fresh, own, other, score) -> tuple[list[np.ndarray], int]:
    """The lists after offers (row, code, score), and how many entries are new."""
    good = score > scores[own, -1]
    own, other, score = own[good], other[good], score[good]
    once = np.unique(np.stack([own, other], 1), axis=0, return_index=True)[1]  # several blocks can have found one pair
    rows, at = np.unique(own[once], return_inverse=True)
    if not len(rows):
        return [lists, scores, fresh], 0
    more, more_scores = _filled(at, len(rows), LIST, -score[once], (other[once], -1), (score[once], -np.inf))
    out = [x.copy() for x in (lists, scores, fresh)]
    for held, new in zip(out, _merged(lists[rows], scores[rows], fresh[rows], more, more_scores)):
        held[rows] = new
    new = (out[0][rows] >= 0) & ~(out[0][rows][:, :, None] == lists[rows][:, None, :]).any(2)
    return out, int(new.sum())


def _sending(block: int, got: dict) -> Iterator[tuple[int, int, bytes]]:
    """Better neighbours join the lists, nodes learn who lists them, and send their vectors to the blocks of all those."""
    for units, lists, scores, fresh, listed, listed_fresh, meta in got[_NODES]:
        n, changed = len(lists), meta[0]
        if got[_BETTER]:
            own, other, score = (np.concatenate(x) for x in zip(*got[_BETTER]))
            (lists, scores, fresh), new = _accepted(lists, scores, fresh, own & ((1 << BITS) - 1), other, score)
            changed = changed + new
        row, at = np.nonzero(listed >= 0)
        own, by, new = row, listed[row, at], listed_fresh[row, at]
        if got[_LISTS]:
            more, who = (np.concatenate(x) for x in zip(*got[_LISTS]))
            own, by, new = np.r_[own, more & ((1 << BITS) - 1)], np.r_[by, who], np.r_[new, np.ones(len(who), bool)]
            once = np.unique(np.stack([own, by], 1), axis=0, return_index=True)[1]
            own, by, new = own[once], by[once], new[once]
        # Those that are new come first, in an order without meaning, as a node may be listed by very many.
        order = ((by * 0x9E3779B1) & 0x3FFFFFFF) + np.where(new, 0, 1 << 30)
        listed, listed_fresh = _filled(own, n, LISTED, order, (by, -1), (new, False))
        yield block, _NODES, _pack(units, lists, scores, fresh, listed, listed_fresh, np.array([changed, meta[1]]))
        every = np.concatenate([lists, listed], 1)
        row, at = np.nonzero((every >= 0) & (every >> BITS != block))
        pair = np.unique((every[row, at] >> BITS) * n + row)
        to, row = pair // n, pair % n
        yield from _parted(to, _VECTORS, (block << BITS) + row, units[row], scores[row, -1])


def _picked(rng: np.random.Generator, there: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SAMPLED of the places ``at`` that are ``there``, in each row (else -1), and which ones those are."""
    chance = np.where(there, rng.random(there.shape, np.float32), 2)
    best = np.argpartition(chance, SAMPLED - 1, axis=1)[:, :SAMPLED]
    good = np.take_along_axis(there, best, 1)
    used = np.zeros(there.shape, bool)
    np.put_along_axis(used, best, good, 1)
    return np.where(good, np.take_along_axis(at, best, 1), -1), used


def _joining(block: int, got: dict) -> Iterator[tuple[int, int, bytes]]:
    """The neighbours of each node meet: fresh ones are compared with all, and better entries go to their owners."""
    for units, lists, scores, fresh, listed, listed_fresh, meta in got[_NODES]:
        n = len(lists)
        codes, vectors, worst = [(block << BITS) + np.arange(n)], [units], [scores[:, -1]]
        for c, v, w in got[_VECTORS]:
            codes, vectors, worst = [*codes, c], [*vectors, v], [*worst, w]
        codes, vectors, worst = np.concatenate(codes), np.concatenate(vectors).astype(np.float32), np.concatenate(worst)
        by = np.argsort(codes)
        rng = np.random.default_rng([block, int(meta[1])])
        picked, flags = [], []
        for side, new in ((lists, fresh), (listed, listed_fresh)):
            at = by[np.minimum(np.searchsorted(codes[by], side), len(codes) - 1)]
            there = (side >= 0) & (codes[at] == side)
            fresh_at, used = _picked(rng, there & new, at)
            met_at, _ = _picked(rng, there & ~new, at)
            picked.append((fresh_at, met_at))
            flags.append(new & ~used)
        fresh, listed_fresh = flags
        fresh_at = np.concatenate([p[0] for p in picked], 1)
        every_at = np.concatenate([fresh_at, *(p[1] for p in picked)], 1)
        changed, offers, held = 0, [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)], []

        def update():
            nonlocal lists, scores, fresh, changed, offers, held
            a, b, s = (np.concatenate(x) for x in zip(*held))
            held = []
            mine = a < n
            (lists, scores, fresh), new = _accepted(lists, scores, fresh, a[mine], codes[b[mine]], s[mine])
            changed += new
            worst[:n] = scores[:, -1]
            a, b, s = np.r_[offers[0], a[~mine]], np.r_[offers[1], b[~mine]], np.r_[offers[2], s[~mine]]
            once = np.unique(a * len(codes) + b, return_index=True)[1]
            a, b, s = a[once], b[once], s[once]
            order = np.lexsort((-s, a))
            a, b, s = a[order], b[order], s[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            full = place == OFFERED - 1
            worst[a[full]] = s[full]
            offers = [x[place < OFFERED] for x in (a, b, s)]

        for start in range(0, n, ATONCE):
            new, every = fresh_at[start : start + ATONCE], every_at[start : start + ATONCE]
            s = np.matmul(vectors[new], vectors[every].transpose(0, 2, 1))
            pairs = (new[:, :, None] >= 0) & (every[:, None, :] >= 0) & (new[:, :, None] != every[:, None, :])
            for a, b, better in ((new[:, :, None], every[:, None, :], pairs & (s > worst[new][:, :, None])), (every[:, None, :], new[:, :, None], pairs & (s > worst[every][:, None, :]))):
                held.append((np.broadcast_to(a, s.shape)[better], np.broadcast_to(b, s.shape)[better], s[better]))
            if sum(len(h[2]) for h in held) > HELD or start + ATONCE >= n:
                update()
        yield block, _NODES, _pack(units, lists, scores, fresh, listed, listed_fresh, np.array([changed, meta[1] + 1]))
        row, at = np.nonzero(fresh & (lists >= 0))
        yield from _parted(lists[row, at] >> BITS, _LISTS, lists[row, at], (block << BITS) + row)
        a, b, s = offers
        yield from _parted(codes[a] >> BITS, _BETTER, codes[a], codes[b], s)


def _changes(data: bytes) -> int:
    return int(_unpack(data)[-1][0])


def neighbour_graph(nodes: DataFrame, width: int) -> tuple[DataFrame, str]:
    """(block, kind, data) of all blocks after the descent, and the folder that holds them."""
    spark = nodes.sparkSession
    changed = F.udf(_changes, "long")  # of a row per block
    path = scratch_path(spark, "neighbours-0")
    graph = stored(first_lists(nodes, width), path)
    entries = LIST * nodes.count()
    for number in range(1, ROUNDS + 1):
        after = scratch_path(spark, f"neighbours-{number}")
        graph = stored(_by_block(_by_block(graph, _sending), _joining), after)
        discard(spark, path)
        path = after
        moved = graph.where(F.col("kind") == _NODES).agg(F.sum(changed("data"))).first()[0] or 0  # a number per block
        if moved <= CHANGED * entries:
            break
    return graph.where(F.col("kind") == _NODES), path


def _search_rows(block: int, got: dict) -> Iterator[tuple[int, int, bytes]]:
    """What a search needs of a block: vectors, and who is next to whom."""
    for units, lists, _, _, listed, _, _ in got[_NODES]:
        yield block, _NODES, _pack(units, np.concatenate([lists, listed], 1))


def _walk(block: int, got: dict) -> Iterator[tuple[int, int, bytes]]:
    """Each visiting query walks from its nodes to their neighbours in the block as long as they are among its best.

    What comes back has the number of the query in place of the block: scored nodes, and the neighbours
    elsewhere of those it went on from.
    """
    for units, every in got[_NODES]:
        units = units.astype(np.float32)
        for number, vector, start, floor in got[_VISITS]:
            seen, expanded = np.zeros(len(units), bool), np.zeros(len(units), bool)
            score = np.full(len(units), -np.inf, np.float32)
            todo = np.unique(start & ((1 << BITS) - 1))
            while len(todo):
                seen[todo] = True
                score[todo] = units[todo] @ vector
                known = np.flatnonzero(seen)
                best = known[_best(score[None, known], BEAM)[0]]
                best = best[(score[best] >= floor[0]) & ~expanded[best]]
                expanded[best] = True
                near = every[best].ravel()
                near = np.unique(near[(near >= 0) & (near >> BITS == block)]) & ((1 << BITS) - 1)
                todo = near[~seen[near]]
            away = every[expanded]
            away = np.unique(away[(away >= 0) & (away >> BITS != block)])
            known = np.flatnonzero(seen)
            best = known[_best(score[None, known], BEAM)[0]]
            yield int(number[0]), _VISITS, _pack((block << BITS) + best, score[best], away)


def search(graph: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, codes): the nodes found for each query (query: long, code: where it starts, v), the best BEAM of them."""
    spark = queries.sparkSession

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query, code, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                unit = _units(np.array([v]))[0].astype(np.float32)
                out.append((query, _pack(unit, np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.int64), np.array([code]))))
            yield _states(out)

    def _states(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["query", "state"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                unit, _, scores, _, todo = _unpack(data.as_py())
                floor = scores[-1:] if len(scores) == BEAM else np.array([-np.inf], np.float32)
                for block in np.unique(todo >> BITS).tolist():
                    out.append((block, _VISITS, _pack(np.array([query]), unit, todo[todo >> BITS == block], floor)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["block", "kind", "data"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((q, d) for batch in batches for q, d in zip(batch.column(0).to_pylist(), batch.column(2)))
        for query, group in groupby(rows, key=lambda row: row[0]):
            found = [_unpack(d.as_py()) for _, d in group]
            (unit, codes, scores, steps, todo), answered = found[0], found[1:]
            seen = np.cumsum(steps)
            away = np.empty(0, np.int64)
            for c, s, far in answered:
                codes, scores, away = np.r_[codes, c], np.r_[scores, s], np.r_[away, far]
            codes, first = np.unique(codes, return_index=True)
            scores = scores[first]
            seen = np.unique(np.r_[seen, todo, codes])
            best = np.argsort(-scores, kind="stable")[:BEAM]
            # Steps from one number to the next are small, so they travel well.
            yield _states([(query, _pack(unit, codes[best], scores[best], np.diff(seen, prepend=0), np.setdiff1d(away, seen)))])

    n = partitions(spark)
    waiting = F.udf(lambda data: len(_unpack(data)[-1]), "long")
    path = scratch_path(spark, "search-0")
    states, number = stored(queries.select("query", "code", "v").mapInArrow(begin, "query long, state binary"), path), 0
    while (states.agg(F.sum(waiting("state"))).first()[0] or 0) > 0:
        number += 1
        # Queries that are done go along.
        asked = states.mapInArrow(visits, _ROW)
        answered = _by_block(union_all(graph, asked), _walk)
        both = union_all(states.select("query", F.lit(-1).alias("kind"), F.col("state").alias("data")), answered.select(F.col("block").alias("query"), "kind", "data"))
        after = scratch_path(spark, f"search-{number}")
        states = stored(both.repartition(n, "query").sortWithinPartitions("query", "kind").mapInArrow(gather, "query long, state binary"), after)
        discard(spark, path)
        path = after
    codes = F.udf(lambda data: _unpack(data)[1].tolist(), "array<long>")
    out = checkpointed(states.select("query", codes("state").alias("codes")))
    discard(spark, path)
    return out


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found for each query, by cosine: (query_id, rank, ``id_col``, score).

    Queries are the rows where ``is_query`` holds, candidates all rows of another id; ties go to the smaller
    id, and a query with fewer candidates gets all that are found. Rows with a null id, and vectors that are
    null, empty, zero or hold null or non-finite components take no part. Shorter vectors count as padded with
    zeros. Equal vectors are one node, however many rows have them; rows of equal id and vector count once. A
    query id of several vectors is asked with the first in order. The graph is approximate; the score is the
    cosine of the original vectors in double precision. Other columns are not carried.
    """
    spark = df.sparkSession
    vector = F.col(vector_col)
    if df.schema[vector_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        vector = vector.cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    held, width = members(rows.select("id", "v"), k)
    nodes = checkpointed(placed(held, max(width, 1)))
    graph, path = neighbour_graph(nodes, max(width, 1))
    around = scratch_path(spark, "neighbours-search")
    found_in = stored(_by_block(graph, _search_rows), around)
    discard(spark, path)
    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    queries = checkpointed(asked.join(nodes.select("v", "code"), "v").select(F.col("id").alias("query"), "code", "v"))
    found = search(found_in, queries)
    discard(spark, around)
    pairs = found.select("query", F.explode("codes").alias("code")).join(nodes.select("code", F.col("v").alias("w"), "ids"), "code").join(queries.select("query", "v"), "query")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.ldexp(m, -np.frexp(np.abs(m).max(1, initial=0, keepdims=True))[1]) for m in (_matrix(batch.column(c), max(width, 1)) for c in (2, 3)))
            cosine = (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], names=["query", "ids", "score"])

    scored = pairs.select("query", "ids", "v", "w").mapInArrow(score, "query long, ids array<long>, score double").select("query", F.explode("ids").alias("id"), "score").where("id <> query")
    # Rows of one id but different vectors are candidates each.
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
