"""SimHash near duplicates with BK-trees.

Fingerprints within a few bits agree in whole blocks of bits, so they meet in the shards of those blocks.
Each shard is indexed by BK-trees of bounded size, whose children are keyed by their distance to the
parent; every other block of the shard is sent to the tree and follows only the edges within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirecheck.llm.shared import components, partitions
from quirecheck.sources.checkpoints import checkpointed

SEED = 42  # fixed: the seed of the shingle hash
#: Fingerprints in one tree, queries followed down at once, and shingles hashed at once.
TREE, FRONT, SHINGLES = 4_096, 256, 1 << 16
#: Up to this many fingerprints a shard is searched one by one.
FEW = 24


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64 bits, signed: a bit is set if it is set in over half of the hashes of the word shingles."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLES):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + SHINGLES], last[at : at + SHINGLES])], np.uint64)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def with_fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """(id, fp) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


class BKTree:
    """Fingerprints (unsigned ints); the children of a node are keyed by their distance to it."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        for i in range(1, len(values)):
            at = 0
            while True:
                d = (values[i] ^ values[at]).bit_count()
                held = self.children[at].setdefault(d, i)
                if held == i:
                    break
                at = held

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values within ``radius``."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            todo += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]
        return found

    def within_many(self, values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for many values, level by level: pairs (place among ``values``, place in the tree)."""
        own = np.array(self.values, np.uint64)
        flat = [(k, c) for children in self.children for k, c in children.items()]
        edge = np.array([k for k, _ in flat], np.int16)
        child = np.array([c for _, c in flat], np.int64)
        begin = np.concatenate([[0], np.cumsum([len(c) for c in self.children])])
        for start in range(0, len(values), FRONT):
            asks = values[start : start + FRONT]
            who, at = np.arange(len(asks)), np.zeros(len(asks), np.int64)
            while len(who):
                d = np.bitwise_count(asks[who] ^ own[at]).astype(np.int16)
                near = d <= radius
                yield who[near] + start, at[near]
                fan = begin[at + 1] - begin[at]
                place = np.repeat(begin[at] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
                who, d = np.repeat(who, fan), np.repeat(d, fan)
                go = np.abs(edge[place] - d) <= radius
                who, at = who[go], child[place[go]]


def _forest(values: np.ndarray, sides: np.ndarray, p: int, q: int, radius: int) -> list[tuple[int, int]]:
    """Links of a shard that join its groups: within block ``p`` if p = q, else from block q to the tree of p."""
    tree_of, asking = np.flatnonzero(sides == p), np.flatnonzero(sides == q)
    unsigned = values.view(np.uint64)
    tree = BKTree(unsigned[tree_of].tolist())
    if len(values) <= FEW:
        found = ((i, int(tree_of[j])) for i in asking.tolist() for j in tree.within(int(unsigned[i]), radius))
        return _joining(found, np.arange(len(values)), values)
    group, edges = np.arange(len(values)), []
    for who, at in tree.within_many(unsigned[asking], radius):
        i, j = asking[who], tree_of[at]
        a, b = group[i], group[j]
        apart = np.flatnonzero(a != b)
        if len(apart):  # one link for each pair of groups is enough
            pair = np.minimum(a, b)[apart] * len(values) + np.maximum(a, b)[apart]
            one = apart[np.unique(pair, return_index=True)[1]]
            edges += _joining(zip(i[one].tolist(), j[one].tolist()), group, values)
    return edges


def _joining(found, group: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
    """The links among ``found`` that join two groups; ``group`` is kept up to date."""
    edges = []
    for i, j in found:
        if group[i] != group[j]:
            group[group == group[i]] = group[j]
            edges.append((int(values[i]), int(values[j])))
    return edges


def block_keys(fp: Column, radius: int, spare: int = 2) -> Column:
    """Array of shard keys: each choice of ``spare`` of ``radius + spare`` blocks of the 64 bits, with its bits.

    At most ``radius`` blocks can differ between linked fingerprints, so at least ``spare`` agree.
    """
    blocks = radius + spare
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), spare)):
        key = F.lit(number).cast("long")
        for i in chosen:
            width = cuts[i + 1] - cuts[i]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return F.array(*keys)


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """A forest of links (a, b) over the distinct fingerprints ``fp``: it has the groups of all links."""
    n = partitions(prints.sparkSession)
    meets = prints.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("key"))
    shards = meets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / TREE).cast("int").alias("blocks"))
    dealt = meets.join(shards, "key").withColumn("side", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("side", j).alias("p"), F.greatest("side", j).alias("q")))
    dealt = dealt.select("key", "side", "fp", F.explode(pairs).alias("t")).select("key", "t.p", "t.q", "side", "fp")
    return dealt.repartition(n, "key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_linker(radius), "a long, b long")


def _linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((5, 0), np.int64)  # rows of the last shard, which may go on in the next batch

        def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not rows.shape[1]:
                return
            cut = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1
            edges = []
            for a, b in zip([0, *cut], [*cut, rows.shape[1]]):
                if b - a > 1:
                    edges += _forest(np.ascontiguousarray(rows[4, a:b]), rows[3, a:b], int(rows[1, a]), int(rows[2, a]), radius)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

        for batch in batches:
            rows = np.concatenate([held, np.array([batch.column(c).to_numpy() for c in ("key", "p", "q", "side", "fp")], np.int64)], axis=1)
            same = (rows[:3] == rows[:3, -1:]).all(0) if rows.shape[1] else np.empty(0, bool)
            whole = int(np.argmax(same)) if same.any() else 0
            yield from found(rows[:, :whole])
            held = rows[:, whole:]
        yield from found(held)

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id), one row per row of ``df``.

    Fingerprints that differ in at most ``radius`` bits link; ``component_id`` is the smallest id reachable.
    Null and empty texts have fingerprint zero, which links like any other; texts of fewer words than a
    shingle are one shingle. Rows with equal fingerprints are one node, however many they are. A null id
    gets its group's smallest id. Other columns are not carried.
    """
    rows = checkpointed(with_fingerprints(df, id_col, text_col, shingle))
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    groups = components(links(nodes.select("fp"), radius))
    owned = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = owned.join(owned.groupBy("component").agg(F.min("least").alias("named")), "component").select("fp", "named")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("named").alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of ``df``, with all columns, that stand for their groups: the smallest id, then the smallest hash of the row."""
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(*df.columns).alias("hash"))
    groups = near_duplicates(df.select(row.alias("_row"), F.col(text_col).alias("_text")), "_row", "_text", radius, shingle)
    kept = groups.where(F.col("_row") == F.col("component_id")).select("_row.hash", F.col("_row.id").alias("_id")).distinct()
    packed = df.select(F.struct(*df.columns).alias("row"), F.xxhash64(*df.columns).alias("row_hash"))
    found = packed.join(kept, (F.col("row_hash") == F.col("hash")) & F.col(f"row.{id_col}").eqNullSafe(F.col("_id")), "left_semi")
    return found.dropDuplicates(["row_hash"]).select("row.*")
