"""Exact top-k by inner product: tiled matrix products, running selection per shard, tree merge.

A task holds one shard of the candidates, of a bounded number of tiles, and streams the queries past it, tile by tile.
A query leaves a shard with its k best there, so what travels grows with queries times shards, not with pairs of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirecheck.llm.shared import partitions
from quirecheck.operators.unions import union_all
from quirecheck.sources.checkpoints import scratch_path, stored

#: Vectors in one tile, of queries or of candidates; this bounds a product to TILE x TILE numbers.
TILE = 1024
#: Tiles of candidates held by a task.
SHARD = 256
#: Lists merged by one task of the tree for one query.
FAN_IN = 16
#: Integers up to here are exact in double precision.
EXACT = 2.0**53


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null where the vector is null, empty or not finite."""
    doubles = vector.cast("array<double>")
    limit = F.lit(float("inf"))
    finite = (F.size(doubles) > 0) & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return F.when(finite, F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """The ``k`` highest integer inner products of each query: (query_id, rank, ``id_col``, score).

    ``vector_col`` holds arrays of long. Queries are the rows where ``is_query`` holds; candidates are all
    rows whose id differs from the query's. Ties go to the smaller id; a query with fewer candidates gets
    all. Rows with a null id or vector take no part. Shorter vectors count as padded with zeros. Repeated
    rows are separate candidates; a query id that occurs twice is asked once, with its first vector in order.
    Scores wrap as 64-bit integers do. Every pair of a query and a row is scored: queries travel in tiles to
    every shard of the rows, never row by row. The tiles of the rows are written to the shared folder.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    packed = rows.select("id", "v").repartition(n, F.xxhash64("id", "v")).mapInArrow(_pack, TILES)
    tiles = stored(packed, scratch_path(spark, "top-k-tiles"))
    # One entry for each shard of SHARD tiles.
    places = sorted((r["part"], r["chunk"]) for r in tiles.select("part", "chunk").distinct().collect())
    shards = spark.createDataFrame([(*place, i) for i, place in enumerate(places)], "part int, chunk int, shard int")
    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("v")).mapInArrow(_pack, TILES)
    to_columns = lambda df, query: df.select("shard", F.lit(query).alias("query"), "ids", "matrix", "width")
    sent = union_all(to_columns(tiles.join(shards, ["part", "chunk"]), False), to_columns(asked.crossJoin(shards.select("shard")), True))
    width = max(1, len(places))
    dealt = sent.repartitionById(width, F.col("shard")).sortWithinPartitions("shard", "query")
    lists = dealt.mapInArrow(_best(k), "query_id long, shard int, best array<struct<minus:decimal(20,0),id:long>>")
    while True:
        width = -(-width // FAN_IN)
        lists = lists.withColumn("shard", F.col("shard") % width) if width > 1 else lists.withColumn("shard", F.lit(0))
        lists = lists.groupBy("query_id", "shard").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        if width == 1:
            break
    return lists.select("query_id", F.posexplode("best").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.minus")).cast("long").alias("score")
    )


TILES = "part int, chunk int, ids binary, matrix binary, width int"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as tiles of at most TILE vectors, in order of their ids, in the smallest integers that hold them."""
    part, made = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    vectors: list[list[int]] = []

    def tile():
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        width = max(1, *map(len, vectors))
        matrix = np.zeros((len(ids), width), np.int64)
        for to, i in enumerate(order):
            matrix[to, : len(vectors[i])] = vectors[i]
        kind = next(t for t in KINDS if np.iinfo(t).min <= matrix.min() and matrix.max() <= np.iinfo(t).max)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([made // SHARD], pa.int32()), pa.array([np.array(ids, np.int64)[order].tobytes()], pa.binary()), pa.array([matrix.astype(kind).tobytes()], pa.binary()), pa.array([width], pa.int32())],
            names=["part", "chunk", "ids", "matrix", "width"],
        )

    for batch in batches:
        for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
            ids.append(i)
            vectors.append(v)
            if len(ids) == TILE:
                yield tile()
                made += 1
                ids, vectors = [], []
    if ids:
        yield tile()


#: Little-endian integers of a tile.
KINDS = ("<i1", "<i2", "<i4", "<i8")


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["matrix"], f"<i{len(row['matrix']) // (len(ids) * row['width'])}").reshape(len(ids), -1)


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows; the narrower side counts as padded with zeros."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    x, y = a.astype(np.float64), b.astype(np.float64)
    if float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * width < EXACT:  # the matrix product in doubles is exact then, and much faster
        return (x @ y.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(k: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                if row["shard"] != shard:
                    shard, held = row["shard"], []
                if not row["query"]:
                    held.append(_unpacked(row))
                    continue
                q_ids, q = _unpacked(row)
                found = _running(q_ids, q, held, k)
                lists = [[{"minus": -score, "id": i} for score, i in one] for one in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids, pa.int64()), pa.array(np.full(len(q_ids), shard, np.int32)), pa.array(lists, pa.list_(pa.struct([("minus", pa.decimal128(20, 0)), ("id", pa.int64())])))],
                    names=["query_id", "shard", "best"],
                )

    return best


def _running(q_ids: np.ndarray, q: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[int, int]]]:
    """The k best (score, id) of each query over all tiles."""
    best: list[list[tuple[int, int]]] = [[] for _ in q_ids]
    least = np.full(len(q_ids), np.iinfo(np.int64).min)
    for ids, matrix in held:
        scores = _inner(q, matrix)
        able = scores >= least[:, None]
        for i in np.flatnonzero(able.any(1)).tolist():
            # The query's own rows, however many they are, take no places.
            others = np.flatnonzero(able[i] & (ids != q_ids[i]))
            kept = scores[i, others]
            if len(kept) > k:
                edge = np.partition(kept, len(kept) - k)[len(kept) - k]
                others = others[np.concatenate([np.flatnonzero(kept > edge), np.flatnonzero(kept == edge)[:k]])]
            best[i] = sorted(best[i] + list(zip(scores[i, others].tolist(), ids[others].tolist())), key=lambda x: (-x[0], x[1]))[:k]
            if len(best[i]) == k:
                least[i] = best[i][-1][0]
    return best
