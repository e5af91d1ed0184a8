"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept per group.

Cells alone would lose pairs that a border parts. A vector is therefore also shown, as a guest, to every
cell that can own a vector within the linking angle, so each vector meets all its partners in its own cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirecheck.llm.shared import components, in_fraction
from quirecheck.sources.checkpoints import checkpointed

#: Vectors of WIDTH numbers that the centres are fitted on, about, and as many numbers of longer ones; all vectors are assigned.
SAMPLE, WIDTH = 20_000, 64
#: Vectors a cell should own, the most cells, and the rounds of k-means.
CELL, CELLS, ROUNDS = 2_000, 1_024, 8
#: Rows on either side of one matrix product.
TILE = 1_024


def usable(vector: Column) -> Column:
    """True for a vector with finite components, not all of them zero."""
    limit = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_centres(nodes: DataFrame, total: int, dim: int, seed: int = 7) -> np.ndarray:
    """Unit centres of spherical k-means, fitted on a sample of bounded size of the vectors of length ``dim``."""
    most = SAMPLE * WIDTH / max(dim, WIDTH)
    k = max(1, min(CELLS, total // CELL, int(most)))
    drawn = nodes.where((F.size("v") == dim) & in_fraction(F.xxhash64("node"), most / max(total, 1))).select("node", "v").collect()
    points = np.array([r["v"] for r in sorted(drawn)], np.float64).reshape(-1, dim)
    points = _units(points)
    k = max(1, min(k, len(points)))
    centres = points[np.random.default_rng(seed).permutation(len(points))[:k]] if len(points) else np.eye(1, dim)
    for _ in range(ROUNDS):
        home = (points @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def _units(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True, initial=0), 1e-300)  # so squares can't overflow
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """Every row with its links: (id_col, n_links, component_id, kept).

    Rows link where labels are equal and not null, lengths are equal and the cosine is at least
    ``threshold`` (above 0). ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest id reachable, ``kept`` marks the row that stands for its group. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing. Equal vectors are one node with a count,
    so copies are never paired. Ids should be unique; a null id never names a group unless it is alone.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    ok = F.col("label").isNotNull() & usable(F.col("v"))
    rows = rows.select("id", "label", F.when(ok, F.col("v")).alias("v")).withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")))
    nodes = checkpointed(rows.where("v is not null").groupBy("label", "node", "v").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    sizes = nodes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        results = rows.sparkSession.createDataFrame([], f"node long, links long, component {df.schema[id_col].dataType.simpleString()}")
    else:
        centres = fit_centres(nodes, sizes["n"], sizes["dim"])
        met = checkpointed(_compare(_cells(nodes, centres, threshold), threshold))
        counts = met.groupBy("node").agg(F.sum("links").alias("others"))
        groups = components(met.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
        owned = nodes.select("node", "n", "least").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = owned.groupBy("component").agg(F.min("least").alias("named"))
        results = owned.join(least, "component").join(counts, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.col("named").alias("component"))
    component = F.coalesce("component", "id")
    return rows.select("id", "node").join(results, "node", "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def _cells(nodes: DataFrame, centres: np.ndarray, threshold: float) -> DataFrame:
    """(label, dim, cell, home, node, n, unit): each vector in its own cell and as a guest elsewhere.

    A vector y of cell j has y.c_j >= y.c_i for the centre c_i of x. Within the angle t of x that needs
    x.(c_i - c_j) <= sin(t) |c_i - c_j|, which is what decides on a guest.
    """
    held = nodes.sparkSession.sparkContext.broadcast(centres)  # CELLS x dim numbers at most
    slack = float(np.sqrt(1 - min(threshold, 1.0) ** 2)) if threshold > 0 else 1.0

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                vectors = batch.column("v").to_pylist()
                dims = np.array([len(v) for v in vectors])
                units: list = [_units(np.array([v], np.float64))[0] for v in vectors]
                own = np.flatnonzero(dims == c.shape[1])  # other lengths have one cell of their own
                home = np.zeros(len(vectors), np.int64)
                guests = np.zeros((len(vectors), len(c)), bool)
                if len(own):
                    s = np.array([units[i] for i in own]) @ c.T
                    home[own] = s.argmax(1)
                    guests[own] = s.max(1, keepdims=True) - s <= slack * apart[home[own]] + 1e-9
                guests[np.arange(len(vectors)), home] = True
                row, cell = np.nonzero(guests)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("label"), pa.array(dims[row].astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(home[row] == cell), taken.column("node"), taken.column("n"), pa.array([units[i].tobytes() for i in row], pa.binary())],
                    names=["label", "dim", "cell", "home", "node", "n", "unit"],
                )

    label = nodes.schema["label"].dataType.simpleString()
    return nodes.select("label", "node", "n", "v").mapInArrow(assign, f"label {label}, dim int, cell int, home boolean, node long, n long, unit binary")


def _compare(cells: DataFrame, threshold: float) -> DataFrame:
    """(node, links, other): counts of linked rows for owners of a cell, and links that join groups."""
    cells = checkpointed(cells)
    key = ["label", "dim", "cell"]
    sizes = cells.groupBy(*key).agg(F.ceil(F.count_if("home") / TILE).cast("int").alias("owners"), F.ceil(F.count("*") / TILE).cast("int").alias("all"))
    dealt = cells.join(sizes, key)
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.col(n), F.lit(1)))
    # Owners meet every block of their cell; a cell of any size becomes products of bounded size.
    as_owner = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda j: F.struct(F.lit(True).alias("asks"), block("owners").cast("int").alias("p"), j.alias("q"))))
    as_row = F.when(F.col("owners") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("owners"), F.lit(1)) - 1), lambda i: F.struct(F.lit(False).alias("asks"), i.alias("p"), block("all").cast("int").alias("q"))))
    none = F.lit([]).cast("array<struct<asks:boolean,p:int,q:int>>")
    tiles = dealt.select(*key, "node", "n", "unit", F.explode(F.concat(F.coalesce(as_owner, none), F.coalesce(as_row, none))).alias("t")).select(*key, "t.*", "node", "n", "unit")

    def product(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(bool)
        left, right = group[asks], group[~asks]
        out = pd.DataFrame({"node": left["node"].to_numpy(np.int64), "links": np.zeros(len(left), np.int64), "other": pd.array([pd.NA] * len(left), "Int64")})
        if left.empty or right.empty:
            return out
        a, b = (np.frombuffer(b"".join(x["unit"]), np.float64).reshape(len(x), -1) for x in (left, right))
        a_ids, b_ids = left["node"].to_numpy(np.int64), right["node"].to_numpy(np.int64)
        near = (a @ b.T >= threshold) & (a_ids[:, None] != b_ids[None, :])
        out["links"] = near.astype(np.int64) @ right["n"].to_numpy(np.int64)
        # Of the links only a forest goes on: enough for the groups, however dense they are.
        ids, where = np.unique(np.concatenate([a_ids, b_ids]), return_inverse=True)
        part = np.arange(len(ids))
        edges = []
        for i in np.flatnonzero(near.any(1)):
            met = where[len(a_ids) + np.flatnonzero(near[i])]
            mine = part[where[i]]
            others, first = np.unique(part[met], return_index=True)
            for root, at in zip(others, first):
                if root != mine:
                    edges.append((a_ids[i], ids[met[at]]))
                    part[part == root] = mine
        more = pd.DataFrame({"node": np.array([e[0] for e in edges], np.int64), "links": np.zeros(len(edges), np.int64), "other": pd.array([e[1] for e in edges], "Int64")})
        return pd.concat([out, more], ignore_index=True) if edges else out

    return tiles.groupBy(*key, "p", "q").applyInPandas(product, "node long, links long, other long")
