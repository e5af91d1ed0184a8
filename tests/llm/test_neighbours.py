"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirecheck.llm import neighbours
from quirecheck.llm.queries import QUERIES
from tests.support import session

SF_DIR = "/root/testdata/sf0.01"


def brute(rows, queries, k):
    """{query: [(id, cosine)]} over rows (id, vector), vectors padded with zeros."""
    width = max(len(v) for _, v in rows)
    ids = np.array([i for i, _ in rows])
    m = np.array([list(v) + [0.0] * (width - len(v)) for _, v in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = m @ m[np.flatnonzero(ids == q)[0]]
        other = np.flatnonzero(ids != q)
        best = other[np.lexsort((ids[other], -np.round(s[other], 12)))[:k]]
        out[q] = [(int(ids[i]), float(s[i])) for i in best]
    return out


def recall(got, want):
    found: dict = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    share = []
    for q, best in want.items():
        mine = [found[q][rank] for rank in sorted(found[q])]
        assert sorted(found[q]) == list(range(1, len(best) + 1))
        assert mine == sorted(mine, key=lambda x: (-x[1], x[0]))
        share.append(len({i for i, _ in mine} & {i for i, _ in best}) / len(best))
    return float(np.mean(share))


@pytest.mark.parametrize("block", [4_096, 100])
def test_recall_and_scores(monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + rng.normal(size=16) * 0.7).tolist()) for i in range(2_000)]
    df = session().createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, code string, rank int")
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    want = brute(rows, range(0, 2_000, 50), 5)
    assert recall(got, want) >= 0.97
    vectors = {i: np.array(v) for i, v in rows}
    for r in got:
        a, b = vectors[r["query_id"]], vectors[r["vec_id"]]
        assert abs(r["score"] - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_odd_rows():
    spark = session()
    odd = [None, [], [0.0] * 4, [float("nan")] * 4, [float("inf"), 1.0, 1.0, 1.0], [None, 1.0, 1.0, 1.0]]
    rows = [(1_000 + i, v) for i, v in enumerate(odd)] + [(None, [1.0, 0.0, 0.0, 0.0])]
    good = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0, 0.0]), (3, [1e200, 1e200, 0.0, 0.0]), (4, [1e-200, 0.0]), (5, [-1.0, -0.0, 0.0, 0.0]), (5, [-1.0, -0.0, 0.0, 0.0])]
    good += [(10 + i, [3.0, 4.0, 0.0, 0.0]) for i in range(300)]
    df = spark.createDataFrame(rows + good, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in neighbours.nearest(df, F.col("vec_id").isin(0, 5, 12, 1_000, 1_001), k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    half = round(0.5**0.5, 9)
    assert got == {0: [(1, 1.0), (2, 1.0), (4, 1.0), (3, half)], 5: [(i, -0.6) for i in (10, 11, 12, 13)], 12: [(i, 1.0) for i in (10, 11, 13, 14)]}
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(df.where("vec_id < 2"), F.lit(True)).count() == 2
    assert neighbours.nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0
    assert neighbours.nearest(df, F.col("vec_id") == 1_000).count() == 0
    floats = df.where("vec_id < 3").selectExpr("cast(vec_id as int) as i", "cast(embedding as array<float>) as e")
    assert neighbours.nearest(floats, F.col("i") == 0, id_col="i", vector_col="e").count() == 2


def test_many_vectors_of_one_direction(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    rng = np.random.default_rng(1)
    rows = [(i, [float(i + 1), 0.0, 0.0]) for i in range(300)] + [(1_000 + i, rng.normal(size=3).tolist()) for i in range(300)]
    df = session().createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert len(got) == 12 * 5
    assert all(r["score"] > 1 - 1e-12 for r in got if r["query_id"] < 300)


def test_query_recall():
    spark = session()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    got = QUERIES["op12_neighbours"](spark, SF_DIR).collect()
    assert recall(got, brute(rows, [i for i, _ in rows if i % 50 == 0], 5)) >= 0.9
