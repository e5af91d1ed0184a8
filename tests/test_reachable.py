"""Reachability by contraction, and reports compared as multisets, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quirecheck.operators import incremental as J, structure
from tests.support import session


@pytest.fixture(scope="module")
def spark():
    return session()


def plain(edges, roots):
    seen, todo = set(roots), list(roots)
    while todo:
        doc, node = todo.pop()
        for d, s, t in edges:
            if (d, s) == (doc, node) and (d, t) not in seen:
                seen.add((d, t))
                todo.append((d, t))
    return seen


def reached(spark, edges, roots):
    e = spark.createDataFrame(edges, "doc_id long, src long, dst long")
    rows = structure.reachable(e, spark.createDataFrame(roots, "doc_id long, node long")).collect()
    got = [(r.doc_id, r.node) for r in rows]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("levels", [0, 2])
def test_random_graphs(spark, monkeypatch, levels):
    """Sparse to dense documents at once: cycles, loops, repeated edges, several roots, roots with ways in, no roots."""
    monkeypatch.setattr(structure, "SHALLOW", levels)
    rng = random.Random(4)
    edges, roots = [], []
    for doc in range(150):
        n = rng.randint(1, 14)
        for _ in range(rng.randint(0, n + rng.randint(0, n))):
            edges += [(doc, rng.randrange(n), rng.randrange(n))] * rng.choice([1, 1, 2])
        roots += [(doc, rng.randrange(n)) for _ in range(rng.randint(0, 3))]
    assert reached(spark, edges, roots) == plain(edges, roots)


def test_long_chain_of_diamonds_and_cycles(spark):
    """Every other node has two ways in, which go together; a cycle with a tail no root reaches; null ends."""
    edges = []
    for k in range(0, 600, 3):
        edges += [(1, k, k + 1), (1, k, k + 2), (1, k + 1, k + 3), (1, k + 2, k + 3)]
    edges += [(1, 900, 901), (1, 901, 900), (1, 901, 902), (1, None, 903), (1, 0, None)]
    assert reached(spark, edges, [(1, 0), (1, 0), (1, None)]) == {(1, k) for k in range(601)}
    assert reached(spark, [], [(1, 0)]) == {(1, 0)}
    assert reached(spark, edges, []) == set()


def test_chain_of_100_000_objects_in_few_rounds(spark, monkeypatch):
    written = []
    original = structure.checkpointed
    monkeypatch.setattr(structure, "checkpointed", lambda df: written.append(1) or original(df))
    chain = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    roots = spark.range(1).select(F.lit(1).alias("doc_id"), F.col("id").alias("node"))
    got = structure.reachable(chain, roots).agg(F.count("*"), F.max("node")).first()
    assert tuple(got) == (100_001, 100_000) and len(written) <= 28


def test_changed_reports(spark):
    schema = "doc_id long, id string, severity string, check_name string, message string"
    one, two, null = ("Q-1", "error", "c", "m"), ("Q-2", "error", "c", "m"), ("Q-3", None, "c", "m")
    e = [(1, *one), (1, *two), (2, *one), (2, *one), (3, *null), (4, *one), (6, *one), (6, *two)]
    a = [(1, *two), (1, *one), (2, *one), (3, "Q-3", "c", None, "m"), (5, *one), (6, *one), (6, *one)]
    left, right = spark.createDataFrame(e, schema), spark.createDataFrame(a, schema)
    assert {r.doc_id for r in J.changed_reports(left, right).collect()} == {2, 3, 4, 5, 6}
    fields = spark.createDataFrame([(d, "ok") for d in range(1, 7)], "doc_id long, status string")
    got = {(r.doc_id, r.difference) for r in J.golden_diff(fields, fields, left, right).collect()}
    assert got == {
        (3, "missing: Q-3 | null | c | m"), (3, "unexpected: Q-3 | c | null | m"),
        (4, "missing: Q-1 | error | c | m"), (5, "unexpected: Q-1 | error | c | m"), (6, "missing: Q-2 | error | c | m"),
    }
