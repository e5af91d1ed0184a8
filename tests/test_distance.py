"""Edit distance by bit vectors, and differences of lines, against plain versions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirecheck.functions import distance as D, text as T
from tests.support import session


@pytest.fixture(scope="module")
def spark():
    return session()


def plain(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def edited(rng, a, count, kinds):
    b = list(a)
    for _ in range(count):
        if b and rng.random() < 0.5:
            b.pop(rng.randrange(len(b)))
        else:
            b.insert(rng.randint(0, len(b)), rng.randrange(kinds))
    return b


@pytest.mark.parametrize("first, packed", [(1, 12), (2, 0), (3, 2), (64, 12)])
def test_distance_equals_plain(monkeypatch, first, packed):
    monkeypatch.setattr(D, "FIRST_BAND", first)
    monkeypatch.setattr(D, "PACKED", packed)
    rng = random.Random(first)
    for _ in range(1500):
        kinds = rng.choice([1, 2, 4, 30])
        a = [rng.randrange(kinds) for _ in range(rng.randint(0, 30))]
        other = [rng.randrange(kinds) for _ in range(rng.randint(0, 30))]
        b = edited(rng, a, rng.randint(0, 6), kinds) if rng.random() < 0.5 else other
        assert D.distance(np.array(a, dtype=int), np.array(b, dtype=int)) == plain(a, b), (a, b)


def test_a_million_words_with_few_changes(spark):
    rng = random.Random(5)
    a = [f"w{min(int(rng.paretovariate(0.6)), 50_000)}" for _ in range(1_000_000)]
    b = list(a)
    for p in rng.sample(range(0, 1_000_000, 10), 30):
        b[p] = "other"
    del b[500_003]
    started = time.time()
    row = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string")
    assert row.select(D.list_distance(T.tokens(F.col("a")), T.tokens(F.col("b"))).alias("d")).first().d == 31
    assert time.time() - started < 60


def test_long_texts_are_matched_by_code_points(spark):
    a = "é𝄞ab" * 1_000
    b = a[:1_500] + "ñ" + a[1_501:] + "xy"
    df = spark.createDataFrame([(a, b), (None, b), (a, None), ("", ""), ("abc", "abd")], "a string, b string")
    got = [r.s for r in df.select(T.similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == 1 - 3 / 4_002 and got[1:4] == [None, None, 1.0] and abs(got[4] - 2 / 3) < 1e-12


def test_line_differences_equal_plain(spark):
    rng = random.Random(2)
    pick = lambda: "\n".join(rng.choice(["a", "b", "", "c c", "dé"]) for _ in range(rng.randint(0, 6)))
    rows = [(i, None if i % 9 == 1 else pick(), None if i % 11 == 2 else pick()) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, a string, b string").coalesce(2)
    lists, sample = T.line_diff(F.col("a"), F.col("b")), T.diff_sample(F.col("a"), F.col("b"), 2)
    for r in df.select("a", "b", lists.alias("d"), sample.alias("s")).collect():
        if r.a is None or r.b is None:
            assert r.d is None and r.s is None
            continue
        x, y = ([v for v in side.split("\n") if v] for side in (r.a, r.b))
        gone, new = [v for v in x if v not in y], [v for v in y if v not in x]
        assert r.d == ["-" + v for v in gone] + ["+" + v for v in new]
        assert r.s == "".join(f" | -{v}" for v in gone[:2]) + "".join(f" | +{v}" for v in new[:2])
