"""Trees against a plain walk, held-out accuracy, and odd rows."""

import zlib

import numpy as np

from quirecheck.llm import quality
from quirecheck.llm.queries import op4_quality
from tests.support import session

SF_DIR = "/root/testdata/sf0.01"


def plain_walk(trees, row):
    total = trees.base
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
        at = 0
        while at < len(feature):
            at = 2 * at + (2 if row[feature[at]] > threshold[at] else 1)
        total += leaf[at - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_match_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.fit(x[:600], y[:600])
    scores = trees.score(x)
    assert np.allclose(scores, [plain_walk(trees, r) for r in x])
    assert ((scores[600:] > 0.5) == y[600:]).mean() > 0.93
    assert trees.score(np.empty((0, 5))).shape == (0,)


def test_query_on_held_out_labels():
    spark = session()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = op4_quality(spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_odd_rows():
    spark = session()
    schema = "doc_id long, text string, x int, score string"
    texts = [(1, None, 1, "a"), (2, "", 1, "a"), (2, "", 1, "a"), (None, "a b c", 1, "a"), (3, "long " * 200_000, 1, "a"), (4, "\x00�|", 1, "a")]
    df = spark.createDataFrame(texts, schema)
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 0), (99, 1)], "doc_id long, quality int")
    rows = quality.score_quality(df, labels).collect()
    assert len(rows) == len(texts) and len({r["score"] for r in rows}) == 1  # one kind of label: the base rate
    both = quality.score_quality(df, spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0)], "doc_id long, quality int")).collect()
    assert all(0 <= r["score"] <= 1 for r in both)
    assert quality.score_quality(df.limit(0), labels).count() == 0
    assert quality.score_quality(df, labels.limit(0)).count() == len(texts)


def test_repeated_ids_are_learned_from_once():
    spark = session()
    labels = spark.createDataFrame([(n, n % 2) for n in range(1, 60)], "doc_id long, quality int")
    clashing = labels.selectExpr("doc_id", "1 as quality")
    docs = spark.createDataFrame([(n, "fine words of a text. " * 9 if n % 2 else "!! 0 !") for n in range(1, 60)], "doc_id long, text string")
    once = quality.drawn_labels(labels, "doc_id", "quality", 5)
    many = quality.drawn_labels(labels.union(clashing).union(labels), "doc_id", "quality", 5)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, once.collect()))
    want = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    got = quality.score_quality(docs.union(docs), labels.union(labels)).collect()
    assert len(got) == 2 * len(want) and all(r["score"] == want[r["doc_id"]] for r in got)
