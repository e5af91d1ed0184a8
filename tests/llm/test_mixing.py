"""Targets, flow and taken words against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quirecheck.llm import mixing
from quirecheck.llm.queries import op7_mixing
from tests.support import session

SF_DIR = "/root/testdata/sf0.01"


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = {s: 1.5 * sum(sizes.values()) * weight[s] / sum(weight.values()) for s in order}
    while any(target[s] > 2 * sizes[s] + 1e-9 for s in order):
        excess = sum(max(0, target[s] - 2 * sizes[s]) for s in order)
        target = {s: min(target[s], 2 * sizes[s]) for s in order}
        free = [s for s in order if target[s] < 2 * sizes[s] - 1e-9]
        if not free:
            break
        for s in free:
            target[s] += excess * weight[s] / sum(weight[x] for x in free)
    return target


def check(rows, texts):
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (t, _) in texts.items()}
    totals = {}
    for i, (_, s) in texts.items():
        totals[s] = totals.get(s, 0) + sizes[i]
    want, taken = plain_targets(totals), dict.fromkeys(totals, 0)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        source = texts[r["doc_id"]][1]
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == totals[source]
        assert r["target"] == pytest.approx(want[source])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source] += r["taken"]
    largest = {s: max([0, *(sizes[i] for i, (_, x) in texts.items() if x == s)]) for s in totals}
    for s in totals:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1


def test_query_and_rerun():
    spark = session()
    texts = {r["doc_id"]: (r["text"], r["source"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op7_mixing(spark, SF_DIR).collect()
    check(rows, texts)
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    try:
        assert sorted(op7_mixing(spark, SF_DIR).collect()) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_odd_rows(tmp_path):
    spark, rng = session(), random.Random(3)
    texts = {i: ("w " * rng.randrange(60), rng.choice(["a", "b", None, "", "é", "Z"])) for i in range(300)}
    texts |= {900: (None, "a"), 901: ("", "only empty"), 902: ("w " * 200_000, "b"), 903: ("one", "single")}
    spark.createDataFrame([(i, t, s, 1, "x") for i, (t, s) in texts.items()], "doc_id long, text string, source string, size int, copies string").write.parquet(f"{tmp_path}/documents.parquet")
    check(op7_mixing(spark, str(tmp_path)).collect(), texts)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.mix_by_source(df.limit(0)).count() == 0
    repeated = df.where("doc_id < 3").unionByName(df.where("doc_id < 3")).withColumn("doc_id", F.lit(None).cast("long"))
    assert mixing.mix_by_source(repeated).count() == 6


def test_overlapping_sources_use_the_free_copy_first():
    # b can be filled from the shared documents alone, a then needs no repetition either.
    wanted = mixing.copies({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 100, "b": 110})
    assert wanted == {("a",): 1.0, ("a", "b"): 1.0, ("b",): 1.0}
    wanted = mixing.copies({("a",): 100, ("b",): 50, (): 7}, {"a": 150, "b": 500})
    assert wanted == {("a",): 1.5, ("b",): 2.0, (): 0.0}


def test_overlapping_rows():
    spark = session()
    kinds = [["a"], ["a", "b"], ["b", "a"], ["b"], ["c", None], []]
    df = spark.createDataFrame([(i, kinds[i % 6], 10) for i in range(600)], "id long, sources array<string>, size long")
    out = mixing.mix(df, {"a": 1500.0, "b": 2500.0, "c": 500.0, None: 0.0}).groupBy("sources").agg(F.sum("copies").alias("n")).collect()
    n = {tuple(r["sources"]): r["n"] for r in out}
    assert n[()] == 0 and n[("c", None)] == 50
    assert abs(sum(n.values()) - 450) <= 4 and all(v <= 200 for v in n.values())
