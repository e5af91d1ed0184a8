"""Every stage on what its predecessor kept, against plain versions."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from quirecheck.llm.queries import op4_quality
from quirecheck.sources.checkpoints import scratch_path
from tests.llm.test_bpe import LIBRARY
from tests.llm.test_mixing import plain_targets
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_secrets import plain_base
from tests.support import session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept():
    """Rows after each stage; the first is the input."""
    spark = session()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        rows.append(docs.collect())
    return rows


def test_columns(kept):
    assert all(list(rows[0].asDict()) == list(kept[0][0].asDict()) for rows in kept[:-1])


def test_quality(kept):
    good = {r["doc_id"] for r in op4_quality(session(), SF_DIR).collect() if r["predicted"]}
    assert sorted(kept[1]) == sorted(r for r in kept[0] if r["doc_id"] in good)
    assert 0 < len(kept[1]) < len(kept[0])


def test_near_duplicates(kept):
    ids = plain_kept({r["doc_id"]: r["text"] for r in kept[1]})
    assert sorted(kept[2]) == sorted(r for r in kept[1] if r["doc_id"] in ids)
    assert len(kept[2]) < len(kept[1])


def test_secrets(kept):
    before = {r["doc_id"]: r for r in kept[2]}
    assert len(kept[3]) == len(before)
    for r in kept[3]:
        old = before[r["doc_id"]]
        if not plain_base(old["text"]):
            assert r["text"] == old["text"] or "[SECRET]" in r["text"]
        else:
            assert not plain_base(r["text"]) and "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])


def test_mixing(kept):
    size = {r["doc_id"]: len(r["text"].encode().split()) for r in kept[3]}
    source = {r["doc_id"]: r["source"] for r in kept[3]}
    taken = Counter(r["doc_id"] for r in kept[4])
    assert max(taken.values()) <= 2 and {r["text"] for r in kept[4]} <= {r["text"] for r in kept[3]}
    totals = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    for s, target in plain_targets(totals).items():
        largest = max(size[i] for i in size if source[i] == s)
        assert abs(sum(taken[i] * size[i] for i in size if source[i] == s) - target) <= largest / 2 + 1


def test_tokens(kept):
    texts = {r["doc_id"]: r["text"] for r in kept[4]}
    assert Counter(r["doc_id"] for r in kept[5]) == Counter(r["doc_id"] for r in kept[4])
    for r in kept[5]:
        assert r["ids"] == LIBRARY.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_documents():
    spark = session()
    rows = [(1, None, "en", None, None), (1, None, "en", None, None), (None, "", None, "a", 0), (2, "token=" + "a" * 50, "en", "a", 56), (2, "other words stand in this one", "en", "b", 9), (3, "word " * 100_000, None, "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    named = docs.selectExpr("*", "1 as copies", "2 as hash", "3 as row", "4 as id", "5 as _pattern", "6 as _whole", "7 as kinds", "8 as ids", "9 as doc")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, named, SF_DIR)
        assert out.columns == named.columns and {r["copies"] for r in out.collect()} <= {1}
    for docs in (docs, docs.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            assert out.count() <= 2 * n, name
    assert len(corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF_DIR).collect()) == 4
