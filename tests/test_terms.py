"""Terms found by automata against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from quirecheck.functions.terms import Terms
from quirecheck.operators import reference as R
from tests.support import session


def test_terms_equal_plain_containment():
    rng = random.Random(1)
    for _ in range(200):
        letters = rng.choice(["ab", "abc", "aé𝒳b "])
        terms = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))]
        found = Terms(terms)
        for _ in range(10):
            text = "".join(rng.choice(letters + "z") for _ in range(rng.randrange(30)))
            assert found.within(text) == {i for i, t in enumerate(terms) if t in text}
    assert Terms([]).within("text") == set()
    assert Terms(["a" * 100_000]).within("a" * 200_000) == {0}


@pytest.mark.parametrize("shard", [4_000_000, 20])
def test_containing_and_missing_terms(monkeypatch, shard):
    monkeypatch.setattr(R, "SHARD", shard)
    spark, rng = session(), random.Random(2)
    words = ["alpha", "beta", "gam", "ma", "be", "x", "alphabet"]
    keys = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 3))) for _ in range(20)})
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(8)))) for i in range(60)] + [(60, None), (61, ""), (0, "alpha again")]
    df = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    got = sorted((r["k"], r["doc_id"]) for r in R.containing(spark.createDataFrame([(k,) for k in keys], "k string"), df, "k", "text", "doc_id").collect())
    assert got == sorted((k, i) for i, t in texts for k in keys if k in (t or ""))
    glossary = spark.createDataFrame([(i, t) for i, t in enumerate(["Alpha", "beta  gam", None, "", "  ", "Alpha", "ma", "never there"])], "term_no int, term string")
    found = sorted((r["doc_id"], r["missing"]) for r in R.missing_terms(df, glossary).collect())
    plain = lambda t: [term for term in ("Alpha", "beta  gam", "Alpha", "ma", "never there") if " ".join(term.lower().split()) not in " ".join((t or "").lower().split())]
    assert found == sorted((i, plain(t)) for i, t in texts)
    none = R.missing_terms(df, glossary.where("term = ''")).collect()
    assert len(none) == len(texts) and not any(r["missing"] for r in none)
    assert R.missing_terms(df.limit(0), glossary).count() == 0
    assert R.containing(spark.createDataFrame([], "k string"), df, "k", "text", "doc_id").count() == 0


def test_keys_inside_names_by_a_join(monkeypatch):
    spark, rng = session(), random.Random(3)
    letters = "abé𝒳 "
    names = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(25)))) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(names, "id int, name string").repartition(3)
    for least, heads in ((1, 1 << 18), (3, 2), (9, 1 << 18)):
        monkeypatch.setattr(R, "HEADS", heads)
        keys = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(least, least + 4))) for _ in range(200)} | {n[2 : 2 + least] for _, n in names[:99] if len(n) >= 2 + least})
        got = {(r["k"], r["id"]) for r in R.inside_names(spark.createDataFrame([(k,) for k in keys], "k string"), df, "k", "name", "id").collect()}
        assert got == {(k, i) for i, n in names for k in keys if k in (n or "")}
    assert R.inside_names(spark.createDataFrame([], "k string"), df, "k", "name", "id").count() == 0


def test_lookups_bring_no_keys_to_the_driver_and_walk_in_no_python(monkeypatch):
    spark = session()
    monkeypatch.setattr(R, "SHARD", 1)  # automata, one for each key, were collected and walked the names each
    monkeypatch.setattr(R, "_shards", lambda *_: pytest.fail("keys were collected"))
    reference = spark.createDataFrame([(0, ["gtin", "name"]), (1, ["7", "Alpha  Beta 1"]), (2, ["8", "beta 12"]), (3, ["beta 1", None])], "row_no long, cells array<string>")
    asked = spark.createDataFrame([(1, "BETA 1"), (2, "ta"), (3, "8"), (4, None), (5, "ta 12"), (6, "none")], "id long, key string")
    got = {r["id"]: r["cells"] and r["cells"][0] for r in R.query_table(asked, reference).collect()}
    assert got == {1: "7", 2: None, 3: "8", 4: None, 5: "8", 6: None}
