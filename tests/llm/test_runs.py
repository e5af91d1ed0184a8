"""Runs of repeated words against a search over all periods."""

import hashlib
import random
import zlib

import numpy as np

from quirecheck.llm import runs
from quirecheck.llm.queries import QUERIES, with_planted_runs
from tests.support import session

SF_DIR = "/root/testdata/sf0.001"


def plain_runs(words):
    codes = np.unique(np.array([w.encode() for w in words], object), return_inverse=True)[1] if words else np.empty(0)
    found = {}
    for q in range(1, len(words) // 4 + 1):
        same = np.r_[False, codes[:-q] == codes[q:], False]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b + q - a >= max(6, 4 * q):
                found.setdefault((a, b + q - a), q)  # a multiple of the smallest period has the same stretch
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def composed(rng):
    """Words with repeats inside repeats, cut short and disturbed here and there."""
    words = [rng.choice("abcd") for _ in range(rng.randrange(1, 12))]
    for _ in range(3):
        words = words * rng.randrange(1, 6)
        if rng.random() < 0.6:
            words = words[: rng.randrange(1, len(words) + 1)] + [rng.choice("abcde") for _ in range(rng.randrange(6))]
        if rng.random() < 0.4:
            words[rng.randrange(len(words))] = "z"
    return words[:900]


def test_runs_equal_all_periods():
    rng = random.Random(11)
    texts = [composed(rng) for _ in range(300)] + [[rng.choice("ab") for _ in range(rng.randrange(300))] for _ in range(300)]
    texts += [["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"], ["a"] * 3_000, list("abcdefg") * 700, (["x"] * 50 + ["y"]) * 20, list(map(str, range(5_000))) * 4]
    df = session().createDataFrame([(i, " ".join(w), "c", 1) for i, w in enumerate(texts)], "doc_id long, text string, runs string, n_words int")
    got = {r["doc_id"]: r for r in runs.find_runs(df.repartition(4)).collect()}
    assert len(got) == len(texts)
    for i, words in enumerate(texts):
        want = plain_runs(words)
        assert [tuple(r) for r in got[i]["runs"]] == want, i
        assert got[i]["collapsed"] == plain_collapsed(words, want) and got[i]["n_words"] == len(words)


def test_every_text_alone_or_with_others(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(composed(rng)).encode() for _ in range(50)]
    together = list(runs._searched(texts, 6))
    for text, (n, found, kept) in zip(texts, together):
        ((n_1, found_1, kept_1),) = runs._searched([text], 6)
        assert (n, found.tolist(), kept) == (n_1, found_1.tolist(), kept_1)


def test_odd_rows():
    spark = session()
    many = 300_000
    odd = [None, "", " \t\n", "a\x0b\x0ca\r\na a a a", "A a A a A a A a", "é é é é é é", "x x x x x x x", "w " * many, " ".join(str(i % (many // 5)) for i in range(many)), " ".join(map(str, range(many)))]
    df = spark.createDataFrame([(None if i == 1 else i, t, "x") for i, t in enumerate(odd)] + [(3, odd[3], "y")] * 2, "doc_id long, text string, id string")
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(df).collect())
    want = [
        (-1, 0, [], ""), (0, 0, [], ""), (2, 0, [], ""), *[(3, 6, [(0, 6, 1)], "a")] * 3, (4, 8, [(0, 8, 2)], "A a"), (5, 6, [(0, 6, 1)], "é"), (6, 6, [], "x x x x x x x"),
        (7, many, [(0, many, 1)], "w"), (8, many, [(0, many, many // 5)], " ".join(map(str, range(many // 5)))), (9, many, [], odd[9]),
    ]
    assert got == want
    assert runs.find_runs(df.limit(0)).count() == 0
    other = runs.find_runs(df.selectExpr("id", "text as body"), "id", "body", least=7)
    assert other.columns == ["id", "n_words", "runs", "collapsed"] and other.where("n_words = 6 and size(runs) > 0").count() == 0


def test_query_equals_all_periods():
    spark = session()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r.asDict() for r in QUERIES["op13_runs"](spark, SF_DIR).collect()}
    assert len(got) == len(docs) and any(r["n_runs"] for r in got.values())
    for i, text in docs.items():
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = plain_runs(words)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[i] == {
            "doc_id": i, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2] if found else None,
            "runs_sha256": digest("".join("%d,%d,%d\n" % r for r in found)), "collapsed_sha256": digest(plain_collapsed(words, found) if found else " ".join(words)),
        }


def test_planting_takes_null_ids_and_empty_texts():
    df = session().createDataFrame([(None, "a b c d"), (None, None), (None, "")], "doc_id long, text string")
    assert [r["text"] for r in with_planted_runs(df).collect()] == ["a b a b", None, ""]
