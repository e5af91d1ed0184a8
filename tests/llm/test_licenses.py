"""Places of licence phrases against plain scanning."""

import math
import random
import re

from quirecheck.llm import licenses
from quirecheck.llm.queries import op8_licenses
from tests.support import session

SF_DIR = "/root/testdata/sf0.1"
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def check(rows, texts):
    assert len(rows) == len(texts)
    found = 0
    for r in rows:
        words = plain_words(texts[r["doc_id"]])
        places = []
        for label, phrase in PHRASES.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(words)) if words[i] == p[0] and words[i : i + len(p)] == p]
        starts = [i for i, _ in places]
        found += len(places)
        assert (r["n_words"], r["n_base"]) == (len(words), len(places)), r
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and r["labels"] == ",".join(sorted(set(r["labels"].split(","))))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 or not places) and bool(r["labels"]) == (r["score"] > 0)
    return found


def test_query():
    spark = session()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert check(op8_licenses(spark, SF_DIR).collect(), texts)


def test_odd_rows(tmp_path):
    spark, rng = session(), random.Random(6)
    pieces = [*"under the mit license apache version 2 cc by nc CC-BY-NC Apache License, x é K mitmit".split(), "under the MIT License", "\n", "(c)", "\x00"]
    texts = {i: " ".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for i in range(300)}
    texts |= {900: None, 901: "", 902: "mit " * 100_000 + "under the mit license", 903: "cc by nc " * 2000, 904: "x" * 300_000, 905: "Under The Mit License"}
    spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, words string, id int").write.parquet(f"{tmp_path}/documents.parquet")
    assert check(op8_licenses(spark, str(tmp_path)).collect(), texts)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    assert licenses.scan(empty).count() == 0


def test_fuzzy_places_need_their_key_phrase():
    spark = session()
    good = "Redistribution and use in source and binary forms, with or without any modification, are permitted"
    bad = "Redistribution or use of source and binary forms, with or without modification, are permitted"
    df = spark.createDataFrame([(1, good.replace("any ", "")), (2, good.replace("any modification", "changes")), (3, bad), (1, good.replace("any ", ""))], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["labels"], round(r["score"], 2) == 1) for r in licenses.summary(licenses.scan(df)).collect())
    assert rows[0] == rows[1] == (1, "bsd", True)
    assert rows[2][0] == 2 and rows[2][1] == "bsd" and not rows[2][2]
    assert rows[3] == (3, "", False)


def plain_places(texts):
    """Every template compared at every word of every text, as {id: [(start, template, score)]}."""
    words_of = {i: plain_words(t) for i, t in texts.items()}
    seen: dict = {}
    for words in words_of.values():
        for w in set(words):
            seen[w] = seen.get(w, 0) + 1
    weight = lambda w: math.log((1 + len(texts)) / (1 + seen.get(w, 0))) + 1
    out = {}
    for i, words in words_of.items():
        found = []
        for number, t in enumerate(licenses.TEMPLATES):
            want, key = t.words.split(), t.key.split()
            begin = next(k for k in range(len(want)) if want[k : k + len(key)] == key)
            starts = [k - begin for k in range(begin, len(words)) if words[k : k + len(key)] == key]  # the key must stand
            for start in starts:
                if start + len(want) <= len(words):
                    agreed = sum(weight(a) for a, b in zip(want, words[start:]) if a == b) / sum(map(weight, want))
                    if agreed > 1 - 1e-9 or not t.base and agreed >= licenses.ENOUGH:
                        found.append((start, number, round(min(agreed, 1.0), 9)))
        out[i] = sorted(found)
    return out


def test_all_places_equal_a_plain_comparison():
    spark, rng = session(), random.Random(12)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for i in range(600):  # templates with words altered anywhere, key phrases and anchors too
        words = [rng.choice("the of a software use permission granted".split()) for _ in range(10)]
        for _ in range(3):
            part = rng.choice(licenses.TEMPLATES).words.split()
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = rng.choice(["changed", "the", "license"])
            words += part + ["and"] * rng.randrange(3)
        texts[10**6 + i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: [(p["start"], p["template"], round(p["score"], 9)) for p in r["places"]] for r in licenses.scan(df).collect()}
    want = plain_places(texts)
    assert got == want and sum(1 for found in want.values() for p in found if p[2] < 1) > 50


def test_a_million_rare_words_end():
    spark = session()
    df = spark.createDataFrame([(1, "mit " * 1_000_000), (2, "under the mit license " * 100_000)] + [(i, "some other words") for i in range(3, 50)], "doc_id long, text string")
    rows = {r["doc_id"]: (r["n_words"], r["n_base"]) for r in licenses.summary(licenses.scan(df)).collect()}
    assert rows[1] == (1_000_000, 0) and rows[2] == (400_000, 100_000)
