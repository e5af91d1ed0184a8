"""Scores against a plain version, and the clustering against direct likelihoods."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quirecheck.llm import class_lm
from quirecheck.llm.queries import op9_class_lm
from tests.support import session

SF_DIR = "/root/testdata/sf0.001"


def plain_tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), ""]


def plain_base(texts):
    """{id: (held out, tokens, known, training tokens, base score)}"""
    out_of = {i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i in texts}
    counts = Counter(t for i, x in texts.items() if not out_of[i] for t in plain_tokens(x))
    n, v = sum(counts.values()), len(counts)
    result = {}
    for i, x in texts.items():
        ts = plain_tokens(x)
        result[i] = (out_of[i], len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
    return result


def check(rows, texts):
    want = plain_base(texts)
    assert len(rows) == len(texts)
    for r in rows:
        held_out, n, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert math.isfinite(r["score"]) and r["score"] <= 1e-9


@pytest.mark.parametrize("frequent", [30_000, 40])
def test_query(monkeypatch, frequent):
    monkeypatch.setattr(class_lm, "frequent_words", lambda counts, most=frequent, f=class_lm.frequent_words: f(counts, frequent))
    spark = session()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op9_class_lm(spark, SF_DIR).collect()
    check(rows, texts)
    held = [r for r in rows if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the classes help on unseen texts


def likelihood(bigrams, group):
    by = np.eye(group.max() + 1)[group]
    table = by.T @ bigrams @ by
    f = lambda x: x * np.log(np.maximum(x, 1))
    return f(table).sum() - f(table.sum(1)).sum() - f(table.sum(0)).sum()


def test_exchange_reaches_an_optimum():
    rng = np.random.default_rng(4)
    true = rng.integers(0, 4, 30)
    bigrams = rng.poisson(rng.gamma(1.0, 8.0, (4, 4))[true][:, true]).astype(float)
    group = class_lm.exchange(bigrams, fixed=[29], classes=4, rounds=50)
    assert group[29] == 0 and (np.delete(group, 29) > 0).all()
    best = likelihood(bigrams, group)
    for w in range(29):
        for c in range(1, 5):
            other = group.copy()
            other[w] = c
            if other.max() == group.max():
                assert likelihood(bigrams, other) <= best + 1e-6


def test_probabilities_sum_to_one():
    spark = session()
    train = spark.createDataFrame([("a b a c",), ("b a",), (None,), ("d d d e",)], "text string")
    counts = class_lm.word_counts(train)
    model, _, n = class_lm.fit(train, counts)
    assert n == 14
    assert np.allclose((10**model.transition).sum(1), 1)
    known = list(model.index.values())
    sums = np.bincount(model.group[known], 10 ** model.emission[known], model.group.max() + 1)
    assert np.all(sums <= 1 + 1e-9)


@pytest.mark.parametrize("texts", [{1: " ".join(f"w{i}" for i in range(40_000))}, {i: " ".join(f"w{j} w{j}" for j in range(40)) + f" v{i}" for i in range(1, 4)}])
def test_ends_that_are_rarer_than_frequent_words(monkeypatch, texts):
    if len(texts) > 1:
        monkeypatch.setattr(class_lm, "frequent_words", lambda counts, most=40, f=class_lm.frequent_words: f(counts, 40))
    df = session().createDataFrame(list(texts.items()), "doc_id long, text string")
    check(class_lm.score_texts(df).collect(), texts)
    train = df.where(class_lm.id_remainder("doc_id", 10) != 0).select("text")
    model, _, _ = class_lm.fit(train, class_lm.word_counts(train))
    assert model.known[model.index[class_lm.END]] == pytest.approx(math.log10(train.count() + 0.1))
    assert model.emission[model.index[class_lm.END]] == 0  # the only word of its class, with its true count


@pytest.mark.parametrize("texts", [{}, {None: None}, {1: "", 2: None, 3: "  \n ", 4: "One one one ONE İ", 5: "w " * 200_000, 6: "x" * 300_000}])
def test_odd_rows(texts):
    spark = session()
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, word string")
    check(class_lm.score_texts(df).collect(), texts)


def test_scores_equal_a_plain_model(monkeypatch):
    """With the classes as given, everything is counted again word by word."""
    monkeypatch.setattr(class_lm, "frequent_words", lambda counts, most=1_500, f=class_lm.frequent_words: f(counts, 1_500))
    spark = session()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: plain_tokens(r["text"]) for r in docs.collect()}
    train = docs.where(class_lm.id_remainder("doc_id", 10) != 0).select("text")
    model, _, n = class_lm.fit(train, class_lm.word_counts(train))
    group = {w.decode(): int(model.group[i]) for w, i in model.index.items()}
    rare, classes = int(model.group[-1]), int(model.group.max()) + 1
    of = lambda w: group.get(w, rare)
    learned = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10}
    counts = Counter(w for t in learned.values() for w in t)
    pairs = Counter((of(a), of(b)) for t in learned.values() for a, b in zip(["", *t], t))
    rows, sizes = Counter(), Counter()
    for (a, _), k in pairs.items():
        rows[a] += k
    for w, k in counts.items():
        sizes[of(w)] += k
    kinds = sum(of(w) == rare for w in counts)
    assert len({c for c in group.values()} - {rare}) > 20

    def emission(w):
        return (counts[w] + 0.1) / (sizes[rare] + 0.1 * (kinds + 1)) if of(w) == rare else counts[w] / sizes[of(w)]

    want = {i: sum(math.log10((pairs[of(a), of(b)] + 0.5) / (rows[of(a)] + 0.5 * classes)) + math.log10(emission(b)) for a, b in zip(["", *t], t)) for i, t in texts.items()}
    got = {r["doc_id"]: r["score"] for r in class_lm.score_texts(docs).collect()}
    assert n == sum(counts.values()) and got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-9)


def test_words_outside_the_core_join_the_likeliest_class():
    spark, rng = session(), np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "u1", "u2", "u3", "rest"], 30)) for _ in range(40)]
    words = ["", "a", "b", "c", "d", "u1", "u2", "u3"]
    core = np.array([0, 2, 2, 3, 4, -1, -1, -1, -1])
    table = rng.integers(1, 50, (5, 5)).astype(float)
    train = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    index = {w.encode(): i for i, w in enumerate(words)}
    contexts = class_lm.context_counts(train, index, core, 5)
    seen = Counter()
    for t in texts:
        tokens = ["", *plain_tokens(t)]
        of = [int(core[words.index(w)]) if w in words else -1 for w in tokens]
        for i in range(1, len(tokens)):
            if tokens[i].startswith("u"):
                if of[i - 1] >= 0:
                    seen[words.index(tokens[i]), of[i - 1]] += 1
                if i + 1 < len(tokens) and of[i + 1] >= 0:
                    seen[words.index(tokens[i]), 5 + of[i + 1]] += 1
    assert {(r["word"], r["side"]): r["n"] for r in contexts.collect()} == dict(seen)
    smooth = table + class_lm.TRANSITION_ADD
    for r in class_lm.likeliest(contexts, table, 2).collect():
        value = lambda k, w=r["word"]: sum(n * (math.log(smooth[s, k] / smooth[:, k].sum()) if s < 5 else math.log(smooth[k, s - 5] / smooth[k].sum())) for (x, s), n in seen.items() if x == w)
        assert r["class"] == max(range(2, 5), key=value)
