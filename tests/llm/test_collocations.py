"""Automata over word sequences, and collocations against a plain count."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quirecheck.llm import automata, collocations
from quirecheck.llm.automata import CountAutomaton
from tests.support import session


def plain(rows, least=10, percent=50, most=2_000):
    """Every (lang, text) counted word by word."""
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = [w for w in re.split("[ \t]", piece) if w]
            f.update(tuple(words[i : i + m]) for m in (1, 2, 3) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        n, found = sum(c for p, c in f.items() if len(p) == 1), []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if any(len(q) > len(p) and c >= least and 100 * c >= percent * a and p in (q[:2], q[1:]) for q, c in f.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, le, r, n, -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:most])]
    return sorted(out)


def random_levels(rng, size, depth=3):
    levels = []
    for m in range(1, depth + 1):
        ids = np.unique(rng.integers(0, size, (int(rng.integers(0, 60)), m)), axis=0)
        levels.append((ids.reshape(-1, m), rng.integers(1, 4, len(ids))))
    return levels


def test_automata_hold_their_sequences():
    rng = np.random.default_rng(4)
    for size in (1, 2, 5, 30):
        words = sorted({bytes(rng.integers(97, 100, 6).astype(np.uint8)) for _ in range(size)})
        levels = random_levels(rng, len(words))
        automaton = CountAutomaton.from_bytes(CountAutomaton.build(words, levels).to_bytes())
        assert automaton.words == words
        got = collocations._padded(automaton.levels())
        assert all((a == b).all() and (v == w).all() for (a, v), (b, w) in zip(got, levels))
        # No two states at one depth have the same edges.
        automaton = CountAutomaton.build(words, [(levels[0][0][:0], levels[0][1][:0]), (levels[1][0][:0], levels[1][1][:0]), levels[2]])
        edges = [tuple(map(tuple, np.stack([automaton.label[i:j], automaton.weight[i:j], automaton.target[i:j]], 1).tolist())) for i, j in zip(automaton.begin[:-2], automaton.begin[1:-1])]
        assert len(set(edges)) == len(edges)
    assert not any(len(ids) for ids, _ in CountAutomaton.from_bytes(CountAutomaton.build([], random_levels(rng, 1)[:0]).to_bytes()).levels())


def test_union_cut_and_composition():
    rng = np.random.default_rng(9)
    for trial in range(20):
        words = [[b"%c%d" % (97 + i % 3, i) for i in sorted(rng.permutation(40)[:12])] for _ in range(3)]
        words = [sorted(w) for w in words]
        levels = [random_levels(rng, 12) for _ in range(3)]
        plain_counts = Counter()
        for w, lev in zip(words, levels):
            for ids, weight in lev:
                for row, n in zip(ids.tolist(), weight.tolist()):
                    plain_counts[tuple(w[i] for i in row)] += n
        names, joined = automata.union([CountAutomaton.build(w, lev) for w, lev in zip(words, levels)], 3)
        spelt = {tuple(names[i] for i in row): n for ids, weight in joined for row, n in zip(ids.tolist(), weight.tolist())}
        assert spelt == dict(plain_counts)
        cuts = sorted({tuple(rng.choice(sorted(set(sum(words, []))), int(rng.integers(1, 4))).tolist()) for _ in range(5)} | {(b"a",), (b"zz", b"a")})
        seen = {}
        for number, part in automata.cut(names, joined, cuts):
            for ids, weight in part:
                for row, n in zip(ids.tolist(), weight.tolist()):
                    key = tuple(names[i] for i in row)
                    assert sum(c <= key for c in cuts) == number
                    seen[key] = n
        assert seen == spelt
        asked = CountAutomaton.build(words[0], levels[0])
        found_words, found = collocations.composed(asked, CountAutomaton.build(names, joined))
        got = {tuple(found_words[i] for i in row): n for ids, weight in found for row, n in zip(ids.tolist(), weight.tolist())}
        assert got == {k: n for k, n in spelt.items() if any(k == tuple(words[0][i] for i in row) for ids, _ in levels[0] for row in ids.tolist())}


def test_codes_keep_the_order_of_wide_rows():
    ids = np.unique(np.random.default_rng(1).integers(0, 1 << 30, (500, 3)) // (1 << 28) * 99_999_999, axis=0)
    assert (np.diff(automata.codes(ids)) > 0).all()


def rows_for_tests():
    rng = random.Random(8)
    words = ["a", "B", "c\x01", "c", "\x01", "é", "É", "new", "york", "City", "w" * 300, " ", "x\x1fy"]
    rows = []
    for _ in range(700):
        n = rng.randrange(0, 25)
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\x0b", "\x0c", "?!"]) for _ in range(n))
        rows.append((rng.choice(["de", "de", "de", "en", None, "und", ""]), text))
    return rows + [("de", None), (None, None), ("fr", ""), ("de", "New York City " * 400), ("de", "a a a a a a a a a a a a a")]


CUTS = {"de": [(b"\x01",), (b"a", b"a"), (b"b", b"c", b"new"), (b"c",), (b"city", b"new", b"york"), (b"new", b"york"), (b"x",), (b"york", b"b")], "und": [(b"c", b"c")], "": [(b"a",)]}


@pytest.mark.parametrize("cuts", [None, CUTS])
def test_collocations_equal_a_plain_count(monkeypatch, cuts):
    if cuts:
        monkeypatch.setattr(collocations, "boundaries", lambda texts: cuts)
    rows = rows_for_tests()
    df = session().createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, n int, phrase string").repartition(5)
    want = plain(rows)
    assert len(want) > 50 and {r[0] for r in want} >= {"de", "und"}
    assert sorted(map(tuple, collocations.collocations(df).collect())) == want
    few = collocations.collocations(df, least=5, percent=90, most=3)
    assert few.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, few.collect())) == plain(rows, 5, 90, 3)


def test_shards_of_bounded_size(monkeypatch):
    for name, value in (("HELD", 50), ("SLICE", 16)):
        monkeypatch.setattr(collocations, name, value)
    text = "New york, new York city. a b c a b c\td e f ".lower() * 20 + "x" * 100
    shards = list(collocations._shards([pa.record_batch({"lang": ["de", "en", "de"], "text": [text, "a", None]})]))
    assert len(shards) > 3 and {s[0] for s in shards} == {"de", "en"}
    words, levels = automata.union([CountAutomaton.build(w, lev) for lang, w, lev in shards if lang == "de"], 3)
    got = {" ".join(words[i].decode() for i in row): n for ids, weight in levels for row, n in zip(ids.tolist(), weight.tolist())}
    assert int(levels[0][1].sum()) == 20 * 14 + 1 and got["new york city"] == 20 and got["a b c"] == 40 and got["c d e"] == 20 and "york new york" not in got and got["e f new"] == 19


def test_boundaries_cut_the_phrases_evenly(monkeypatch):
    for name, value in (("RANGE", 200), ("SHARE", 0.5), ("MARKS", 4)):
        monkeypatch.setattr(collocations, name, value)
    df = session().createDataFrame([("x", f"w{i:05d} a{i:05d}") for i in range(4_000)], "lang string, text string").repartition(3)
    cuts = collocations.boundaries(df)["x"]
    assert 40 <= len(cuts) <= 120 and cuts == sorted(set(cuts))
    assert collocations.boundaries(df.limit(0)) == {}


def test_products_beyond_64_bits():
    words = [b"a", b"b"]
    big = 3 << 58
    own = collocations._piece("de", 0, collocations._COUNTS, 0, words, [(np.array([[0], [1]]), np.array([big, big + 1])), (np.array([[0, 1]]), np.array([big])), (np.empty((0, 3), np.int64), np.empty(0, np.int64))])
    df = session().createDataFrame(own.to_pylist(), collocations._PIECE)
    got = collocations.scored(df, df.selectExpr("lang", "range", "2 as kind", "origin", "automaton"), 50).collect()
    assert [tuple(r) for r in got] == [("de", "a b", big, big, big + 1, 10**6 * big // (big + 1))]


def test_empty_and_odd_tables():
    spark = session()
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0
    odd = spark.createDataFrame([(None, None), ("", ""), ("x", " \t"), ("x", ".,;"), ("x", "one two")], "lang string, text string")
    assert collocations.collocations(odd).count() == 0
    same = spark.createDataFrame([("x", "one two")] * 10, "lang string, text string")
    assert [tuple(r) for r in collocations.collocations(same).collect()] == [("x", 1, "one two", 10, 10, 10, 20, 1_000_000)]
    long = spark.createDataFrame([("x", "p q r " * 200_000 + "s" * 5_000_000)], "lang string, body string")
    assert [tuple(r)[2:4] for r in collocations.collocations(long, "body").orderBy("rank").collect()] == [("p q r", 200_000), ("q r p", 199_999), ("r p q", 199_999)]
